"""Generic DataFrame operators; table and column names are always arguments."""

from quotelens.operators.joins import (
    KeyFilter,
    heavy_keys,
    key_set,
    split_by_existence,
    spread_join,
)
from quotelens.operators.ranking import (
    first_by_rank,
    latest_per_key,
    nth_per_key,
    sequence_index,
)
from quotelens.operators.rollup import (
    child_totals,
    from_units,
    label_extremes,
    rollup_extremes,
    shared_scale,
    to_units,
)
from quotelens.operators.sets import union_disjoint, union_distinct, with_constants

__all__ = [
    "KeyFilter",
    "child_totals",
    "first_by_rank",
    "from_units",
    "heavy_keys",
    "key_set",
    "label_extremes",
    "latest_per_key",
    "nth_per_key",
    "rollup_extremes",
    "sequence_index",
    "shared_scale",
    "split_by_existence",
    "spread_join",
    "to_units",
    "union_disjoint",
    "union_distinct",
    "with_constants",
]
