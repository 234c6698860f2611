from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import DataFrame


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df: DataFrame) -> str:
    """The physical plan as Spark would start it."""
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def final_plan(df: DataFrame) -> str:
    """The physical plan after running, as adaptive execution left it."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)
