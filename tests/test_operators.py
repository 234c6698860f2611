"""Generic operators: null order, ties, empties, hot keys, plans."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import plan, rows
from quotelens.sources import Staging
from quotelens.operators import (
    KeyFilter,
    child_totals,
    first_by_rank,
    heavy_keys,
    from_units,
    key_set,
    label_extremes,
    latest_per_key,
    nth_per_key,
    rollup_extremes,
    sequence_index,
    shared_scale,
    split_by_existence,
    spread_join,
    to_units,
    union_disjoint,
    union_distinct,
    with_constants,
)
from quotelens.operators.rollup import Measure


def test_latest_takes_null_as_newest_and_breaks_ties_by_highest(spark):
    df = spark.createDataFrame(
        [(1, 5, 1), (1, None, 2), (1, 9, 3), (2, 4, 1), (2, 4, 7), (None, 1, 1), (None, 2, 2)],
        "k int, at int, id int",
    )
    assert rows(latest_per_key(df, ["k"], "at", ["id"])) == [
        (1, None, 2), (2, 4, 7), (None, 2, 2),
    ]


def test_unranked_row_wins_only_alone(spark):
    df = spark.createDataFrame(
        [(1, None, 1), (1, 3, 2), (2, None, 9), (2, None, 8)], "k int, rank int, id int"
    )
    assert rows(first_by_rank(df, ["k"], "rank", ["id"])) == [(1, 3, 2), (2, None, 8)]


def test_nth_skips_keys_with_fewer_rows(spark):
    df = spark.createDataFrame(
        [(1, 250), (1, 500), (1, 1000), (2, 500), (3, None), (3, 100)], "k int, d int"
    )
    assert rows(nth_per_key(df, ["k"], "d", 2)) == [(1, 500), (3, 100)]


def test_version_is_ordered_as_a_number(spark):
    df = spark.createDataFrame([(1, "9"), (1, "10")], "k int, version string")
    assert rows(latest_per_key(df, ["k"], F.col("version").cast("int"))) == [(1, "10")]


def test_pick_limits_each_key_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    text = plan(nth_per_key(df, ["k"], "id", 2))
    assert text.count("WindowGroupLimit") >= 2
    assert text.index("WindowGroupLimit") < text.index("Exchange") or "Partial" in text


def test_pick_from_empty_input(spark):
    df = spark.createDataFrame([], "k int, at int")
    assert rows(latest_per_key(df, ["k"], "at")) == []
    assert rows(sequence_index(df, ["k"], "at")) == []


def _numbered(data):
    by_key = defaultdict(list)
    for k, at, i in data:
        by_key[k].append((at is None, at or 0, i))
    return {
        (k, i): n for k, found in by_key.items() for n, (_, _, i) in enumerate(sorted(found))
    }


@pytest.mark.parametrize("clash", [False, True])
def test_sequence_index_equals_plain_numbering_with_a_hot_key(spark, clash):
    """A third of the rows, all in one key; nulls and long ties in the order."""
    rnd = random.Random(7)
    data = []
    for i in range(6000):
        k = None if i % 3 == 0 else (1 if i % 7 == 0 else rnd.randrange(400))
        data.append((k, None if i % 11 == 0 else rnd.randrange(40), i))
    df = spark.createDataFrame(data, "k int, at int, id int")
    if clash:
        df = df.selectExpr("*", "1 part", "2 _part", "3 edge", "4 before", "5 rows", "6 of_k")
    with Staging(spark) as staging:
        out = sequence_index(df, ["k"], "at", tie_breakers=["id"], out="n", staging=staging, one_task_bytes=0)
        assert out.columns == [*df.columns, "n"]
        assert {(r.k, r.id): r.n for r in out.collect()} == _numbered(data)


def test_numbering_spreads_every_hot_key(spark):
    """Every key is dealt by its order, and no task gets all of one that fills a partition."""
    data = [(k, i, i) for k in range(1, 1101) for i in range(3)] + [(0, i, i) for i in range(3000)]
    df = spark.createDataFrame(data, "k int, at int, id int")
    # At this size adaptive execution would put all partitions together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    with Staging(spark) as staging:
        out = sequence_index(df, ["k"], "at", out="n", staging=staging, one_task_bytes=0)
        assert {(r.k, r.id): r.n for r in out.collect()} == _numbered(data)
        written = spark.read.parquet(next(p for p in staging._paths if "placed_rows" in p))
        parts = written.filter("k = 0").groupBy("part").count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 2500
        # What goes on from an earlier partition is at most a row per partition.
        assert "BroadcastNestedLoopJoin" not in plan(out)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_table_for_one_task_takes_a_plain_window(spark):
    small, large = spark.range(50), spark.range(20_000_000)
    with Staging(spark) as staging:
        sequence_index(small.selectExpr("id AS k", "id AS at"), ["k"], "at", staging=staging)
        assert staging._paths == []
        given = large.filter("id < 40").selectExpr("id % 2 AS k", "id AS at")
        out = sequence_index(given, ["k"], "at", staging=staging)
        assert len(staging._paths) == 1 and sorted(r.sequence_index for r in out.collect()) == sorted([*range(20)] * 2)


def test_numbering_two_keys_across_partitions(spark):
    data = [(i % 2, None if i % 3 else "x", i) for i in range(4000)]
    df = spark.createDataFrame(data, "a int, b string, at int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    with Staging(spark) as staging:
        ours = rows(sequence_index(df, ["a", "b"], F.col("at").cast("long"), start=5, out="n", staging=staging, one_task_bytes=0))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ours == rows(sequence_index(df, ["a", "b"], "at", start=5, out="n"))


def test_sequence_index_start(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, at int")
    assert rows(sequence_index(df, ["k"], "at", start=1, out="n")) == [
        ("a", 1, 1), ("a", 2, 2), ("b", 5, 1),
    ]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_the_plain_join_and_deals_a_hot_key(spark, how):
    """A third of the left rows on one key, several right rows for some; nulls on both sides."""
    saved = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in saved}
    for k, v in saved.items():
        spark.conf.set(k, v)
    try:
        left = [(7 if i % 3 == 0 else None if i % 50 == 1 else i % 900, i, i % 2) for i in range(6000)]
        right = [(k, v) for k in range(0, 700) for v in range(1 + (k % 5 == 2))] + [(None, 1)]
        a = spark.createDataFrame(left, "k int, i int, part int")
        b = spark.createDataFrame(right, "k int, heavy int")
        heavy = heavy_keys(a, "k")
        assert rows(heavy) == [(7, 6)]
        out = spread_join(a, b, "k", heavy, how)
        assert out.columns == a.join(b, "k", how).columns
        assert rows(out) == rows(a.join(b, "k", how))
        hot = out.filter("k = 7").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        # Parts go to tasks by hash, so two may meet.
        assert len(hot) >= 3 and max(r["count"] for r in hot) < 0.4 * sum(r["count"] for r in hot)
        assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)
        assert rows(heavy_keys(a.limit(0), "k")) == []
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_split_by_existence(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (None,)], "r int")
    there, missing = split_by_existence(left, right, "k", "r")
    assert rows(there) == [(1,)]
    assert rows(missing) == [(2,), (None,)]
    assert "LeftSemi" in plan(there) and "LeftAnti" in plan(missing)


def test_key_set_drops_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(key_set(df, "k", "key")) == [(1,)]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_key_filter_cuts_broadcast_or_not(spark, threshold):
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, threshold)
    driving = spark.createDataFrame([(1, 5), (2, None)], "a int, b int")
    table = spark.createDataFrame([(i,) for i in range(1, 7)], "k int")
    with Staging(spark) as staging:
        keep = KeyFilter(driving, staging)
        assert rows(keep.apply(table, "k", ["a", "b"])) == [(1,), (2,), (5,)]
        children = spark.createDataFrame([(1, "x"), (9, "y")], "k int, v string")
        _, below = keep.through(keep.apply(table, "k", ["a", "b"]), "test")
        found = below.apply(children, "k")
        assert rows(found) == [(1, "x")] and "LeftSemi" in plan(found)
    spark.conf.unset(name)


def test_unions_and_constants(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "k int, v string")
    same = with_constants(df, {"flag": (False, "boolean"), "none": (None, "long")})
    assert dict(same.dtypes)["none"] == "bigint"
    assert rows(union_distinct(same, same)) == [(1, None, False, None), (2, "a", False, None)]
    assert union_disjoint(same, same).count() == 6
    assert "Exchange" not in plan(union_disjoint(same, same))


def test_child_totals_keep_childless_parents(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    children = spark.createDataFrame(
        [(1, Decimal("1.10"), "a"), (1, Decimal("2.20"), None), (2, None, None)],
        "pid int, amount decimal(12,2), vin string",
    )
    found = child_totals(parents, "id", children, "pid", ["amount"], {"vin": "n"})
    assert rows(found) == [(1, Decimal("3.30"), 1), (2, None, 0), (3, None, 0)]


def test_units_are_exact_at_the_limits(spark):
    big = Decimal("9999999999999.99")
    amounts = [Decimal("0.07"), Decimal("-0.29"), big, -big, Decimal("1.15"), None]
    df = spark.createDataFrame([(a,) for a in amounts], "a decimal(15,2)")
    scale = shared_scale(df.schema["a"].dataType)
    units = [r[0] for r in df.select(to_units("a", scale)).collect()]
    assert units == [None if a is None else int(a * 100) for a in amounts]
    back = [r[0] for r in df.select(from_units(to_units("a", scale), scale)).collect()]
    assert back == [None if a is None else float(a) for a in amounts]


def test_units_need_one_small_scale(spark):
    d2, d3, wide = T.DecimalType(12, 2), T.DecimalType(12, 3), T.DecimalType(16, 2)
    assert shared_scale(d2, d2) == 2
    assert shared_scale(d2, d3) is None
    assert shared_scale(wide) is None
    assert shared_scale(T.DoubleType(), d2) is None


MEASURES = (Measure("bi", "bi", "a"), Measure("pd", "pd", "a"), Measure("pd_b", "pd", "b"))


@pytest.mark.parametrize("seed", range(4))
def test_extremes_equal_one_join_per_label(spark, seed):
    """Average of the product of all labels' rows, never built by the operator."""
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, 1, 2, 3, 10])
    data = [
        (rnd.randrange(6), rnd.choice(["bi", "pd", "zz"]), value(), value()) for _ in range(40)
    ]
    parents = {c: c % 2 for c in range(6)}
    found = {}
    for parent in (0, 1):
        seen = defaultdict(list)
        for child in (c for c, p in parents.items() if p == parent):
            bi = [r for r in data if r[0] == child and r[1] == "bi"] or [None]
            pd = [r for r in data if r[0] == child and r[1] == "pd"] or [None]
            for x in bi:
                for y in pd:
                    seen["bi"].append(x and x[2])
                    seen["pd"].append(y and y[2])
                    seen["pd_b"].append(y and y[3])
        stats = []
        for m in ("bi", "pd", "pd_b"):
            v = [x for x in seen[m] if x is not None]
            stats += [min(v), sum(v) / len(v), max(v)] if v else [None] * 3
        found[parent] = stats
    df = spark.createDataFrame(data, "child int, label string, a int, b int")
    stats = ("min", "avg", "max")
    per_child = label_extremes(df, "child", "label", MEASURES, stats)
    per_child = per_child.withColumn("parent", F.col("child") % 2)
    out = rollup_extremes(per_child, "parent", MEASURES, stats)
    for r in out.collect():
        assert list(r)[1:] == pytest.approx(found[r.parent])


def test_skewed_semi_join_under_an_aggregate_is_split(spark):
    """Adaptive execution must split a hot key even where a sum on it follows."""
    from quotelens.session import configure

    configure(spark)
    saved = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "30000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in saved}
    for k, v in saved.items():
        spark.conf.set(k, v)
    try:
        hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
        facts = spark.range(0, 300000, 1, 8).select(hot.alias("k"), (F.col("id") % 5).alias("v"))
        wanted = spark.range(0, 300000, 2).union(spark.range(7, 8)).select(F.col("id").alias("k"))
        totals = facts.join(wanted, "k", "left_semi").groupBy("k").agg(F.sum("v").alias("v"))
        found = {r.k: r.v for r in totals.collect()}
        assert found[7] == sum(i % 5 for i in range(0, 300000, 3)) + 7 % 5
        assert "skew=true" in totals._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
