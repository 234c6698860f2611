"""Key cuts by range, Bloom filter and folder: what the scans do, and that no row is lost."""

from __future__ import annotations

import re
from threading import Lock, get_ident
from time import sleep

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from mart_fixture import fixture_tables
from quotelens import MartParams, build_mart, load_tables
from quotelens.operators import KeyFilter
from quotelens.plans.assemble import _side_by_side
from quotelens.session import DEFAULTS, configure, fit_filters
from quotelens.sources import SCHEMAS, Staging, write_ranges
from quotelens.sources.schemas import database_of

#: A range column for a key of each of these tables.
RANGES = {
    "quotes": ("id", 2),
    "vehicle_quotes": ("quote_id", 2),
    "coverages_quotes": ("quote_id", 3),
    "coverages_vehicle_quotes": ("vehicle_quote_id", 5),
    "vehicle_rates": ("rate_id", 1),
    "vehicle_rate_coverages": ("vehicle_rate_id", 4),
    "rating_requests": ("rate_id", 2),
    "rerates": ("quote_id", 2),
    "rerate_vehicle_quotes": ("rerate_quote_id", 2),
    "account_facts": ("account_id", 7),
}


@pytest.fixture
def shuffled(spark):
    """A session that broadcasts nothing and puts Bloom filters over small scans too."""
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    for name, value in names.items():
        spark.conf.set(name, value)
    configure(spark)
    yield spark
    for name in {**names, **DEFAULTS}:
        if name != "spark.sql.session.timeZone":
            spark.conf.unset(name)


def test_a_key_cut_puts_its_bloom_filter_and_range_over_the_scan(shuffled, tmp_path):
    spark = shuffled
    spark.range(20_000).selectExpr("id AS k", "id % 9 AS v").write.parquet(str(tmp_path / "children"))
    children = spark.read.parquet(str(tmp_path / "children"))
    driving = spark.createDataFrame([(5_000,), (5_003,), (5_003,), (5_900,), (None,)], "k long")
    with Staging(spark) as staging:
        cut = KeyFilter(driving, staging).apply(children, "k")
        said = plan(cut)
        assert "might_contain" in said
        assert "GreaterThanOrEqual(k,5000), LessThanOrEqual(k,5900)" in said
        assert rows(cut) == [(5_000, 5_000 % 9), (5_003, 5_003 % 9), (5_900, 5_900 % 9)]
        # The filter passes few rows on: far less than the range holds is shuffled.
        assert children.filter(F.col("k").between(5_000, 5_900)).count() == 901


def test_keys_are_written_once_for_all_tables_they_cut(spark, tmp_path):
    driving = spark.createDataFrame([(1, 5), (2, None)], "a long, b long")
    table = spark.range(10).withColumnRenamed("id", "k")
    staging = Staging(spark, str(tmp_path))
    keep = KeyFilter(driving, staging, "some")
    first, second = keep.apply(table, "k", ["a", "b"]), keep.apply(table.selectExpr("k AS other"), "other", ["a", "b"])
    assert rows(first) == rows(second) == [(1,), (2,), (5,)]
    assert len(list((tmp_path / "quotelens").glob("keys-some-a-b-*"))) == 1
    keep.apply(table, "k", ["a"])
    assert len(list((tmp_path / "quotelens").glob("keys-some-*"))) == 2


def test_no_keys_keep_no_row_and_text_keys_are_not_cut_as_numbers(spark):
    table = spark.range(20).withColumnRenamed("id", "k")
    with Staging(spark) as staging:
        empty = spark.createDataFrame([(None,)], "k long")
        assert rows(KeyFilter(empty, staging).apply(table, "k")) == []
        # As text 10 is less than 9.
        text = spark.createDataFrame([("9",), ("10",)], "k string")
        assert set(rows(KeyFilter(text, staging).apply(table, "k"))) == {(9,), (10,)}
        named = spark.createDataFrame([("b",), ("a",)], "k string")
        words = spark.createDataFrame([("a",), ("ab",), ("b",), ("c",), (None,)], "k string")
        assert rows(KeyFilter(named, staging).apply(words, "k")) == [("a",), ("b",)]


def test_ranges_hold_every_row_and_a_cut_opens_few(spark, tmp_path):
    ids = [-7, -6, -5, -1, 0, 0, 3, 4, 5, 999, 2**62, None]
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "k long, n long")
    path = str(tmp_path / "t")
    write_ranges(df, path, "k", 5)
    found = spark.read.parquet(path)
    assert rows(found.select("k", "n")) == rows(df)
    for row in found.collect():
        assert row["k_by_5"] == (None if row.k is None else row.k // 5)
    with Staging(spark) as staging:
        wanted = spark.createDataFrame([(-6,), (0,), (4,)], "k long")
        cut = KeyFilter(wanted, staging).apply(found, "k")
        said = plan(cut)
        assert cut.columns == ["k", "n"]
        assert "(k_by_5#" in said.split("PartitionFilters:")[1].splitlines()[0]
        assert rows(cut) == [(-6, 1), (0, 4), (0, 5), (4, 7)]
    with pytest.raises(ValueError, match="already"):
        write_ranges(found, str(tmp_path / "again"), "k", 7)
    with pytest.raises(ValueError, match="holds nothing"):
        write_ranges(df, str(tmp_path / "again"), "k", 0)


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS n")
    path = tmp_path / "t"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_ranges(df, str(path), "k", 10)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((path / "k_by_10=0").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(path)).count() == 30_000


def test_the_mart_is_the_same_from_tables_in_ranges(spark, tmp_path):
    tables = fixture_tables(spark)
    expected = build_mart(tables, MartParams())
    for name in SCHEMAS:
        path = f"{tmp_path}/{database_of(name)}/{name}"
        if name in RANGES:
            write_ranges(tables[name], path, *RANGES[name])
        else:
            tables[name].write.parquet(path)
    loaded = load_tables(spark, str(tmp_path))
    with Staging(spark) as staging:
        ours = build_mart(loaded, MartParams(), staging)
        assert ours.columns == expected.columns
        assert rows(ours) == rows(expected)
    assert rows(build_mart(loaded, MartParams())) == rows(expected)


def test_tables_without_rows_cut_to_nothing(spark, tmp_path):
    spark.range(0).selectExpr("id AS k", "id AS v").write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    table = spark.range(9).withColumnRenamed("id", "k")
    with Staging(spark) as staging:
        for driving in (none, spark.createDataFrame([], "k long, v long"), none.join(table, "k")):
            keep = KeyFilter(driving, staging, "none")
            assert rows(keep.apply(table, "k")) == [] and rows(keep.apply(none, "k", ["k", "v"])) == []


def test_a_resumed_run_reads_the_keys_it_wrote(spark, tmp_path):
    driving = spark.createDataFrame([(3,), (5,)], "k long")
    table = spark.range(9).withColumnRenamed("id", "k")
    first = KeyFilter(driving, Staging(spark, str(tmp_path), key="r"), "some").apply(table, "k")
    assert rows(first) == [(3,), (5,)]
    again = Staging(spark, str(tmp_path), key="r")
    assert rows(KeyFilter(driving, again, "some").apply(table, "k")) == [(3,), (5,)]
    assert again.resumed == ["keys-some-k"]


def exchanges(said: str) -> int:
    return said.count("Exchange hashpartitioning")


def test_a_table_joined_to_the_rows_that_cut_it_is_shuffled_once_behind_a_bloom_filter(spark, tmp_path):
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        configure(spark)
        spark.range(3_000).selectExpr("id AS k", "id % 9 AS v").write.parquet(str(tmp_path / "children"))
        child = spark.read.parquet(str(tmp_path / "children"))
        children = child.union(child.selectExpr("k", "v + 100"))
        driving = spark.createDataFrame([(500, "a"), (503, "b"), (503, "c"), (None, "d")], "k long, name string")
        with Staging(spark) as staging:
            _, keep = KeyFilter(driving, staging).through(driving, "driving_rows")
            met = keep.joined(children, "k")
            said = met._jdf.queryExecution().executedPlan().toString()
            assert "might_contain" in said and exchanges(said) == 2
            assert rows(met.select("k", "v", "name")) == sorted(
                ((k, k % 9 + more, name) for k, name in ((500, "a"), (503, "b"), (503, "c")) for more in (0, 100)), key=repr
            )
            none = KeyFilter(driving, staging).through(driving.filter("name = 'd'"), "no_rows")[1]
            assert rows(none.joined(children, "k")) == []
    finally:
        for name in {**wanted, **DEFAULTS}:
            if name != "spark.sql.session.timeZone":
                spark.conf.unset(name)


def test_bloom_filters_reach_scans_and_keys_of_a_large_mart():
    size = {n.rsplit(".", 1)[1]: v for n, v in DEFAULTS.items() if ".bloomFilter." in n}
    # Tables that are not broadcast are filtered, and 25 million keys leave most bits unset.
    assert size["applicationSideScanSizeThreshold"] == "10MB" and size["creationSideThreshold"] == "1GB"
    assert 2 * 25_000_000 < int(size["numBits"]) / 4 and size["numBits"] == size["maxNumBits"]


BITS = "spark.sql.optimizer.runtime.bloomFilter.numBits"


def filters(df) -> list[tuple[int, int]]:
    """Items and bits of the Bloom filters in the plan of ``df``."""
    said = df._jdf.queryExecution().optimizedPlan().toString()
    return [(int(n), int(m)) for n, m in re.findall(r"bloom_filter_agg\(.*?, (\d+), (\d+), 0, 0\)", said)]


def test_bloom_filters_are_as_large_as_their_keys_need(shuffled, tmp_path):
    spark = shuffled
    spark.range(200_000).selectExpr("id AS k").write.parquet(str(tmp_path / "children"))
    children = spark.read.parquet(str(tmp_path / "children"))
    with Staging(spark) as staging:
        # Few keys, then many, then few again, which share a run's filters with the many.
        for n, bits in ((10, 1 << 19), (150_000, 900_000), (10, 900_000)):
            driving = spark.range(n).selectExpr("id * 2 AS k")
            cut = KeyFilter(driving, staging).apply(children, "k")
            assert {m for _, m in filters(cut)} == {bits}
            assert cut.count() == min(n, 100_000)
            _, below = KeyFilter(driving, staging).through(driving, f"driving_{n}_{bits}")
            assert {m for _, m in filters(below.joined(children, "k"))} == {bits}
    fit_filters(spark, 10)
    assert spark.conf.get(BITS) == str(1 << 19)


def test_bloom_filters_never_exceed_what_driver_and_user_allow(shuffled):
    spark = shuffled
    heap = spark._jvm.java.lang.Runtime.getRuntime().maxMemory()
    fit_filters(spark, 10**12)
    assert int(spark.conf.get(BITS)) == min(int(DEFAULTS[BITS]), 8 * heap // 384)
    # What the user sets stays the most, also when it was less in between.
    spark.conf.set(BITS, "700000")
    for keys, bits in ((10**6, 700_000), (10, 1 << 19), (None, 700_000)):
        fit_filters(spark, keys)
        assert int(spark.conf.get(BITS)) == bits
    # Configured again, the session has what the user set, and the items that went with it.
    fit_filters(spark, 10)
    items = BITS.replace("numBits", "expectedNumItems")
    assert spark.conf.get(BITS) == str(1 << 19) and spark.conf.get(items) != DEFAULTS[items]
    configure(spark)
    assert (spark.conf.get(BITS), spark.conf.get(items)) == ("700000", DEFAULTS[items])
    # A session that nothing set a size in is left alone.
    spark.conf.unset(BITS)
    fit_filters(spark, 10)
    assert spark.conf.get(BITS, None) is None


def test_a_small_mart_makes_small_bloom_filters_and_plans_two_parts_at_once(shuffled):
    spark = shuffled
    tables = fixture_tables(spark)
    with Staging(spark) as staging:
        ours = rows(build_mart(tables, MartParams(), staging))
    assert spark.conf.get(BITS) == str(1 << 19)
    assert ours == rows(build_mart(tables, MartParams()))
    running, most, lock = set(), [0], Lock()

    def part(n: int):
        def run() -> int:
            with lock:
                running.add(get_ident())
                most[0] = max(most[0], len(running))
            sleep(0.1)
            with lock:
                running.discard(get_ident())
            return n

        return run

    assert _side_by_side(spark, {str(n): part(n) for n in range(5)}) == {str(n): n for n in range(5)}
    assert most[0] == 2


def test_joins_of_wide_rows_are_not_generated_as_one_method(shuffled):
    spark = shuffled
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for columns, fused in ((10, True), (60, False)):
        many = spark.range(9).select("id", *[(F.col("id") + i).alias(f"c{i}") for i in range(columns)])
        met = many.join(spark.range(3), "id", "left")
        said = met._jdf.queryExecution().executedPlan().toString()
        assert bool(re.search(r"\*\(\d+\) SortMergeJoin", said)) == fused
        assert met.count() == 9
