"""Loading, checking and staging of tables."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from mart_fixture import fixture_tables
from quotelens import load_tables, tables_from_catalog
from quotelens.session import DEFAULTS, configure
from quotelens.sources import SCHEMAS, Staging
from quotelens.sources.schemas import database_of
from quotelens.sources.tables import checked


def test_there_are_21_tables_in_three_databases():
    assert len(SCHEMAS) == 21
    assert {database_of(t) for t in SCHEMAS} == {"server_public", "public", "rerating_public"}


def test_load_from_parquet(spark, tmp_path):
    tables = fixture_tables(spark)
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{database_of(name)}/{name}")
    loaded = load_tables(spark, str(tmp_path))
    assert set(loaded) == set(SCHEMAS)
    assert rows(loaded["quotes"]) == rows(tables["quotes"])


def test_load_from_catalog(spark, tmp_path):
    df = fixture_tables(spark)["rerates"]
    spark.sql("CREATE DATABASE IF NOT EXISTS rerating_public")
    df.write.mode("overwrite").option("path", str(tmp_path / "rerates")).saveAsTable(
        "rerating_public.rerates"
    )
    assert rows(tables_from_catalog(spark)["rerates"]) == rows(df)
    spark.sql("DROP TABLE rerating_public.rerates")


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="profiles has no column account_id"):
        checked("profiles", spark.createDataFrame([(1,)], "id long"))


def test_wrong_type_is_named(spark):
    df = spark.createDataFrame([(1, 2.5)], "id long, account_id double")
    with pytest.raises(ValueError, match="profiles: account_id is double"):
        checked("profiles", df)
    text = spark.createDataFrame([("a", "b")], "id string, account_id string")
    assert checked("profiles", text).count() == 1


def test_extra_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id long, account_id long, more int")
    assert checked("profiles", df).columns == ["id", "account_id"]


def test_staging_writes_under_the_named_folder_and_deletes(spark, tmp_path):
    df = spark.range(10)
    with Staging(spark) as staging:
        staged = staging.table(df, "numbers")
        assert spark.conf.get("spark.checkpoint.dir") in staged.inputFiles()[0]
        assert rows(staged) == rows(df)
        path = staged.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    with Staging(spark, str(tmp_path)) as own:
        assert str(tmp_path) in own.table(df, "numbers").inputFiles()[0]


def test_bucketed_staging_needs_no_exchange(spark):
    df = spark.range(1000).selectExpr("id % 90 AS k", "id AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Staging(spark) as staging:
            a, b = staging.table(df, "a", by="k"), staging.table(df.distinct(), "b", by="k")
            out = a.groupBy("k").agg(F.count("v").alias("n")).join(b, "k")
            assert "Exchange" not in plan(out)
            assert out.count() == 1000 and a.columns == df.columns
            named = spark.catalog.listTables()
        assert len(spark.catalog.listTables()) < len(named)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_run_with_a_key_goes_on_after_its_last_table(spark, tmp_path):
    work = {"done": 0}

    def counted(n):
        work["done"] += 1
        return spark.range(n).selectExpr("id AS k", "id * 2 AS v")

    with pytest.raises(RuntimeError):
        with Staging(spark, str(tmp_path), key="a1") as staging:
            first = rows(staging.table(counted(5), "plain"))
            second = rows(staging.table(counted(9), "by_key", by="k"))
            with pytest.raises(ValueError, match="staged twice"):
                staging.table(counted(5), "plain")
            raise RuntimeError("the driver is lost")
    # A table that was not finished is written again.
    unfinished = tmp_path / "quotelens" / "run-a1" / "third"
    unfinished.mkdir()
    (unfinished / "part-0").write_text("torn")
    with Staging(spark, str(tmp_path), key="a1") as staging:
        assert rows(staging.table(spark.range(0).selectExpr("id AS k", "id AS v"), "plain")) == first
        again = staging.table(spark.range(0).selectExpr("id AS k", "id AS v"), "by_key", by="k")
        assert rows(again) == second and "Exchange" not in plan(again.groupBy("k").count())
        assert rows(staging.table(spark.range(2), "third")) == [(0,), (1,)]
        assert staging.resumed == ["plain", "by_key"]
    assert not (tmp_path / "quotelens" / "run-a1").exists()


ALONE = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, {root!r})
from quotelens.sources.staging import Staging, shared_folder
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .getOrCreate())
assert shared_folder(spark) is None
df = spark.range(3)
assert Staging(spark).table(df, "n") is df
spark.sparkContext.setCheckpointDir({folder!r})
with Staging(spark) as staging:
    assert {folder!r} in staging.table(df, "n").inputFiles()[0]
print("fine")
"""


def test_sessions_without_a_named_folder_stay_lazy(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    code = ALONE.format(root=root, folder=str(tmp_path))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=env)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_configure_keeps_what_the_user_set(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    configure(spark)
    assert spark.conf.get(name) == "false"
    spark.conf.unset(name)
    configure(spark)
    assert all(spark.conf.get(k) == v for k, v in DEFAULTS.items())
