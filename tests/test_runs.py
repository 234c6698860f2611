"""Runs of the mart: unique ids, a result whole or not at all, going on after a cut."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from mart_fixture import ROWS, fixture_tables
from quotelens import Contracts, MartParams, build_mart, write_mart
from quotelens.sources.contracts import LOOKUPS
from quotelens.sources.sink import run_key
from quotelens.sources.staging import Staging

PARAMS = MartParams()


@pytest.fixture(scope="module")
def tables(spark):
    return fixture_tables(spark)


@pytest.fixture(scope="module")
def expected(tables):
    return rows(build_mart(tables, PARAMS))


def test_unique_ids_are_reported_and_change_nothing(spark, tables, expected):
    for mode in ("raise", "report"):
        contracts = Contracts(tables, mode)
        with Staging(spark) as staging:
            assert rows(build_mart(contracts, PARAMS, staging)) == expected
        found = contracts.report()
        assert set(found) == set(LOOKUPS)
        for name, seen in found.items():
            assert seen == {"rows": len(ROWS[name]), "repeats": 0}, name


@pytest.mark.parametrize("name", ["profiles", "policy_terms", "rerate_rates"])
def test_a_repeated_id_raises_or_is_counted(spark, name):
    data = [*ROWS[name], ROWS[name][-1], {**ROWS[name][0], "id": None}]
    tables = fixture_tables(spark, **{name: data})
    with Staging(spark) as staging:
        with pytest.raises(Exception, match=f"{name}.id is not unique"):
            build_mart(Contracts(tables), PARAMS, staging).collect()
    contracts = Contracts(tables, "report")
    with Staging(spark) as staging:
        ours = rows(build_mart(contracts, PARAMS, staging))
    # Rows multiply as the joins have it, and the count is exact.
    assert ours == rows(build_mart(tables, PARAMS))
    assert contracts.report()[name] == {"rows": len(data) - 1, "repeats": 1}


def test_a_check_shares_the_scan_and_the_shuffle_of_the_join(spark, tmp_path):
    for name in ("profiles", "children"):
        spark.range(50).selectExpr("id", "id % 7 AS v").write.parquet(str(tmp_path / name))
    read = {n: spark.read.parquet(str(tmp_path / n)) for n in ("profiles", "children")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = plan(read["children"].join(read["profiles"], "id"))
        checked = plan(read["children"].join(Contracts(read)["profiles"], "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for word in ("Scan parquet", "Exchange hashpartitioning", "Exchange"):
        assert checked.count(word) == plain.count(word)
    assert "CollectMetrics" in checked


def test_only_the_first_reading_is_checked_and_modes_are_known(spark, tables):
    contracts = Contracts(tables)
    assert contracts["profiles"] is not tables["profiles"] and contracts["profiles"] is tables["profiles"]
    assert contracts["quotes"] is tables["quotes"] and len(contracts) == len(tables)
    assert contracts.report() == {}
    with pytest.raises(ValueError, match="report"):
        Contracts(tables, "ignore")


class Cut(Exception):
    pass


def staged_until(monkeypatch, name):
    """Runs end before the table ``name`` is staged."""
    write = Staging.table

    def cut(self, df, at, by=None):
        if at == name:
            raise Cut(at)
        return write(self, df, at, by)

    monkeypatch.setattr(Staging, "table", cut)


@pytest.mark.parametrize("at", ["representative_quotes", "premium_totals", "by_other_keys", "rename"])
def test_a_run_that_is_cut_off_goes_on_and_gives_one_whole_result(spark, tables, expected, tmp_path, monkeypatch, at):
    target, folder = str(tmp_path / "mart"), str(tmp_path / "work")
    with monkeypatch.context() as patch:
        if at == "rename":
            patch.setattr("quotelens.sources.sink.Staging._file_system", broken(Staging._file_system))
        else:
            staged_until(patch, at)
        with pytest.raises((Cut, OSError)):
            write_mart(tables, target, PARAMS, folder, version="1")
    assert not (tmp_path / "mart").exists()
    resumed = []
    done = Staging.table
    monkeypatch.setattr(Staging, "table", lambda self, *a, **b: (done(self, *a, **b), resumed.append(list(self.resumed)))[0])
    assert write_mart(tables, target, PARAMS, folder, version="1")
    assert "requests" in resumed[-1]
    if at == "rename":
        assert "by_other_keys" in resumed[-1]
    monkeypatch.undo()
    found = spark.read.parquet(target)
    assert rows(found.select(*build_mart(tables, PARAMS).columns)) == expected
    assert list((tmp_path / "work" / "quotelens").iterdir()) == []
    # Again: the same result stays, and another is refused.
    files = sorted(p.name for p in (tmp_path / "mart").iterdir())
    assert not write_mart(tables, target, PARAMS, folder, version="1")
    assert sorted(p.name for p in (tmp_path / "mart").iterdir()) == files
    with pytest.raises(ValueError, match="another result"):
        write_mart(tables, target, MartParams(hypothetical_rank=1), folder, version="1")


def broken(file_system):
    """A file system that loses the connection at the rename."""

    class Lost:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            if name == "rename":
                raise OSError("lost")
            return getattr(self.files, name)

    def found(self, path):
        at, files = file_system(self, path)
        return at, Lost(files)

    return found


def test_files_follow_the_decision_date(spark, tables, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_mart(tables, str(tmp_path / "mart"), PARAMS, str(tmp_path / "work"), version="x")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = spark.read.parquet(str(tmp_path / "mart")).groupBy(F.input_file_name().alias("f"))
    spans = sorted((r.a, r.b) for r in out.agg(F.min("decision_date").alias("a"), F.max("decision_date").alias("b")).collect())
    assert len(spans) > 1 and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_keys_follow_inputs_and_settings(spark, tables, tmp_path):
    with pytest.raises(ValueError, match="version"):
        run_key(tables)
    spark.range(3).write.parquet(str(tmp_path / "a"))
    one = run_key({"a": spark.read.parquet(str(tmp_path / "a"))}, PARAMS)
    assert one == run_key({"a": spark.read.parquet(str(tmp_path / "a"))}, MartParams())
    assert one != run_key({"a": spark.read.parquet(str(tmp_path / "a"))}, MartParams(term_years=1.0))
    spark.range(3).write.mode("append").parquet(str(tmp_path / "a"))
    assert one != run_key({"a": spark.read.parquet(str(tmp_path / "a"))}, PARAMS)
