"""Time the plans in their several forms.

Usage: ``python bench_rewrites.py TABLES_DIR SF_DIR``. TABLES_DIR holds the 21 tables as
``<database>/<table>`` Parquet; ``--derive`` writes them there first, from SF_DIR. Prints one
JSON line: the better of two runs of the whole mart, staged with key sets broadcast, staged
with all joins shuffled, and as one lazy query; and of numbering the lines of SF_DIR with a
plain window and by ``sequence_index``, as they are and with a third of them in one key.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from bench import session
from quotelens import MartParams, build_mart, load_tables
from quotelens.operators import sequence_index
from quotelens.queries.derived import mart_tables
from quotelens.queries.registry import read_given
from quotelens.session import configure
from quotelens.sources import Staging
from quotelens.sources.schemas import database_of


def best(build) -> float:
    times = []
    for _ in range(2):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(min(times), 2)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("tables_dir")
    parser.add_argument("sf_dir")
    parser.add_argument("--derive", action="store_true")
    options = parser.parse_args()
    spark = configure(session("8"))
    given = read_given(spark, options.sf_dir)
    if options.derive:
        for name, df in mart_tables(given).items():
            df.write.parquet(f"{options.tables_dir}/{database_of(name)}/{name}")
    t, p = load_tables(spark, options.tables_dir), MartParams()
    lines = given["lineitem"].select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    hot = lines.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_orderkey")))
    seconds = {}
    with Staging(spark) as staging:
        seconds["mart_staged"] = best(lambda: build_mart(t, p, staging))
        threshold = "spark.sql.autoBroadcastJoinThreshold"
        spark.conf.set(threshold, "-1")
        seconds["mart_staged_shuffled"] = best(lambda: build_mart(t, p, staging))
        spark.conf.unset(threshold)
        seconds["mart_lazy"] = best(lambda: build_mart(t, p))
        for name, rows in (("lines", lines), ("hot_lines", hot)):
            for form, used in (("window", None), ("numbered", staging)):
                seconds[f"{name}_{form}"] = best(
                    lambda: sequence_index(
                        rows,
                        ["l_orderkey"],
                        "l_shipdate",
                        tie_breakers=["l_linenumber", "l_partkey"],
                        staging=used,
                    )
                )
    print(json.dumps(seconds))
    spark.stop()


if __name__ == "__main__":
    main()
