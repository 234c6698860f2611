"""One query per operator, straight on the given tables.

The given tables hold no nulls, so the null rules are met through ``CASE``
expressions without ``ELSE`` and through outer joins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions import (
    decode,
    exposure,
    guarded_ratio,
    matured_flag,
    plan_blend,
    presence_flag,
    rank_from_list,
    rate_change,
    sentinel_status,
    sentinel_value,
)
from quotelens.operators import (
    child_totals,
    first_by_rank,
    key_set,
    label_extremes,
    latest_per_key,
    nth_per_key,
    rollup_extremes,
    sequence_index,
    split_by_existence,
    union_disjoint,
    union_distinct,
    with_constants,
)
from quotelens.operators.rollup import Measure
from quotelens.queries.registry import Given, query, working
from quotelens.sources.staging import Staging

AS_OF = dt.date(2000, 12, 31)


def money(column: str) -> Column:
    """Amounts are held as doubles with two decimals; sums must be exact."""
    return F.col(column).cast("decimal(12,2)")


def _money(column: str) -> str:
    return f"CAST({column} AS DECIMAL(12,2))"


# ---- picking and numbering ----------------------------------------------------------


@query(
    "latest_order_per_customer",
    """
    SELECT o_custkey, c_name, o_orderkey, CAST(ordered_at AS VARCHAR) AS ordered_at
    FROM (SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS ordered_at
          FROM orders JOIN customer ON c_custkey = o_custkey
          WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'))
    QUALIFY row_number() OVER (PARTITION BY o_custkey
        ORDER BY ordered_at DESC NULLS FIRST, o_orderkey DESC) = 1""",
)
def latest_order_per_customer(given: Given) -> DataFrame:
    orders = given["orders"].filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW"))
    dated = orders.withColumn(
        "ordered_at", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))
    )
    customers = given["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_name")
    newest = latest_per_key(
        dated.join(customers, "o_custkey"), ["o_custkey"], "ordered_at", ["o_orderkey"]
    )
    return newest.select("o_custkey", "c_name", "o_orderkey", "ordered_at")


@query(
    "latest_by_cast_version",
    r"""
    SELECT user_id, event_id, CAST(version AS INTEGER) AS version
    FROM (SELECT *, regexp_extract(props, '(\d+)', 1) AS version FROM events)
    QUALIFY row_number() OVER (PARTITION BY user_id
        ORDER BY CAST(version AS INTEGER) DESC NULLS FIRST, event_id DESC) = 1""",
)
def latest_by_cast_version(given: Given) -> DataFrame:
    events = given["events"].withColumn("version", F.regexp_extract("props", r"(\d+)", 1))
    number = F.col("version").cast("int")
    newest = latest_per_key(events, ["user_id"], number, ["event_id"])
    return newest.select("user_id", "event_id", number.alias("version"))


@query(
    "customer_order_sequence",
    """
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
        ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END NULLS LAST, o_orderkey) - 1
        AS prior_orders
    FROM orders""",
)
def customer_order_sequence(given: Given) -> DataFrame:
    orders = given["orders"].select(
        "o_custkey",
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("placed"),
    )
    return sequence_index(
        orders,
        ["o_custkey"],
        "placed",
        out="prior_orders",
        tie_breakers=["o_orderkey"],
        staging=Staging(orders.sparkSession),
    ).drop("placed")


@query(
    "status_order_sequence",
    """
    SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus
        ORDER BY CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END NULLS LAST, o_orderkey)
        AS place
    FROM orders""",
)
def status_order_sequence(given: Given) -> DataFrame:
    """Three keys hold all rows, so every key is numbered over many partitions."""
    orders = given["orders"].select(
        "o_orderstatus",
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("placed"),
    )
    return sequence_index(
        orders,
        ["o_orderstatus"],
        "placed",
        start=1,
        out="place",
        tie_breakers=["o_orderkey"],
        staging=working(orders.sparkSession),
        one_task_bytes=0,
    ).drop("placed")


@query(
    "representative_order",
    """
    SELECT o_custkey, o_orderkey, status_rank
    FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS status_rank
          FROM orders)
    QUALIFY row_number() OVER (PARTITION BY o_custkey
        ORDER BY status_rank NULLS LAST, o_orderkey) = 1""",
)
def representative_order(given: Given) -> DataFrame:
    ranked = given["orders"].withColumn("status_rank", rank_from_list("o_orderstatus", ["F", "O"]))
    first = first_by_rank(ranked, ["o_custkey"], "status_rank", ["o_orderkey"])
    return first.select("o_custkey", "o_orderkey", "status_rank")


@query(
    "second_highest_per_group",
    f"""
    SELECT p_brand, p_size, CAST(total AS DOUBLE) AS total
    FROM (SELECT p_brand, CASE WHEN p_size < 50 THEN p_size END AS p_size,
                 sum({_money("l_extendedprice")}) AS total
          FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS FIRST) = 2""",
)
def second_highest_per_group(given: Given) -> DataFrame:
    parts = given["part"].select(
        F.col("p_partkey").alias("l_partkey"),
        "p_brand",
        F.when(F.col("p_size") < 50, F.col("p_size")).alias("p_size"),
    )
    totals = (
        given["lineitem"]
        .groupBy("l_partkey")
        .agg(F.sum(money("l_extendedprice")).alias("total"))
        .join(parts, "l_partkey")
        .groupBy("p_brand", "p_size")
        .agg(F.sum("total").cast("double").alias("total"))
    )
    return nth_per_key(totals, ["p_brand"], "p_size", 2)


@query(
    "date_range_after_pick",
    """
    SELECT o_custkey, o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate
    FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
              ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    WHERE o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2001-03-31'""",
)
def date_range_after_pick(given: Given) -> DataFrame:
    newest = latest_per_key(given["orders"], ["o_custkey"], "o_orderdate", ["o_orderkey"])
    in_range = F.to_date("o_orderdate").between(dt.date(2000, 1, 1), dt.date(2001, 3, 31))
    return newest.filter(in_range).select("o_custkey", "o_orderkey", "o_orderdate")


# ---- existence and unions -------------------------------------------------------------


def _split_orders(given: Given) -> tuple[DataFrame, DataFrame]:
    columns = ("o_orderkey", "o_custkey", "o_totalprice")
    orders = given["orders"].select(*columns)
    return split_by_existence(orders, given["lineitem"], "o_orderkey", "l_orderkey")


@query(
    "orders_with_lines",
    """
    SELECT DISTINCT o_orderkey, o_custkey, o_totalprice
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NOT NULL""",
)
def orders_with_lines(given: Given) -> DataFrame:
    return _split_orders(given)[0]


@query(
    "orders_without_lines",
    """
    SELECT o_orderkey, o_custkey, o_totalprice
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL""",
)
def orders_without_lines(given: Given) -> DataFrame:
    return _split_orders(given)[1]


@query(
    "existing_parent_only",
    """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE EXISTS (FROM events WHERE user_id = l_partkey)""",
)
def existing_parent_only(given: Given) -> DataFrame:
    """Inner join to a table with repeated keys, of which nothing is read."""
    seen = key_set(given["events"], "user_id", "l_partkey")
    lines = given["lineitem"].join(seen, "l_partkey", "left_semi")
    return lines.select("l_orderkey", "l_linenumber", "l_quantity")


def _slices(given: Given) -> list[DataFrame]:
    orders = given["orders"].select("o_custkey", "o_orderstatus")
    low = F.col("o_orderpriority") == "5-LOW"
    priced = F.col("o_totalprice") > 250000
    older = F.col("o_orderdate") < dt.datetime(1998, 1, 1)
    conditions = {"low": low, "large": priced, "old": older, "recent": ~older}
    rows = given["orders"]
    return [
        with_constants(
            rows.filter(keep).select(*orders.columns),
            {"slice": (name, "string"), "reviewed": (name == "old", "boolean"),
             "note": (None, "string")},
        )
        for name, keep in conditions.items()
    ]


def _slices_sql(operator: str) -> str:
    conditions = {
        "low": "o_orderpriority = '5-LOW'",
        "large": "o_totalprice > 250000",
        "old": "o_orderdate < TIMESTAMP '1998-01-01'",
        "recent": "o_orderdate >= TIMESTAMP '1998-01-01'",
    }
    return f" {operator} ".join(
        f"""SELECT o_custkey, o_orderstatus, '{name}' AS slice, {name == "old"} AS reviewed,
                   CAST(NULL AS VARCHAR) AS note FROM orders WHERE {keep}"""
        for name, keep in conditions.items()
    )


@query("four_way_union", _slices_sql("UNION"))
def four_way_union(given: Given) -> DataFrame:
    return union_distinct(*_slices(given))


@query("four_way_union_disjoint", _slices_sql("UNION ALL"))
def four_way_union_disjoint(given: Given) -> DataFrame:
    return union_disjoint(*_slices(given))


# ---- totals and extremes ------------------------------------------------------------------


@query(
    "order_line_totals",
    f"""
    SELECT o_orderkey, CAST(sum({_money("l_extendedprice")}) AS DOUBLE) AS price,
           CAST(sum({_money("l_quantity")}) AS DOUBLE) AS quantity,
           CAST(sum({_money("l_extendedprice")}) + {_money("o_totalprice")} AS DOUBLE)
               AS price_with_order,
           CAST(count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS DOUBLE) AS kept_lines
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY o_orderkey, o_totalprice""",
)
def order_line_totals(given: Given) -> DataFrame:
    lines = given["lineitem"].select(
        "l_orderkey",
        money("l_extendedprice").alias("price"),
        money("l_quantity").alias("quantity"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("kept"),
    )
    orders = given["orders"].select("o_orderkey", money("o_totalprice").alias("order_price"))
    totals = child_totals(
        orders, "o_orderkey", lines, "l_orderkey", ["price", "quantity"], {"kept": "kept_lines"}
    )
    return totals.select(
        "o_orderkey",
        *[F.col(c).cast("double").alias(c) for c in ("price", "quantity")],
        (F.col("price") + F.col("order_price")).cast("double").alias("price_with_order"),
        F.col("kept_lines").cast("double").alias("kept_lines"),
    )


FLAG_MEASURES = (
    Measure("accepted_quantity", "A", "l_quantity"),
    Measure("new_quantity", "N", "l_quantity"),
    Measure("returned_quantity", "R", "l_quantity"),
    Measure("returned_size", "R", "line_size"),
)


@query(
    "flag_extremes",
    """
    WITH lines AS (SELECT *, CASE WHEN l_quantity < 40 THEN l_quantity * 2 END AS line_size
                   FROM lineitem),
         spots AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
    SELECT l_orderkey,"""
    + ", ".join(
        f"{stat}({m.label}.{m.value}) AS {m.name}_{stat}"
        for m in FLAG_MEASURES
        for stat in ("min", "avg", "max")
    )
    + """
    FROM spots"""
    + "".join(
        f"""
    LEFT JOIN (FROM lines WHERE l_returnflag = '{flag}') {flag} USING (l_orderkey, l_linenumber)"""
        for flag in ("A", "N", "R")
    )
    + " GROUP BY l_orderkey",
)
def flag_extremes(given: Given) -> DataFrame:
    """Statistics per return flag, weighted as by one join per flag."""
    stats = ("min", "avg", "max")
    lines = given["lineitem"].select(
        F.struct("l_orderkey", "l_linenumber").alias("spot"),
        "l_returnflag",
        "l_quantity",
        F.when(F.col("l_quantity") < 40, F.col("l_quantity") * 2).alias("line_size"),
    )
    per_spot = label_extremes(lines, "spot", "l_returnflag", FLAG_MEASURES, stats)
    per_spot = per_spot.withColumn("l_orderkey", F.col("spot.l_orderkey"))
    return rollup_extremes(per_spot, "l_orderkey", FLAG_MEASURES, stats)


@query(
    "supplier_part_totals",
    f"""
    SELECT s_suppkey, flag, CAST(total AS DOUBLE) AS total, lines
    FROM supplier LEFT JOIN (
        SELECT l_suppkey, CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS flag,
               sum({_money("l_extendedprice")}) AS total, count(*) AS lines
        FROM lineitem GROUP BY 1, 2) ON l_suppkey = s_suppkey""",
)
def supplier_part_totals(given: Given) -> DataFrame:
    """Totals under two keys joined on one: a supplier has a row per flag."""
    flag = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))
    totals = (
        given["lineitem"]
        .groupBy(F.col("l_suppkey").alias("s_suppkey"), flag.alias("flag"))
        .agg(
            F.sum(money("l_extendedprice")).cast("double").alias("total"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    return given["supplier"].select("s_suppkey").join(totals, "s_suppkey", "left")


EVENT_MARKERS = ("no_use", "test_drive")

_EVENT_SCORE = """CASE event_type WHEN 'error' THEN 'no_use' WHEN 'signup' THEN 'test_drive'
    WHEN 'view' THEN NULL ELSE CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) END"""


def _event_scores(given: Given) -> DataFrame:
    markers = decode("event_type", {"error": "no_use", "signup": "test_drive"})
    number = F.floor("value").cast("int").cast("string")
    score = F.when(F.col("event_type") == "view", None).otherwise(F.coalesce(markers, number))
    return given["events"].withColumn("score", score)


@query(
    "mean_score_without_sentinels",
    f"""
    SELECT user_id, avg(CASE WHEN score NOT IN ('no_use', 'test_drive')
                        THEN CAST(score AS DOUBLE) END) AS mean_score
    FROM (SELECT user_id, {_EVENT_SCORE} AS score FROM events) GROUP BY user_id""",
)
def mean_score_without_sentinels(given: Given) -> DataFrame:
    score = sentinel_value("score", EVENT_MARKERS)
    return _event_scores(given).groupBy("user_id").agg(F.avg(score).alias("mean_score"))


# ---- expressions ------------------------------------------------------------------------------


@query(
    "decoded_codes",
    f"""
    SELECT event_id, CASE event_type WHEN 'click' THEN 'interest' WHEN 'purchase' THEN 'sale' END
               AS meaning,
           CASE WHEN score IN ('no_use', 'test_drive') THEN score ELSE 'populated' END
               AS score_status,
           CASE WHEN score IN ('no_use', 'test_drive') THEN NULL ELSE CAST(score AS DOUBLE) END
               AS score_value
    FROM (SELECT *, {_EVENT_SCORE} AS score FROM events)""",
)
def decoded_codes(given: Given) -> DataFrame:
    return _event_scores(given).select(
        "event_id",
        decode("event_type", {"click": "interest", "purchase": "sale"}).alias("meaning"),
        sentinel_status("score", EVENT_MARKERS).alias("score_status"),
        sentinel_value("score", EVENT_MARKERS).alias("score_value"),
    )


@query(
    "matured_labels",
    """
    SELECT o_orderkey, CAST(ordered_on AS VARCHAR) AS ordered_on,
           CASE WHEN date_diff('day', ordered_on, DATE '2000-12-31') < 35 THEN NULL ELSE TRUE END
               AS kept_35,
           CASE WHEN date_diff('day', ordered_on, DATE '2000-12-31') < 70 THEN NULL ELSE FALSE END
               AS lost_70
    FROM (SELECT o_orderkey, CAST(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS DATE)
              AS ordered_on FROM orders)""",
)
def matured_labels(given: Given) -> DataFrame:
    dated = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    orders = given["orders"].select("o_orderkey", F.to_date(dated).alias("ordered_on"))
    return orders.select(
        "o_orderkey",
        "ordered_on",
        matured_flag("ordered_on", AS_OF, 35, True).alias("kept_35"),
        matured_flag("ordered_on", AS_OF, 70, False).alias("lost_70"),
    )


@query(
    "plan_blended_amount",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE l_returnflag WHEN 'A' THEN l_extendedprice WHEN 'R' THEN reduced
                ELSE CAST(0.3 AS DOUBLE) * reduced + CAST(0.7 AS DOUBLE) * l_extendedprice END
               AS amount
    FROM (SELECT *, l_extendedprice * (1 - l_discount) AS reduced FROM lineitem)""",
)
def plan_blended_amount(given: Given) -> DataFrame:
    reduced = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    plan = decode("l_returnflag", {"A": "monthly", "R": "full_term"})
    amount = plan_blend(plan, "l_extendedprice", reduced)
    return given["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", amount.alias("amount"))


@query(
    "guarded_ratio_and_change",
    f"""
    WITH sums AS (
        SELECT o_custkey,
               sum(CASE WHEN l_returnflag = 'R' THEN {_money("l_extendedprice")} END) AS returned,
               sum(CASE WHEN l_returnflag = 'N' AND l_quantity > 45
                        THEN {_money("l_extendedprice")}
                        WHEN o_custkey % 3 = 0 THEN 0 END) AS kept,
               count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returns,
               count(CASE WHEN l_returnflag = 'N' THEN 1 END) + 1 AS keeps
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey),
    amounts AS (
        SELECT o_custkey, CAST(returned AS DOUBLE) AS n, CAST(kept AS DOUBLE) AS d,
               CAST(returns AS DOUBLE) AS nu, CAST(keeps AS DOUBLE) AS du FROM sums)
    SELECT o_custkey, CASE WHEN d = 0 OR d IS NULL THEN NULL ELSE n / d END AS ratio,
           CASE WHEN d = 0 OR d IS NULL THEN NULL ELSE n / d - 1 END AS change,
           CASE WHEN d = 0 OR d IS NULL THEN NULL ELSE (n / nu) / (d / du) - 1 END
               AS change_per_line,
           CASE WHEN d > 0 THEN 1 WHEN d = 0 THEN 0 END AS has_kept
    FROM amounts""",
)
def guarded_ratio_and_change(given: Given) -> DataFrame:
    price = money("l_extendedprice")
    is_returned = F.col("l_returnflag") == "R"
    is_new = F.col("l_returnflag") == "N"
    per_order = (
        given["lineitem"]
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum(F.when(is_returned, price)).alias("returned"),
            F.sum(F.when(is_new & (F.col("l_quantity") > 45), price)).alias("kept"),
            F.count_if(is_returned).alias("returns"),
            F.count_if(is_new).alias("keeps"),
        )
    )
    kept = F.when(F.col("o_custkey") % 3 == 0, F.coalesce("kept", F.lit(0))).otherwise(
        F.col("kept")
    )
    sums = (
        given["orders"]
        .select("o_orderkey", "o_custkey")
        .join(per_order, "o_orderkey", "left")
        .groupBy("o_custkey")
        .agg(
            F.sum("returned").cast("double").alias("n"),
            F.sum(kept).cast("double").alias("d"),
            F.coalesce(F.sum("returns"), F.lit(0)).cast("double").alias("nu"),
            (F.coalesce(F.sum("keeps"), F.lit(0)) + 1).cast("double").alias("du"),
        )
    )
    return sums.select(
        "o_custkey",
        guarded_ratio("n", "d").alias("ratio"),
        rate_change("n", "d").alias("change"),
        rate_change("n", "d", "nu", "du").alias("change_per_line"),
        presence_flag("d").alias("has_kept"),
    )


@query(
    "exposure_by_order",
    f"""
    SELECT o_orderkey, CAST(count(l_orderkey) AS DOUBLE) * 0.5 AS any_years,
           CASE WHEN sum({_money("l_tax")}) = 0 THEN 0.0
                ELSE CAST(count(l_orderkey) AS DOUBLE) * 0.5 END AS taxed_years,
           CASE WHEN sum({_money("l_tax")}) = 0 AND sum({_money("l_discount")}) = 0 THEN 0.0
                ELSE CAST(count(l_orderkey) AS DOUBLE) * 0.5 END AS adjusted_years
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""".replace(
        "THEN 0.0", "THEN CAST(0 AS DOUBLE)"
    ).replace("* 0.5", "* CAST(0.5 AS DOUBLE)"),
)
def exposure_by_order(given: Given) -> DataFrame:
    lines = given["lineitem"].select(
        "l_orderkey", money("l_tax").alias("tax"), money("l_discount").alias("discount"),
        F.col("l_linenumber").alias("line"),
    )
    totals = child_totals(
        given["orders"].select("o_orderkey"),
        "o_orderkey",
        lines,
        "l_orderkey",
        ["tax", "discount"],
        {"line": "lines"},
    )
    units = F.col("lines").cast("double")
    return totals.select(
        "o_orderkey",
        exposure(units).alias("any_years"),
        exposure(units, "tax").alias("taxed_years"),
        exposure(units, "tax", "discount").alias("adjusted_years"),
    )


# ---- joins in several roles ---------------------------------------------------------------------


@query(
    "two_role_totals",
    """
    WITH totals AS (SELECT n_nationkey, sum(CAST(c_acctbal AS DECIMAL(12,2))) AS balance,
                           count(c_custkey) AS customers
                    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
                    GROUP BY n_nationkey)
    SELECT c.c_custkey, s.s_suppkey, CAST(home.balance AS DOUBLE) AS home_balance,
           home.customers AS home_customers, CAST(away.balance AS DOUBLE) AS away_balance,
           r.r_name AS away_region
    FROM customer c
    LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey
    LEFT JOIN totals home ON home.n_nationkey = c.c_nationkey
    LEFT JOIN totals away ON away.n_nationkey = s.s_nationkey
    LEFT JOIN nation n ON n.n_nationkey = away.n_nationkey
    LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
)
def two_role_totals(given: Given) -> DataFrame:
    """One aggregate read under two roles, and a lookup chained on a nullable key."""
    customers = given["customer"].select(
        "c_custkey", "c_nationkey", money("c_acctbal").alias("balance")
    )
    nations = given["nation"]
    totals = child_totals(
        nations.select("n_nationkey"),
        "n_nationkey",
        customers,
        "c_nationkey",
        ["balance"],
        {"c_custkey": "customers"},
    )
    home = totals.select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.col("balance").cast("double").alias("home_balance"),
        F.col("customers").alias("home_customers"),
    )
    away = totals.select(
        F.col("n_nationkey").alias("s_nationkey"),
        F.col("balance").cast("double").alias("away_balance"),
    )
    regions = nations.join(
        given["region"], nations["n_regionkey"] == given["region"]["r_regionkey"]
    ).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("away_region"))
    suppliers = given["supplier"].select(
        F.col("s_suppkey").alias("c_custkey"), "s_suppkey", "s_nationkey"
    )
    return (
        customers.drop("balance")
        .join(suppliers, "c_custkey", "left")
        .join(home, "c_nationkey", "left")
        .join(away, "s_nationkey", "left")
        .join(regions, "s_nationkey", "left")
        .select(
            "c_custkey",
            "s_suppkey",
            "home_balance",
            "home_customers",
            "away_balance",
            "away_region",
        )
    )


@query(
    "mini_mart",
    f"""
    WITH picks AS (
        SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus,
               o_orderstatus = 'F' AS bound
        FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F'
            ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2
                     WHEN '3-MEDIUM' THEN 3 END NULLS LAST, o_orderkey) = 1),
    totals AS (
        SELECT o_orderkey, CAST(sum({_money("l_extendedprice")}) AS DOUBLE) AS price,
               CAST(sum(CASE WHEN l_returnflag = 'R' THEN {_money("l_extendedprice")} END)
                   AS DOUBLE) AS returned,
               CAST(count(l_linenumber) AS DOUBLE) AS lines,
               max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS accepted_quantity
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
    newest AS (
        SELECT o_custkey, o_orderkey FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey
            ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT p.o_orderkey, p.o_custkey, p.bound,
           CASE WHEN date_diff('day', p.o_orderdate, TIMESTAMP '2000-12-31') < 35 THEN NULL
                ELSE p.bound END AS bound_within_35_days,
           n_name, t.lines, t.accepted_quantity,
           CASE p.o_orderstatus WHEN 'F' THEN t.price WHEN 'P' THEN t.price - t.returned
                ELSE CAST(0.3 AS DOUBLE) * (t.price - t.returned)
                     + CAST(0.7 AS DOUBLE) * t.price END AS quoted,
           CASE WHEN t.returned = 0 THEN CAST(0 AS DOUBLE)
                ELSE CAST(0.5 AS DOUBLE) * t.lines END AS years,
           CASE WHEN u.price <> 0 THEN (t.price / t.lines) / (u.price / u.lines) - 1 END
               AS change_to_newest,
           c_acctbal > 0 AS in_credit
    FROM picks p
    LEFT JOIN totals t ON t.o_orderkey = p.o_orderkey
    LEFT JOIN newest w ON w.o_custkey = p.o_custkey
    LEFT JOIN totals u ON u.o_orderkey = w.o_orderkey
    LEFT JOIN customer ON c_custkey = p.o_custkey
    LEFT JOIN nation ON n_nationkey = c_nationkey
    WHERE p.o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'""",
)
def mini_mart(given: Given) -> DataFrame:
    """The shape of the quote mart on orders: pick, total, enrich, compare."""
    picked = given["orders"].select(
        "o_custkey",
        "o_orderkey",
        F.to_date("o_orderdate").alias("ordered_on"),
        "o_orderstatus",
        (F.col("o_orderstatus") == "F").alias("bound"),
        rank_from_list("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).alias("rank"),
    )
    picks = first_by_rank(picked, ["o_custkey", "bound"], "rank", ["o_orderkey"]).filter(
        F.col("ordered_on").between(dt.date(1996, 1, 1), AS_OF)
    )
    price = money("l_extendedprice")
    totals = (
        given["lineitem"]
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum(price).cast("double").alias("price"),
            F.sum(F.when(F.col("l_returnflag") == "R", price)).cast("double").alias("returned"),
            F.count(F.lit(1)).cast("double").alias("lines"),
            F.max(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias(
                "accepted_quantity"
            ),
        )
    )
    newest = latest_per_key(given["orders"], ["o_custkey"], "o_orderdate", ["o_orderkey"]).select(
        "o_custkey", F.col("o_orderkey").alias("newest_key")
    )
    compared = totals.select(
        F.col("o_orderkey").alias("newest_key"),
        F.col("price").alias("newest_price"),
        F.col("lines").alias("newest_lines"),
    )
    customers = (
        given["customer"]
        .join(given["nation"], F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .select(F.col("c_custkey").alias("o_custkey"), "n_name", "c_acctbal")
    )
    plan = decode("o_orderstatus", {"F": "monthly", "P": "full_term"})
    bound_label = F.when(F.col("bound"), matured_flag("ordered_on", AS_OF, 35, True)).otherwise(
        matured_flag("ordered_on", AS_OF, 35, False)
    )
    wide = (
        picks.join(newest, "o_custkey", "left")
        .join(customers, "o_custkey", "left")
        .join(compared, "newest_key", "left")
        .join(totals, "o_orderkey", "left")
        .withColumn("lines", F.coalesce("lines", F.lit(0.0)))
    )
    return wide.select(
        "o_orderkey",
        "o_custkey",
        "bound",
        bound_label.alias("bound_within_35_days"),
        "n_name",
        "lines",
        "accepted_quantity",
        plan_blend(plan, "price", F.col("price") - F.col("returned")).alias("quoted"),
        exposure("lines", "returned").alias("years"),
        rate_change("price", "newest_price", "lines", "newest_lines").alias("change_to_newest"),
        (F.col("c_acctbal") > 0).alias("in_credit"),
    )
