"""Registered catalog and SQL queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brightloom.operators import catalog, guarded
from brightloom.sources.tables import TABLES, register, table


def revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    # Pre-aggregate by customer (map-side combine) before the join with customer.
    per_customer = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s")
    )
    joined = per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    per_nation = joined.groupBy("c_nationkey").agg(F.sum("n").alias("orders"), F.sum("s").alias("revenue"))
    # nation has a fixed number of rows (a world list), so it may always be broadcast.
    return (
        per_nation.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", "orders", F.round(F.col("revenue").cast("double"), 2).alias("revenue"))
        .orderBy(F.desc("revenue"), "n_name")
    )


def table_inventory(spark, sf):
    return catalog.inventory({n: table(spark, sf, n) for n in TABLES})


def describe_orders(spark, sf):
    orders = table(spark, sf, "orders")
    described = catalog.describe(orders, ["o_orderkey"])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in orders.columns])
    samples = (
        catalog.sample_rows(orders, ["o_orderkey"])
        .select("o_orderkey", F.explode(cells).alias("c"))
        .groupBy(F.col("c.column_name").alias("column_name"))
        .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "c.v"))).alias("s"))
        .select("column_name", F.array_join(F.transform("s", lambda x: x["v"]), " | ").alias("samples"))
    )
    return described.join(samples, "column_name").orderBy("ordinal")


_GUARDED = """
SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer
WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey"""


_LONG = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"


def guarded_select(spark, sf):
    register(spark, sf, ("customer",))
    return guarded.guarded(spark, _GUARDED)


_MANY = "SELECT s_suppkey, s_name FROM spread_suppliers WHERE s_nationkey = 3"


def guarded_range(spark, sf):
    """A guarded query with fewer rows than the cap, from a table of several partitions: no row is lost or flagged."""
    table(spark, sf, "supplier").repartitionByRange(5, "s_suppkey").createOrReplaceTempView("spread_suppliers")
    return guarded.guarded(spark, _MANY)


def avg_price_by_type(spark, sf):
    return (
        table(spark, sf, "part").groupBy("p_type")
        .agg(F.round(F.avg("p_retailprice"), 2).alias("avg_price"), F.count(F.lit(1)).alias("parts"))
        .orderBy(F.desc("avg_price"), "p_type")
    )


def top_priced_parts(spark, sf):
    return (
        table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
        .orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)
    )


_CTE = """
WITH monthly AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue
  FROM orders GROUP BY 1
)
SELECT month, orders, CAST(revenue AS DOUBLE) AS revenue FROM monthly WHERE orders > 0 ORDER BY month"""


def cte_orders_by_month(spark, sf):
    register(spark, sf, ("orders",))
    guarded.check(spark, _CTE)
    return spark.sql(_CTE)


_VALUES = """
SELECT w.weight, count(*) AS orders, sum(w.weight) AS total_weight
FROM orders JOIN (VALUES ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 2), ('5-LOW', 1))
     AS w(priority, weight) ON o_orderpriority = w.priority
GROUP BY w.weight ORDER BY w.weight"""


def values_relation(spark, sf):
    register(spark, sf, ("orders",))
    guarded.check(spark, _VALUES)
    return spark.sql(_VALUES)


_RECURSIVE = """
WITH RECURSIVE span AS (
  SELECT min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders
), years(y) AS (
  SELECT lo FROM span UNION ALL SELECT y + 1 FROM years JOIN span ON y < hi
), per_year AS (
  SELECT year(o_orderdate) AS oy, count(*) AS n FROM orders GROUP BY 1
)
SELECT CAST(y AS INT) AS order_year, coalesce(n, 0) AS orders FROM years LEFT JOIN per_year ON y = oy ORDER BY 1"""


def recursive_series(spark, sf):
    register(spark, sf, ("orders",))
    guarded.check(spark, _RECURSIVE)
    return spark.sql(_RECURSIVE)


_CHART = """
SELECT p_brand, round(avg(p_retailprice), 2) AS avg_price, count(*) AS parts
FROM part GROUP BY p_brand ORDER BY avg_price DESC, p_brand"""


def chart_series(spark, sf):
    register(spark, sf, ("part",))
    return guarded.chart_data(spark, _CHART, "bar", "p_brand", "avg_price")


def profile_lineitem(spark, sf):
    return catalog.profile(table(spark, sf, "lineitem"))


def top_values(spark, sf):
    return catalog.top_values(table(spark, sf, "lineitem"))


def guarded_truncated(spark, sf):
    register(spark, sf, ("orders",))
    return guarded.guarded(spark, _LONG)


QUERIES = {
    f.__name__: f
    for f in (
        revenue_by_nation, table_inventory, describe_orders, guarded_select, guarded_truncated, guarded_range, avg_price_by_type, top_priced_parts,
        cte_orders_by_month, values_relation, recursive_series, chart_series, profile_lineitem, top_values,
    )
}


def _inventory_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*)::INT FROM (DESCRIBE {t})) AS columns, count(*) AS rows FROM {t}"
        for t in TABLES
    )


_LINEITEM = {
    "l_orderkey": True, "l_partkey": True, "l_suppkey": True, "l_linenumber": True, "l_quantity": True,
    "l_extendedprice": True, "l_discount": True, "l_tax": True, "l_returnflag": False, "l_linestatus": False,
    "l_shipdate": False,
}


def _profile_sql() -> str:
    parts = []
    for c, numeric in _LINEITEM.items():
        num = f"{c}::DOUBLE" if numeric else "NULL::DOUBLE"
        txt = "NULL::VARCHAR" if numeric else f"{c}::VARCHAR"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS total_rows, count({c}) AS non_null, "
            f"count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, "
            f"round(avg({num}), 4) AS mean, round(stddev_pop({num}), 4) AS std, "
            f"min({num}) AS min_num, max({num}) AS max_num, min({txt}) AS min_text, max({txt}) AS max_text FROM lineitem"
        )
    return " UNION ALL ".join(parts)


def _top_sql() -> str:
    parts = []
    for c in _LINEITEM:
        num = f"{c}::DOUBLE" if _LINEITEM[c] else "NULL::DOUBLE"
        txt = "NULL::VARCHAR" if _LINEITEM[c] else f"{c}::VARCHAR"
        parts.append(
            f"(SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS rank, "
            f"{num} AS num_value, {txt} AS text_value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL "
            f"GROUP BY {c} ORDER BY n DESC, {c} LIMIT 5)"
        )
    return " UNION ALL ".join(parts)


ORACLES = {
    "revenue_by_nation": """
SELECT n_name, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY revenue DESC""",
    "table_inventory": _inventory_sql(),
    "guarded_select": f"SELECT *, count(*) OVER () > 200 AS truncated FROM ({_GUARDED}) LIMIT 200",
    "guarded_range": "SELECT s_suppkey, s_name, count(*) OVER () > 200 AS truncated FROM supplier WHERE s_nationkey = 3 LIMIT 200",
    "guarded_truncated": f"SELECT *, (SELECT count(*) FROM orders) > 200 AS truncated FROM ({_LONG}) LIMIT 200",
    "avg_price_by_type": """
SELECT p_type, round(avg(p_retailprice), 2) AS avg_price, count(*) AS parts FROM part GROUP BY p_type""",
    "top_priced_parts": """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10""",
    "cte_orders_by_month": _CTE,
    "values_relation": _VALUES.replace("sum(w.weight)", "sum(w.weight)::BIGINT"),
    "recursive_series": _RECURSIVE,
    "chart_series": f"SELECT p_brand, avg_price, count(*) OVER () > 200 AS truncated FROM ({_CHART})",
    "profile_lineitem": _profile_sql(),
    "top_values": _top_sql(),
}
