import pytest
from pyspark.sql import functions as F

from brightloom.operators import catalog, guarded as g
from brightloom.sources.tables import register


@pytest.fixture(scope="module", autouse=True)
def views(spark, small):
    register(spark, small, ("customer", "orders", "part"))


ACCEPTED = [
    "SELECT 1",
    "select * from customer",
    "  SELECT p_name FROM part ORDER BY p_retailprice DESC LIMIT 5;  ",
    "WITH t AS (SELECT 1 AS x) SELECT x FROM t",
    "VALUES (1, 2), (3, 4)",
    "SELECT 'drop table customer' AS scary_string",
    "SELECT `c_name` FROM customer",
    "SELECT 1 -- trailing comment with DROP TABLE",
    "SELECT /* insert update */ 42",
    "EXPLAIN SELECT * FROM customer",
    "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "SELECT count(*) FROM customer UNION ALL SELECT count(*) FROM orders",
]
REFUSED = [
    "INSERT INTO customer VALUES (999, 'x', 1, 1.0, 'y')",
    "UPDATE customer SET c_name = 'hacked'",
    "DELETE FROM orders",
    "DROP TABLE customer",
    "CREATE TABLE evil (x INT)",
    "CREATE TEMPORARY VIEW evil AS SELECT 1",
    "ALTER TABLE customer ADD COLUMN pwned STRING",
    "SET spark.sql.ansi.enabled = false",
    "CACHE TABLE customer",
    "TRUNCATE TABLE customer",
    "MERGE INTO customer USING orders ON c_custkey = o_custkey WHEN MATCHED THEN DELETE",
    "BEGIN; DROP TABLE customer; COMMIT",
    "SELECT 1; SELECT 2",
    "SELECT * FROM customer; DROP TABLE customer",
    "WITH t AS (SELECT 1 AS x) INSERT INTO customer SELECT x, 'a', 1, 1.0, 'b' FROM t",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/customer.parquet`",
    "SELECT * FROM no_such_table",
    "SELECT reflect('java.lang.System', 'exit', 1)",
    "EXPLAIN DROP TABLE customer",
    "",
    "   ",
]


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(spark, sql):
    g.check(spark, sql)


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    with pytest.raises(g.QueryRefused):
        g.check(spark, sql)


def test_row_cap(spark):
    result = g.run_select(spark, "SELECT c_custkey FROM customer ORDER BY 1", max_rows=3)
    assert result.rows == [[0], [1], [2]] and result.truncated
    assert g.row_cap(5000) == 200 and g.row_cap(None) == 200
    assert not g.run_select(spark, "SELECT 1 AS x").truncated


def test_deadline_stops_the_job(spark):
    slow = "SELECT count(*) FROM range(4000000000000) WHERE hash(id) = 1 AND hash(id + 1) = 2"
    with pytest.raises(g.QueryTimedOut):
        g.run_select(spark, slow, timeout_s=1.5)
    assert g.run_select(spark, "SELECT 1 AS x", timeout_s=60).rows == [[1]]


def test_chart(spark):
    sql = "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY 1"
    assert len(g.chart_points(spark, sql, "bar", "p_brand", "n")) > 1
    with pytest.raises(ValueError, match="no chart of type"):
        g.chart_data(spark, sql, "pie", "p_brand", "n")
    with pytest.raises(ValueError, match="the chart needs columns"):
        g.chart_data(spark, sql, "bar", "p_brand", "nope")
    with pytest.raises(ValueError, match="no rows"):
        g.chart_points(spark, "SELECT p_brand, 1 AS n FROM part WHERE false", "bar", "p_brand", "n")


def test_resolve():
    assert catalog.resolve(" Customer ", ["customer", "orders"]) == "customer"
    with pytest.raises(ValueError, match="customer, orders"):
        catalog.resolve("nope", ["customer", "orders"])


def test_catalog_tables(spark):
    rows = {r["table_name"]: r for r in catalog.inventory(catalog.catalog_tables(spark)).collect()}
    assert rows["customer"]["columns"] == 5 and rows["customer"]["rows"] > 0


def test_profile_ignores_nulls_and_uses_population_std(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, None)], "x double, s string")
    rows = {r["column_name"]: r for r in catalog.profile(df).collect()}
    x, s = rows["x"], rows["s"]
    assert (x["total_rows"], x["non_null"], x["nulls"], x["distinct_values"]) == (3, 2, 1, 2)
    assert (x["mean"], x["std"], x["min_num"], x["max_num"]) == (2.0, 1.0, 1.0, 3.0)
    assert (s["mean"], s["min_text"], s["distinct_values"]) == (None, "a", 1)


def test_top_values_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "s string")
    got = [(r["rank"], r["text_value"], r["n"]) for r in catalog.top_values(df).orderBy("rank").collect()]
    assert got == [(1, "c", 2), (2, "a", 1), (3, "b", 1)]


def test_describe(spark):
    rows = catalog.describe(spark.range(1).select("id", F.lit("x").alias("t")), ["id"]).collect()
    assert [(r["column_name"], r["type"], r["primary_key"]) for r in rows] == [("id", "bigint", True), ("t", "string", False)]


def test_profile_of_large_values(spark):
    big = 2**53
    df = spark.createDataFrame([(1e9, big), (1e9 + 1, big + 1), (1e9 + 2, big + 2)], "x double, k long")
    rows = {r["column_name"]: r for r in catalog.profile(df).collect()}
    assert rows["x"]["std"] == pytest.approx(0.8165) and rows["k"]["std"] == pytest.approx(0.8165)
    assert rows["k"]["distinct_values"] == 3
    assert catalog.top_values(df, ["k"]).count() == 3


def test_the_cut_is_flagged(spark):
    spark.range(10).createOrReplaceTempView("ten")
    rows = g.guarded(spark, "SELECT id FROM ten ORDER BY id DESC", 4).collect()
    assert [(r["id"], r["truncated"]) for r in rows] == [(9, True), (8, True), (7, True), (6, True)]
    assert {r["truncated"] for r in g.guarded(spark, "SELECT id FROM ten", 10).collect()} == {False}


def test_no_row_is_lost_whatever_the_partitions(spark):
    spark.range(0, 50, 1, 4).createOrReplaceTempView("fifty")
    spark.range(0, 300, 1, 7).createOrReplaceTempView("many")
    rows = g.guarded(spark, "SELECT id FROM fifty", 200).collect()
    assert [r["id"] for r in rows] == list(range(50)) and {r["truncated"] for r in rows} == {False}
    rows = g.guarded(spark, "SELECT a.id FROM fifty a JOIN many b ON a.id = b.id", 200).collect()
    assert sorted(r["id"] for r in rows) == list(range(50)) and {r["truncated"] for r in rows} == {False}
    rows = g.guarded(spark, "SELECT id FROM many", 200).collect()
    assert len(rows) == 200 and {r["truncated"] for r in rows} == {True}
    ordered = g.guarded(spark, "SELECT id FROM fifty ORDER BY id DESC", 50).collect()
    assert [r["id"] for r in ordered] == list(range(49, -1, -1)) and not ordered[0]["truncated"]
    points = g.chart_points(spark, "SELECT id, id * 2 AS twice FROM fifty", "line", "id", "twice")
    assert sorted(points) == [(i, 2 * i) for i in range(50)]
