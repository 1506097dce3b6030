"""Adapters from the test tables to the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brightloom.sources.tables import table


def conversation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, system, prompt, reply): each assistant turn with the user turn before it.

    Turns meet by equality on (conv_id, turn), a unique key, so one very long
    conversation is spread like any other rows.
    """
    c = table(spark, sf, "conversations")
    users = c.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    replies = c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("reply"))
    systems = (
        c.where((F.col("role") == "system") & (F.col("turn") == 0))
        .select("conv_id", F.col("text").alias("system"))
    )
    return replies.join(users, ["conv_id", "turn"]).join(systems, "conv_id", "left").select(
        "conv_id", "turn", "system", "prompt", "reply"
    )


PAIRS_SQL = """
SELECT r.conv_id, r.turn, s.text AS system, u.text AS prompt, r.text AS reply
FROM conversations r
JOIN conversations u ON u.conv_id = r.conv_id AND u.turn + 1 = r.turn AND u.role = 'user'
LEFT JOIN conversations s ON s.conv_id = r.conv_id AND s.role = 'system' AND s.turn = 0
WHERE r.role = 'assistant'"""


# --- customers with order history ------------------------------------------------

AS_OF = "2001-08-01"
INACTIVE_DAYS = 180
NUMERIC = ["balance", "tenure_months", "n_orders", "spend", "n_pending"]
CATEGORICAL = ["segment", "country"]
SCORE_MODELS = ["by_orders", "by_balance", "by_tenure"]


def customer_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer: order history up to a fixed day and ``label`` = inactive at the end."""
    o = (
        table(spark, sf, "orders").groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "P").alias("n_pending"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"),
            F.min(F.to_date("o_orderdate")).alias("first"), F.max(F.to_date("o_orderdate")).alias("last"),
        )
    )
    c = table(spark, sf, "customer")
    as_of = F.to_date(F.lit(AS_OF))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("country"),
        F.col("c_acctbal").alias("acctbal"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        (F.datediff(as_of, "first") / F.lit(30.0)).alias("tenure_months"),
        F.coalesce("n_orders", F.lit(0)).cast("double").alias("n_orders"),
        F.coalesce("n_pending", F.lit(0)).cast("double").alias("n_pending"),
        "spend",
        F.coalesce(F.datediff(as_of, "last") > INACTIVE_DAYS, F.lit(True)).cast("int").alias("label"),
    )


CUSTOMERS_SQL = f"""
SELECT c_custkey AS customer_id, c_mktsegment AS segment, c_nationkey::VARCHAR AS country, c_acctbal AS acctbal,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, (DATE '{AS_OF}' - "first") / 30.0::DOUBLE AS tenure_months,
  coalesce(n_orders, 0)::DOUBLE AS n_orders, coalesce(n_pending, 0)::DOUBLE AS n_pending, spend,
  coalesce(DATE '{AS_OF}' - "last" > {INACTIVE_DAYS}, true)::INT AS label
FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'P') AS n_pending,
    sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS spend, min(o_orderdate::DATE) AS "first", max(o_orderdate::DATE) AS "last"
  FROM orders GROUP BY 1) ON c_custkey = o_custkey"""


def scored_customers(spark: SparkSession, sf: str) -> DataFrame:
    """(model, customer_id, label, score): three rule-based scores per customer."""
    c = customer_features(spark, sf)
    scores = {
        "by_orders": 1.0 / (1.0 + F.col("n_orders")),
        "by_balance": (F.col("acctbal") + 1000) / F.lit(11000.0),
        "by_tenure": F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.col("tenure_months") / 90.0), F.lit(1.0)),
    }
    cells = [F.struct(F.lit(m).alias("model"), F.round(s, 6).alias("score")) for m, s in scores.items()]
    return c.select("customer_id", "label", F.explode(F.array(*cells)).alias("s")).select(
        "s.model", "customer_id", "label", "s.score"
    )


SCORED_SQL = f"""
SELECT m AS model, customer_id, label, round(CASE m WHEN 'by_orders' THEN 1.0::DOUBLE / (1 + n_orders)
  WHEN 'by_balance' THEN (acctbal + 1000) / 11000.0::DOUBLE
  ELSE coalesce(greatest(0, 1 - tenure_months / 90.0::DOUBLE), 1) END, 6) AS score
FROM ({CUSTOMERS_SQL}), (VALUES ('by_orders'), ('by_balance'), ('by_tenure')) AS t(m)"""


# --- line items before and after a day ------------------------------------------------

SPLIT_DAY = "1998-06-01"
LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORICAL = ["l_returnflag", "l_linestatus"]


def line_windows(spark: SparkSession, sf: str, monthly: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reference, current): current carries ``window`` = 'all' or its ship month."""
    li = table(spark, sf, "lineitem").select(*LINE_NUMERIC, *LINE_CATEGORICAL, "l_shipdate")
    day = F.to_date(F.lit(SPLIT_DAY))
    window = F.date_format("l_shipdate", "yyyy-MM") if monthly else F.lit("all")
    return li.where(F.col("l_shipdate") < day), li.where(F.col("l_shipdate") >= day).withColumn("window", window)


# --- model audit log read from events ---------------------------------------------------


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    """(model, seq, event, version): purchases promote, errors roll back, the rest is rejected."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "purchase", "promote").when(F.col("event_type") == "error", "rollback").otherwise("reject")
    return e.select(
        F.col("user_id").alias("model"), F.col("event_id").alias("seq"), kind.alias("event"),
        F.get_json_object("props", "$.k").cast("long").alias("version"),
    )


# --- agent runs read from events ----------------------------------------------------------

AGENTS = ["agent_0", "agent_1", "agent_2"]
MODELS = ["sim-small", "sim-large", "gpt-4o-mini", "unlisted"]


def run_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A run is one user's day: views, clicks and purchases are tool calls, errors model calls, signups answers."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "error", "llm_call").when(F.col("event_type") == "signup", "final_answer")
        .otherwise("tool_call")
    )
    llm = F.col("event_type") == "error"
    return e.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("run_id"),
        F.concat(F.lit("agent_"), (F.col("user_id") % 3).cast("string")).alias("agent"),
        F.col("event_id").alias("step_no"), kind.alias("type"), "ts",
        F.when(kind == "tool_call", F.col("event_type")).alias("name"),
        F.when(kind == "tool_call", F.create_map(F.lit("k"), (k % 5).cast("string"))).alias("arguments"),
        F.when(kind == "final_answer", F.col("props")).alias("content"),
        F.when(llm, k * 10).otherwise(0).alias("prompt_tokens"),
        F.when(llm, F.floor("value")).otherwise(0).alias("completion_tokens"),
        F.when(llm, F.element_at(F.array(*[F.lit(m) for m in MODELS]), k % 4 + 1)).alias("model"),
    )


def run_cases(steps: DataFrame) -> DataFrame:
    """(run_id, expected_tools, reference_trajectory) by weekday; Sundays expect no tool."""
    day = F.weekday(F.to_date(F.element_at(F.split("run_id", "/"), 2)))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    empty = F.array().cast("array<string>")
    return steps.select("run_id").distinct().select(
        "run_id",
        F.when(day == 6, empty).when(day % 2 == 0, words("view", "click", "purchase")).otherwise(words("view", "purchase")).alias("expected_tools"),
        F.when(day == 0, words("view", "view", "purchase")).alias("reference_trajectory"),
    )


STEPS_SQL = f"""
SELECT user_id || '/' || ts::DATE AS run_id, 'agent_' || (user_id % 3) AS agent, event_id AS step_no, epoch_us(ts) AS us,
  CASE event_type WHEN 'error' THEN 'llm_call' WHEN 'signup' THEN 'final_answer' ELSE 'tool_call' END AS type,
  event_type AS name, (props->>'k')::INT AS k, props,
  CASE WHEN event_type = 'error' THEN (props->>'k')::INT * 10 ELSE 0 END AS pt,
  CASE WHEN event_type = 'error' THEN floor(value)::BIGINT ELSE 0 END AS ct,
  {MODELS}[(props->>'k')::INT % 4 + 1] AS model FROM events"""
CASES_SQL = """
SELECT run_id, CASE WHEN d = 6 THEN []::VARCHAR[] WHEN d % 2 = 0 THEN ['view', 'click', 'purchase'] ELSE ['view', 'purchase'] END AS expected,
  CASE WHEN d = 0 THEN ['view', 'view', 'purchase'] WHEN d = 6 THEN []::VARCHAR[] WHEN d % 2 = 0 THEN ['view', 'click', 'purchase']
    ELSE ['view', 'purchase'] END AS reference
FROM (SELECT DISTINCT run_id, isodow(split_part(run_id, '/', 2)::DATE) - 1 AS d FROM steps)"""
