"""Guarded read-only SQL: Catalyst parses, a policy walks the tree, Spark runs it."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MAX_ROWS = 200
CHART_TYPES = ("bar", "line", "scatter")

# Logical nodes a read-only query may consist of; anything else is refused.
READ_NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Tail SubqueryAlias UnresolvedRelation "
    "UnresolvedWith UnresolvedInlineTable LocalRelation OneRowRelation Distinct Union Intersect Except "
    "UnresolvedHaving UnresolvedSubqueryColumnAliases WithWindowDefinition Pivot Unpivot Generate LateralJoin "
    "UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedHint ResolvedInlineTable "
    "ParameterizedQuery UnionLoop UnresolvedOrdinal AsOfJoin Range".split()
)
TABLE_FUNCTIONS = frozenset({"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "stack", "inline"})
REFUSED_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect"})


class QueryRefused(ValueError):
    """The statement is not one read-only query over the registered tables."""


class QueryTimedOut(TimeoutError):
    """The query was cancelled at its deadline."""


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[list]
    truncated: bool


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _parts(names) -> list[str]:
    return [str(p) for p in _items(names)]


def _check_expressions(node) -> None:
    for expression in _items(node.expressions()):
        stack = [expression]
        while stack:
            e = stack.pop()
            if e.getClass().getSimpleName() == "UnresolvedFunction":
                name = _parts(e.nameParts())[-1].lower()
                if name in REFUSED_FUNCTIONS:
                    raise QueryRefused(f"function {name} is not allowed")
            stack.extend(_items(e.children()))


def _walk(spark: SparkSession, node, ctes: set[str]) -> None:
    kind = node.getClass().getSimpleName()
    if kind not in READ_NODES:
        raise QueryRefused(f"only read-only queries are allowed (found {kind})")
    if kind == "UnresolvedWith":
        ctes = ctes | {str(r._1()).lower() for r in _items(node.cteRelations())}
    if kind == "UnresolvedRelation":
        name = _parts(node.multipartIdentifier())
        known = len(name) == 1 and name[0].lower() in ctes
        if not known and not spark.catalog.tableExists(".".join(f"`{p}`" for p in name)):
            raise QueryRefused(f"unknown table {'.'.join(name)}")
    if kind == "UnresolvedTableValuedFunction":
        name = _parts(node.name())[-1].lower()
        if name not in TABLE_FUNCTIONS:
            raise QueryRefused(f"table function {name} is not allowed")
    _check_expressions(node)
    inner = [c for c in _items(node.innerChildren()) if hasattr(c, "children")] if kind == "UnresolvedWith" else []
    for child in [*_items(node.children()), *inner, *_items(node.subqueries())]:
        _walk(spark, child, ctes)


def check(spark: SparkSession, sql: str) -> None:
    """Raise ``QueryRefused`` unless ``sql`` is exactly one read-only statement.

    Uses the session's own parser, so comments, literals and quoted names need
    no special treatment. ``EXPLAIN`` of an allowed query is allowed.
    """
    if not isinstance(sql, str) or not sql.strip():
        raise QueryRefused("query is empty")
    session = getattr(spark, "_jsparkSession", None)
    if session is None:
        raise QueryRefused("the policy needs the classic session's parser")
    try:
        plan = session.sessionState().sqlParser().parsePlan(sql)
    except ParseException as err:
        if ";" in sql.rstrip().rstrip(";"):
            raise QueryRefused("one statement at a time, please; this text does not parse as one") from err
        raise QueryRefused(f"query does not parse: {str(err).splitlines()[0]}") from err
    if plan.getClass().getSimpleName() == "ExplainCommand":
        plan = plan.logicalPlan()
    _walk(spark, plan, set())


def row_cap(requested: int | None, default: int = MAX_ROWS) -> int:
    return min(requested or default, default)


def guarded(spark: SparkSession, sql: str, max_rows: int | None = None) -> DataFrame:
    """The checked query, cut at the row cap, with a column ``truncated``: was anything cut?

    One row beyond the cap is fetched to learn that; the cut keeps the query's order.
    """
    check(spark, sql)
    cap = row_cap(max_rows)
    df = spark.sql(sql)
    if "truncated" in (c.lower() for c in df.columns):
        raise QueryRefused("truncated is the name of the flag; alias that column")
    # cap + 1 rows at most, but in any number of partitions; ids grow with the query's order, and one window numbers them
    cut = df.limit(cap + 1).withColumn("_id", F.monotonically_increasing_id())
    numbered = cut.withColumn("_at", F.row_number().over(Window.orderBy("_id")))
    flagged = numbered.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > cap)
    return flagged.where(F.col("_at") <= cap).orderBy("_at").drop("_id", "_at")


def run_select(
    spark: SparkSession, sql: str, max_rows: int | None = None, timeout_s: float | None = None
) -> QueryResult:
    """Run a checked query; fetch one row beyond the cap to learn whether it was cut.

    At the deadline the job group is cancelled, which stops running tasks.
    """
    check(spark, sql)
    cap = row_cap(max_rows)
    df = spark.sql(sql)
    context = spark.sparkContext
    timer, expired = None, threading.Event()
    if timeout_s is not None:
        group = f"guarded-{uuid.uuid4()}"
        context.setJobGroup(group, "guarded query", interruptOnCancel=True)

        def stop() -> None:
            expired.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(timeout_s, stop)
        timer.start()
    try:
        rows = df.limit(cap + 1).collect()
    except Exception as err:
        if expired.is_set():
            raise QueryTimedOut(f"query exceeded {timeout_s} s") from err
        raise
    finally:
        if timer is not None:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
    return QueryResult(df.columns, [list(r) for r in rows[:cap]], len(rows) > cap)


def chart_data(spark: SparkSession, sql: str, chart_type: str, x: str, y: str) -> DataFrame:
    """The (x, y) rows behind a chart of a guarded query."""
    if chart_type not in CHART_TYPES:
        raise ValueError(f"no chart of type {chart_type!r}; known types: {CHART_TYPES}")
    df = guarded(spark, sql)
    if x not in df.columns or y not in df.columns:
        raise ValueError(f"the chart needs columns {x!r} and {y!r}; the query gives {df.columns}")
    return df.select(x, y, "truncated")


def chart_points(spark: SparkSession, sql: str, chart_type: str, x: str, y: str) -> list[tuple]:
    """Collected chart points (at most the row cap); no rows is an error."""
    points = [tuple(r)[:2] for r in chart_data(spark, sql, chart_type, x, y).collect()]
    if not points:
        raise ValueError("no rows to draw")
    return points
