"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from brightloom.llm.common import stored

#: Links of one file of a round's table: few links make few files, however many partitions a shuffle has.
LINKS_A_FILE = 100_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, label: str = "links", keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """``links(a, b)`` -> one row (node, root) per linked node; root is the smallest node reachable.

    Links may repeat, point either way or to themselves; an empty table gives no
    rows. Every round works on tables in the shared folder; a node's neighbours
    are only ever reduced to their minimum, never gathered. ``keep`` writes those tables.
    """
    down = lambda d: d.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = keep(down(links), label)
    mark = _mark(edges)
    files = max(1, -(-mark[0] // LINKS_A_FILE))  # no round has more links than the first
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = keep(large.where("a <> b").coalesce(files), label)
        least = stars.groupBy("a").agg(F.min("b").alias("m"))
        small = stars.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        edges = keep(small.where("a <> b").distinct().coalesce(files), label)
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
