"""Sharding by extendible hashing, with DataFrame operations only.

Rows hash to 60 bits. A bucket is a prefix of them; one that exceeds the byte
limit splits on the next bit, all others stay as they are. The directory has one
slot per prefix of a fixed depth and maps it to its bucket; only slots that are
still too large at that depth go on to another round with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from brightloom.llm.common import stored

BITS = 60
#: Bits a round adds beyond the number of shards that the bytes ask for, and at most.
SLACK, MOST = 4, 20


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an MD5 over id and text: rows that differ in either can be told apart."""
    # the text's own digest first: a row's hash does not depend on where an id ends
    inner = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), inner)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    return F.shiftright("hash", BITS - depth)


def _bits(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, F.lit("0")))


def assign(docs: DataFrame, limit: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row: doc_id, bytes, shard (its bits, '' for the only one), depth, shard_bytes, shard_rows, fits.

    ``bytes`` is the UTF-8 length; null and empty texts have 0 bytes and a shard
    all the same. A single row beyond the limit has a shard of its own, with
    ``fits`` false; so has a group of rows equal in id and text that no bit can
    separate. Extra columns are ignored; an empty table gives no rows.
    """
    rows = stored(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("bytes"),
        row_hash(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("hash"),
    ), "hashed")
    done, base, open_rows = [], 0, rows
    while True:
        total = open_rows.agg(F.sum("bytes")).first()[0] or 0
        depth = min(BITS, base + min(MOST, math.ceil(math.log2(total / limit + 1)) + SLACK))
        buckets, still_open = _split(open_rows, base, depth, limit)
        directory = stored(buckets.select(
            F.explode(F.sequence(
                F.expr(f"shiftleft(prefix, {depth} - depth)"), F.expr(f"shiftleft(prefix + 1, {depth} - depth) - 1")
            )).alias("slot"), "prefix", "depth", "shard_bytes", "shard_rows",
        ), "directory")
        placed = open_rows.withColumn("slot", _prefix(depth))
        done.append(placed.join(directory, "slot").drop("slot", "hash"))
        if depth == BITS or still_open.isEmpty():
            break
        open_rows = stored(placed.join(still_open, "slot", "left_semi").drop("slot"), "open")
        base = depth
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        "doc_id", "bytes", _bits(F.col("prefix"), F.col("depth")).alias("shard"), "depth", "shard_bytes", "shard_rows",
        (F.col("shard_bytes") <= limit).alias("fits"),
    )


def _split(rows: DataFrame, base: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(buckets that need no further bit, slots of ``depth`` bits that do). Leaves are summed on the map side first."""
    leaves = stored(rows.groupBy(_prefix(depth).alias("slot")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")
    ), "leaves")
    # every node above the leaves, with the totals of its two halves
    level = leaves.select("*", F.explode(F.sequence(F.lit(base), F.lit(depth - 1))).alias("d"))
    half = F.expr(f"shiftright(slot, {depth} - d - 1) & 1")
    node = F.expr(f"shiftright(slot, {depth} - d)")
    sums = [F.sum(F.when(half == side, F.col(c)).otherwise(0)).alias(f"{c}{side}") for c in ("bytes", "rows") for side in (0, 1)]
    nodes = level.groupBy("d", node.alias("prefix")).agg(*sums)
    children = nodes.where(F.col("bytes0") + F.col("bytes1") > limit).select(F.explode(F.array(*[F.struct(
        (F.col("d") + 1).alias("depth"), (F.col("prefix") * 2 + side).alias("prefix"),
        F.col(f"bytes{side}").alias("shard_bytes"), F.col(f"rows{side}").alias("shard_rows"),
    ) for side in (0, 1)])).alias("c")).select("c.*").where("shard_rows > 0")
    last = depth == BITS
    closed = children.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.lit(last) & (F.col("depth") == BITS)))
    if base == 0:
        root = nodes.where((F.col("d") == 0) & ((F.col("bytes0") + F.col("bytes1") <= limit) | (F.col("rows0") + F.col("rows1") == 1)))
        closed = closed.unionByName(root.select(
            F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"),
            (F.col("bytes0") + F.col("bytes1")).alias("shard_bytes"), (F.col("rows0") + F.col("rows1")).alias("shard_rows"),
        ))
    # a bucket of one row closes at its first depth; deeper nodes of the same row are not buckets
    single = nodes.where("rows0 + rows1 = 1").select("d", "prefix")
    closed = closed.join(
        single.select((F.col("d") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")),
        ["depth", "prefix"], "left_anti",
    )
    open_slots = leaves.where((F.col("bytes") > limit) & (F.col("rows") > 1)).select("slot")
    return closed, stored(open_slots, "open-slots")
