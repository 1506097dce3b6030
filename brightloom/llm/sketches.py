"""Threshold-scaled document fingerprints, with DataFrame operations only.

A fingerprint keeps every word-shingle hash that lies in a fixed fraction of the
hash range, so its size follows the document, two fingerprints of very unequal
texts can be compared, and the fingerprint of a union is the union of
fingerprints. The smallest hash is always kept, so that short texts have one too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightloom.llm.common import stored

WIDTH = 5
#: One hash in so many is kept.
SCALE = 8
_BOUND = -(1 << 63) + (1 << 64) // SCALE
#: Bins of the id range that are counted, and rows per slice of ids in order.
BINS, SLICE_ROWS = 1024, 2000


def hashes(text: Column, width: int = WIDTH) -> Column:
    """Kept shingle hashes, ascending; none for a text without words. All words are one shingle if fewer than ``width``."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    coded = F.transform(words, lambda w: F.xxhash64(w))

    def shingled(codes: Column) -> Column:
        n = F.size(codes)
        runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[codes[i + k] for k in range(width)]))
        whole = F.array(F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.xxhash64(a, c)))
        return F.when(n >= width, runs).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    def kept(all_: Column) -> Column:
        low = F.filter(all_, lambda h: h < _BOUND)
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(
            F.size(all_) > 0, F.array(F.array_min(all_))
        ).otherwise(low)

    # A one-element array binds an intermediate value to a name, so it is worked out once.
    shingles = F.transform(F.array(coded), shingled)
    return F.transform(shingles, kept)[0]


def as_text(kept: Column) -> Column:
    """16 hex digits per hash, ascending."""
    return F.array_join(F.transform(kept, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' shingles together."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda h: h < _BOUND)
    return F.when(F.size(low) > 0, F.array_sort(low)).when(F.size(both) > 0, F.array(F.array_min(both))).otherwise(both)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both; two texts without words are alike."""
    total = F.size(F.array_union(a, b))
    return F.when(total == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / total)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def _slices(ids: DataFrame) -> Column:
    """A non-decreasing slice number of ``doc_id`` with about SLICE_ROWS rows per slice; null ids come last.

    Reads the ids only: range, then rows per bin. The bins are at most BINS numbers.
    """
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return F.lit(0).cast("long")
    span = float(high) - float(low)
    at = (F.col("doc_id").cast("double") - float(low)) / (span * (1 + 1e-9) + 1) * BINS
    bin_ = F.least(F.floor(at), F.lit(BINS - 1)).cast("int")
    rows = {r["bin"]: r["n"] for r in ids.where("doc_id is not null").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.array(*[F.lit(max(1, math.ceil(rows.get(b, 0) / SLICE_ROWS))) for b in range(BINS)])
    inside = F.floor((at - bin_) * F.element_at(parts, bin_ + 1)).cast("long")
    return F.coalesce(F.shiftleft(bin_.cast("long"), 40) + inside, F.lit(BINS << 40))


def with_next(docs: DataFrame, extra: list[str]) -> DataFrame:
    """``docs(doc_id, text, extra...)`` with ``next_<column>`` for text and extras: the row that follows in order.

    Rows follow by doc_id, null ids last, then by text; after the last comes the
    first. Each slice of ids is ordered in its own task and also gets the first
    rows of the slice behind it, so no task holds more than a slice; rows that
    share an id, and rows without one, are in one slice. Ids are numbers.
    """
    ids = docs.select("doc_id")
    slice_ = _slices(ids)
    firsts = ids.groupBy(slice_.alias("slice")).agg(F.min("doc_id").alias("head"))
    chain = Window.orderBy("slice")  # one row per slice
    heads = stored(firsts.select(
        F.col("slice").alias("of"), "head",
        F.coalesce(F.lag("slice").over(chain), F.max("slice").over(Window.partitionBy(F.lit(1)))).alias("before"),
    ), "heads")
    cut = docs.withColumn("slice", slice_)
    cut = cut.join(heads, (cut["slice"] == heads["of"]) & cut["doc_id"].eqNullSafe(heads["head"]), "left")
    here = F.struct(F.col("slice").alias("at"), F.lit(0).alias("halo"))
    there = F.struct(F.col("before").alias("at"), F.lit(1).alias("halo"))
    dealt = cut.select("doc_id", "text", *extra, F.explode(
        F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))
    ).alias("to"))
    order = Window.partitionBy("to.at").orderBy("to.halo", F.col("doc_id").asc_nulls_last(), "text")
    follows = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *extra)])
    return follows.where("to.halo = 0").drop("to")


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points (rounded down) replaced by the first as many of the text that follows."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each row's fingerprint next to that of its edited text and of the next document.

    Null texts are empty; texts without words have an empty fingerprint. Equal
    texts have equal fingerprints. Repeated rows stay and follow one another;
    a single row is followed by itself. Extra columns are ignored.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    paired = with_next(own.withColumn("kept", hashes(F.col("text"))), ["kept"])
    edited = paired.select("doc_id", "text", "kept", "next_kept", edited_text(F.col("text"), F.col("next_text")).alias("edited"))
    done = edited.withColumn("edited_kept", hashes(F.col("edited")))
    return done.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("kept")).alias("fingerprint"), as_text(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
        containment(F.col("kept"), F.col("edited_kept")).alias("held_by_edited"),
    )
