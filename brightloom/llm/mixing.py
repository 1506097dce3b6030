"""Mixing sources to target weights, with DataFrame operations only.

Sizes are summed per source (combined on the map side), one small table of
rates is derived, and every document is emitted ``floor(rate)`` times plus one
more copy when a number hashed from its id falls below the fraction. No row is
moved by its source unless the table of rates outgrows the broadcast threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightloom.llm.common import stored, unused, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix"


def source_rates(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """``sizes(source, source_size)``, one row per source -> with ``target`` and ``rate`` added.

    Sources in code-point order (null last) take ``weights`` in turn. Shares of
    the total follow the weights; a target stops at ``most`` times its source,
    the excess going to the others by weight. That fixed point is a water
    level: ordered by ``most * size / weight``, a source is capped exactly
    when filling everything to its own level would need no more than the total.
    An empty table gives no rows; sources without words have target and rate 0.

    The windows run over one row per source - the recipe, not the corpus.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(1))
    rows = sizes.select("source", "source_size", weight.cast("double").alias("weight"))
    rows = rows.withColumn("cap", (F.col("source_size") * most).cast("double"))
    rows = rows.withColumn("level", F.col("cap") / F.col("weight"))
    up = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.coalesce(F.sum("cap").over(up), F.lit(0.0)).alias("cap_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up), F.lit(0.0))).alias("weight_left"),
        F.sum("source_size").over(everything).cast("double").alias("total"),
    )
    rows = rows.withColumn("capped", F.col("cap_before") + F.col("level") * F.col("weight_left") <= F.col("total"))
    free = F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))
    used = F.when(F.col("capped"), F.col("cap")).otherwise(0.0)
    rows = rows.withColumn("water", F.try_divide(
        F.col("total") - F.sum(used).over(everything), F.sum(free).over(everything)
    ))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("water"))
    return rows.select(
        "source", "source_size", target.alias("target"),
        F.coalesce(F.try_divide(target, F.col("source_size")), F.lit(0.0)).alias("rate"),
    )


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) hashed from the id: the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def mix_plan(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED,
    text: str = "text", doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """Every row of ``docs`` once: doc_id, size, source_size, target, taken, copies.

    A null text has size 0; a null source is a source of its own; rows with the
    same id share one draw; other columns are ignored. A row without words
    keeps its copies but takes no words.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")
    )
    planned = _with_rates(sized, weights, most, seed)
    return planned.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED,
    text: str = "text", doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """The mixed corpus: rows of ``docs``, all columns, each as often as the plan says.

    Same rules as :func:`mix_plan`; an empty input gives an empty mix.
    """
    size, copies = unused(docs, "_size"), unused(docs, "_copies")
    rates = _rates(
        docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")), weights, most
    ).select(F.col("source").alias(size), F.col("rate").alias(copies))
    joined = docs.join(rates, docs[source].eqNullSafe(rates[size]), "left")
    often = _copies(F.col(copies), draw(docs[doc_id], seed))
    repeat = joined.withColumn(copies, F.explode(F.array_repeat(F.lit(1), often.cast("int"))))
    return repeat.select(*[F.col(f"`{c}`") for c in docs.columns])


def _rates(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return stored(source_rates(totals, weights, most), "source-rates")


def _with_rates(sized: DataFrame, weights: Sequence[int], most: int, seed: str) -> DataFrame:
    rates = _rates(sized, weights, most).withColumnRenamed("source", "rate_source")
    joined = sized.join(rates, sized["source"].eqNullSafe(rates["rate_source"]))
    return joined.withColumn("copies", _copies(F.col("rate"), draw(F.col("doc_id"), seed)))


def _copies(rate: Column, chance: Column) -> Column:
    whole = F.floor(rate)
    return whole + F.when(chance < rate - whole, 1).otherwise(0)
