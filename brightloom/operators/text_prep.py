"""Chunk tables, cleaning, de-duplication, splitting and chat rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightloom.functions import fixed, text as tx
from brightloom.functions.partitions import spread
from brightloom.functions.ranking import shuffled_rank


def chunk_table(df: DataFrame, pieces: Column, *keep: str) -> DataFrame:
    """One row per chunk with ``position`` from 0 per document and the kept metadata."""
    return spread(df).select(*keep, F.posexplode(pieces).alias("position", "chunk"))


def chunk_documents(
    df: DataFrame, text: str, *keep: str, strategy: str = "fixed", size: int = 800, overlap: int = 120
) -> DataFrame:
    if strategy == "fixed":
        return chunk_table(df, tx.fixed_chunks(F.col(text), size, overlap), *keep)
    if strategy == "sentence":
        return chunk_table(df, tx.sentence_chunks(F.col(text), size), *keep)
    raise ValueError(f"unknown chunk strategy {strategy!r}")


def counted_terms(df: DataFrame, row_id: str, terms: Column) -> DataFrame:
    """(row_id, term, tf): the terms of a row are counted on the row, nothing is shuffled."""
    return spread(df).select(row_id, F.inline(tx.counted(terms)))


def term_counts(df: DataFrame, row_id: str, text: str, pattern: str = fixed.WORD) -> DataFrame:
    return counted_terms(df.select(row_id, text), row_id, tx.tokens(F.col(text), pattern))


def scrub_pii(df: DataFrame, *columns: str) -> DataFrame:
    return spread(df).withColumns({c: tx.scrub(F.col(c)) for c in columns})


def first_per_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Keep the row with the smallest ``order`` per key; ``order`` must be unique, or one of the smallest stays.

    The input is worked out once. Each task keeps one row per key before the
    shuffle, so a text copied into a third of all rows is no hot group.
    """
    first = Window.partitionBy("_key").orderBy(order)
    return df.withColumn("_key", key).withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_key", "_nth")


def dedupe(df: DataFrame, text: str, order: str) -> DataFrame:
    return first_per_key(df, tx.dedupe_key(F.col(text)), order)


def length_between(df: DataFrame, columns: Sequence[str], low: int, high: int) -> DataFrame:
    total = sum((F.length(c) for c in columns[1:]), F.length(columns[0]))
    return df.where(total.between(low, high))


def clean_examples(
    df: DataFrame, row_id: str, instruction: str, response: str, min_chars: int = 40, max_chars: int = 4000
) -> DataFrame:
    """Scrub, then drop later duplicates of the scrubbed instruction, then apply the length bounds."""
    scrubbed = scrub_pii(df, instruction, response)
    return length_between(dedupe(scrubbed, instruction, row_id), [instruction, response], min_chars, max_chars)


def cleaning_report(
    df: DataFrame, row_id: str, instruction: str, response: str, min_chars: int = 40, max_chars: int = 4000
) -> DataFrame:
    """One row of counts: input, output, duplicates, length-filtered, scrubbed.

    A row shrinks to (key, id, length fits, touched) before the only shuffle;
    per key the survivor is the smallest id.
    """
    new_i, new_r = tx.scrub(F.col(instruction)), tx.scrub(F.col(response))
    flags = spread(df).select(F.col(row_id), F.col(instruction).alias("_i"), new_i.alias("_ni"),
                      F.col(response).alias("_r"), new_r.alias("_nr")).select(
        tx.dedupe_key(F.col("_ni")).alias("_key"),
        F.col(row_id).alias("_id"),
        (F.length("_ni") + F.length("_nr")).between(min_chars, max_chars).alias("_fits"),
        ((F.col("_ni") != F.col("_i")) | (F.col("_nr") != F.col("_r"))).alias("_touched"),
    )
    per_key = flags.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("_touched").alias("touched"),
        F.min_by("_fits", "_id").alias("fits"),
    )
    total = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_count"),
        F.count_if("fits").alias("output_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count_if(~F.col("fits")).alias("length_filtered"),
        F.coalesce(F.sum("touched"), F.lit(0)).alias("pii_scrubbed"),
    )
    return total


def stratified_split(
    df: DataFrame, stratum: str, row_id: str, train: float = 0.8, val: float = 0.1, seed: int = 13
) -> DataFrame:
    """Adds ``split``; per stratum exactly ``round_half_even(n * fraction)`` rows for train and val."""
    if not 0 < train < 1 or not 0 < val < 1:
        raise ValueError("each share must lie between 0 and 1")
    if train + val >= 1:
        raise ValueError("the shares leave nothing to test on")
    ranked = shuffled_rank(df, [stratum], row_id, seed)
    n_train = F.bround(F.col("stratum_n") * train)
    n_val = F.bround(F.col("stratum_n") * val)
    return ranked.withColumn(
        "split",
        F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test"),
    ).drop("rank", "stratum_n")


def chat_text(template: str, system: Column, user: Column, assistant: Column) -> Column:
    formats = {"llama3": fixed.LLAMA3_FORMAT, "chatml": fixed.CHATML_FORMAT}
    if template not in formats:
        raise KeyError(f"no chat format named {template!r} among {sorted(formats)}")
    return tx.fill(formats[template], system=system, user=user, assistant=assistant)


def format_examples(df: DataFrame, template: str = "llama3", system: str = fixed.DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    return df.withColumn("text", chat_text(template, F.lit(system), F.col("instruction"), F.col("response")))
