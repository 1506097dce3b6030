"""Scores of generated text against references, and of answers against a judge.

A judge is ``(df, expected, actual) -> df`` with a ``judge_score`` column (see
``keyword_judge``); ``answer_scores`` takes any such function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brightloom.functions import fixed, text as tx
from brightloom.functions.partitions import spread
from brightloom.functions.sequences import lcs_series, ratio_series

Judge = Callable[[DataFrame, str, str], DataFrame]
Likeness = Callable[[Column, Column], Column]


def _words(text: Column) -> Column:
    return tx.tokens(text, fixed.CONTRACTION_WORD)


def exact_match(prediction: Column, reference: Column) -> Column:
    return (_words(prediction) == _words(reference)).cast("double")


def keyword_coverage(prediction: Column, reference: Column) -> Column:
    """Share of the reference's distinct content words found in the prediction; 0 without any."""
    wanted = tx.coverage_keywords(reference)
    found = F.size(F.array_intersect(wanted, _words(prediction)))
    return F.coalesce(F.try_divide(found, F.size(wanted)), F.lit(0.0))


def rouge_l(df: DataFrame, prediction: str, reference: str, prefix: str = "rouge_l") -> DataFrame:
    """Adds ``<prefix>_precision``, ``_recall`` and ``_f1``; an empty side scores 0.

    Tokens are cut in the JVM; only the subsequence length runs in Python, on Arrow batches.
    """
    lcs = F.pandas_udf(lcs_series, "int")
    p, r = F.try_divide("_l", F.size("_p")), F.try_divide("_l", F.size("_r"))
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return (
        df.withColumn("_p", _words(F.col(prediction))).withColumn("_r", _words(F.col(reference)))
        .withColumn("_l", lcs("_p", "_r"))
        .withColumns(
            {f"{prefix}_precision": p, f"{prefix}_recall": r, f"{prefix}_f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}
        )
        .drop("_p", "_r", "_l")
    )


def unpivot_systems(df: DataFrame, systems: dict[str, str], *keep: str) -> DataFrame:
    """Wide outputs to rows (keep…, system, output)."""
    cells = [F.struct(F.lit(s).alias("system"), F.col(c).alias("output")) for s, c in systems.items()]
    return df.select(*keep, F.explode(F.array(*cells)).alias("c")).select(*keep, "c.system", "c.output")


def score_outputs(rows: DataFrame, with_rouge: bool = True) -> DataFrame:
    """(…, system, output, reference) plus exact_match, keyword_coverage and ROUGE-L."""
    out = rows.withColumns(
        {
            "exact_match": exact_match(F.col("output"), F.col("reference")),
            "keyword_coverage": keyword_coverage(F.col("output"), F.col("reference")),
        }
    )
    return rouge_l(out, "output", "reference") if with_rouge else out


def system_scores(scored: DataFrame, metrics: Sequence[str], *keys: str) -> DataFrame:
    """Mean of each metric per system (and per extra key such as the category)."""
    return scored.groupBy("system", *keys).agg(F.count(F.lit(1)).alias("n_examples"), *[F.avg(m).alias(m) for m in metrics])


def system_deltas(scores: DataFrame, metrics: Sequence[str], base: str, tuned: str, *keys: str) -> DataFrame:
    """(keys…, metric, base, tuned, delta)."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    long = scores.select("system", *keys, F.explode(F.array(*cells)).alias("c")).select("system", *keys, "c.*")
    wide = long.groupBy(*keys, "metric").pivot("system", [base, tuned]).agg(F.first("value"))
    return wide.select(
        *keys, "metric", F.col(base).alias("base"), F.col(tuned).alias("tuned"), (F.col(tuned) - F.col(base)).alias("delta")
    )


# --- answers -----------------------------------------------------------------------------


def keyword_judge(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Adds ``judge_score`` and ``judge_rationale``: share of the reference's keywords found as token or substring.

    Each step is its own projection, so no keyword list is computed twice.
    """
    e, a = F.col(expected), F.col(actual)
    out = (
        df.withColumn("_k", tx.content_keywords(e)).withColumn("_low", F.lower(a))
        # A token of the answer is also a substring of it, so one test covers both.
        .withColumn("_hit", F.filter("_k", lambda k: F.col("_low").contains(k)))
        .withColumn("_miss", F.array_except("_k", "_hit"))
    )
    n, hits = F.size("_k"), F.size("_hit")
    blank = F.when(tx.strip(a) != "", 1.0).otherwise(0.0)
    covered = F.concat(
        F.lit(fixed.JUDGE_COVERED), hits.cast("string"), F.lit("/"), n.cast("string"), F.lit(fixed.JUDGE_KEYWORDS),
        F.when(
            F.size("_miss") > 0, F.concat(F.lit(fixed.JUDGE_MISSING), F.array_join(F.slice("_miss", 1, fixed.JUDGE_LISTED), ", "), F.lit("."))
        ).otherwise(""),
    )
    return out.withColumns(
        {
            "judge_score": F.when(n == 0, blank).otherwise(F.bround(F.try_divide(hits, n), 4)),
            "judge_rationale": F.when(n == 0, F.lit(fixed.JUDGE_NO_KEYWORDS)).otherwise(covered),
        }
    ).drop("_k", "_low", "_hit", "_miss")


def sequence_ratio(expected: Column, actual: Column) -> Column:
    """Likeness of two answers by their matching blocks, on Arrow batches; for ``answer_scores``."""
    return F.pandas_udf(ratio_series, "double")(expected, actual)


def answer_scores(
    df: DataFrame, expected: str, actual: str, judge: Judge | None = keyword_judge, fuzzy: Likeness | None = None
) -> DataFrame:
    """Adds exact, score (and the judge's and ``fuzzy``'s columns).

    An exact answer, but for case and outer blanks, scores 1; any other the mean
    of the judge's score and of ``fuzzy(expected, actual)``, as far as given.
    """
    shaped = spread(df).withColumn("_e", tx.strip(F.col(expected))).withColumn("_a", tx.strip(F.col(actual)))
    if judge is not None:
        shaped = judge(shaped, "_e", "_a")
    parts = [F.col("judge_score")] if judge is not None else []
    if fuzzy is not None:
        shaped = shaped.withColumn("fuzzy", fuzzy(F.col("_e"), F.col("_a")))
        parts.append(F.col("fuzzy"))
    blended = sum(parts[1:], parts[0]) / len(parts) if parts else F.lit(0.0)
    shaped = shaped.withColumn("exact", (F.lower("_e") == F.lower("_a")) & (F.col("_e") != ""))
    return shaped.withColumn("score", F.when(F.col("exact"), 1.0).otherwise(F.bround(blended, 4))).drop("_e", "_a")
