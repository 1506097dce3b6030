"""URL filters: rules first, then naive Bayes over segmented host names and path tokens.

Host names run words together. A unigram model counted over the corpus splits
them by Viterbi search; a multinomial naive Bayes model, fitted on the urls
that the rules decide, judges the tokens of all others.

Every word of the corpus belongs to the unigram model, however rare. No task
needs all of them: a host can only be split into its own substrings, so Spark
joins the substrings of the distinct hosts with the counts, and each host is
split, once, by the words that occur in it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from brightloom.llm.common import ascii_lower, stored

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Letters of the longest word that the segmenter knows.
LONGEST_WORD = 20
#: Tokens share 2^18 counters per class, so the model's size does not depend on the corpus.
COUNTERS = 1 << 18
SMOOTHING = 1.0

_RUNS = re.compile(r"[a-z]+|[0-9]+|[^a-z0-9\W_]+")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null. A rule fits its host and subdomains when the path starts with the rule's."""
    fits = []
    for rule in sorted((r for _, r in rules), key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        on_host = (host == name) | F.endswith(host, F.lit(f".{name}"))
        fits.append(F.when(on_host & F.startswith(path, F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n): all runs of a-z (2 to 20 letters) outside tags, counted over all rows."""
    plain = F.regexp_replace(ascii_lower(F.col(f"`{column}`")), "<[^>]*>", " ")
    found = F.regexp_extract_all(plain, F.lit(rf"\b[a-z]{{2,{LONGEST_WORD}}}\b"), F.lit(0))
    return texts.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _pieces(run: Column) -> Column:
    """All substrings of 2 to 20 letters of a run of letters, each once."""
    starts = F.when(F.length(run) > 1, F.sequence(F.lit(1), F.length(run) - 1)).otherwise(F.array().cast("array<int>"))

    def ending(start: Column) -> Column:
        longest = F.least(F.lit(LONGEST_WORD), F.length(run) - start + 1)
        return F.transform(F.sequence(F.lit(2), longest), lambda k: F.substring(run, start, k))

    return F.array_distinct(F.flatten(F.transform(starts, ending)))


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``hosts(host)``, each once, with ``host_tokens``: its words, split with the counts of all words that occur in it."""
    counts = stored(counts, "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    runs = hosts.select("host", F.explode(F.array_distinct(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0)))).alias("run"))
    pieces = runs.select("host", F.explode(_pieces(F.col("run"))).alias("word"))
    # at most 19 words per letter of the host
    own = pieces.join(counts, "word").groupBy("host").agg(F.map_from_entries(F.collect_set(F.struct("word", "n"))).alias("known"))
    known = hosts.join(own, "host", "left")

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, words in batches:
            yield pd.Series([Segmenter(dict(w or {}), total).host(h) for h, w in zip(names, words, strict=True)], dtype=object)

    return known.select("host", split("host", "known").alias("host_tokens"))


class Segmenter:
    """Viterbi split of a run of letters under a unigram model; an unknown word costs more with every letter.

    ``total`` counts all words of the corpus where ``counts`` has only those that matter.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.unknown = [math.log(total) + math.log(10) * k for k in range(LONGEST_WORD + 1)]

    def split(self, run: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            low, at = math.inf, end - 1
            for start in range(max(0, end - LONGEST_WORD), end):
                c = best[start] + self.cost.get(run[start:end], self.unknown[end - start])
                if c < low:
                    low, at = c, start
            best.append(low)
            back.append(at)
        words, end = [], len(run)
        while end:
            words.append(run[back[end] : end])
            end = back[end]
        return words[::-1]

    def host(self, host: str) -> list[str]:
        """Words of a host, marked ``h:``."""
        return [f"h:{w}" for r in _RUNS.findall(host) for w in (self.split(r) if r.isascii() and r.isalpha() else [r])]


@F.pandas_udf(ArrayType(StringType()))
def path_tokens(path: pd.Series) -> pd.Series:
    """Tokens of a path, marked ``p:``."""
    return pd.Series([[f"p:{t}" for t in _RUNS.findall(p.lower())] for p in path], dtype=object)


def fit(decided: DataFrame) -> tuple[float, np.ndarray]:
    """``decided(tokens, verdict)`` -> (log prior odds of block, log odds per counter). No rows: all 0."""
    classes = {r["verdict"]: r["n"] for r in decided.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    token = decided.select("verdict", F.explode("tokens").alias("token"))
    at = (F.crc32(F.col("token").cast("binary")) % COUNTERS).cast("int").alias("at")
    counted = token.groupBy(at).agg(  # at most 2^18 rows
        F.count_if(F.col("verdict") == "block").alias("block"), F.count_if(F.col("verdict") == "allow").alias("allow")
    ).collect()
    odds, used = np.zeros((2, COUNTERS)), len(counted)
    for r in counted:
        odds[:, r["at"]] = r["block"], r["allow"]
    if not used:
        return 0.0, np.zeros(COUNTERS)
    logs = np.log(odds + SMOOTHING) - np.log(odds.sum(1, keepdims=True) + SMOOTHING * used)
    prior = math.log((classes.get("block", 0) + SMOOTHING) / (classes.get("allow", 0) + SMOOTHING))
    return prior, logs[0] - logs[1]


def log_odds(tokens: Sequence[str], prior: float, odds: np.ndarray) -> float:
    return prior + float(sum(odds[zlib.crc32(t.encode()) % COUNTERS] for t in tokens))


def judge(
    pages: DataFrame, counts: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES
) -> DataFrame:
    """Adds host, path, rule, verdict, tokens and block_odds (natural log) to every row; columns of these names are replaced.

    ``counts(word, n)`` is the corpus behind the segmenter, see :func:`word_counts`; it may be empty.

    The rule's verdict holds where a rule fits. All other urls - null, malformed
    and empty ones too, by the prior - are blocked when naive Bayes finds block
    likelier than allow. If the rules decide no url, the method allows.
    Repeated urls are judged alike and all count.
    """
    verdict = F.lit(None).cast("string")
    for said, rule in rules:
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    parsed = pages.withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))})
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("verdict", verdict)
    words = stored(host_words(parsed.select("host").distinct(), counts), "hosts")
    parsed = parsed.drop("host_tokens").join(words, "host", "left")  # one row per host; Spark splits a host that fills a partition
    parsed = parsed.withColumn("tokens", F.concat("host_tokens", path_tokens("path"))).drop("host_tokens")
    prior, odds = fit(parsed.where("rule is not null").select("tokens", "verdict"))
    shared = pages.sparkSession.sparkContext.broadcast(odds)  # 2^18 numbers

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([log_odds(tokens, prior, shared.value) for tokens in batch], dtype=float)

    scored = parsed.withColumn("block_odds", weigh("tokens"))
    method = F.when(F.col("block_odds") > 0, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("verdict", method))
