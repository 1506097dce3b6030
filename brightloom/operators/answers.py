"""From ranked passages to cited answers, findings, rubric scores and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightloom.functions import fixed, text as tx


def best_sentences(passage: Column, terms: Column, n: int = 2) -> Column:
    """Up to ``n`` sentences sharing most distinct terms, in text order; else the first sentence."""
    parts = F.transform(tx.sentences(passage), tx.squeeze)
    scored = F.transform(
        parts,
        lambda s, i: F.struct(
            (-F.size(F.array_intersect(terms, tx.tokens(s)))).alias("neg"), i.alias("pos"), s.alias("sentence")
        ),
    )
    picked = F.filter(F.slice(F.array_sort(scored), 1, n), lambda s: s["neg"] < 0)
    in_order = F.array_sort(F.transform(picked, lambda s: F.struct(s["pos"], s["sentence"])))
    joined = F.array_join(F.transform(in_order, lambda s: s["sentence"]), " ")
    return (
        F.when(F.size(parts) == 0, tx.strip(passage))
        .when(F.size(picked) == 0, F.element_at(parts, 1))
        .otherwise(joined)
    )


def _per_query(df: DataFrame, piece: Column, glue: str, name: str) -> DataFrame:
    """Join a query's pieces in rank order (a query has at most the retrieved k)."""
    grouped = df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", piece.alias("piece")))).alias("p"))
    return grouped.select("query_id", F.array_join(F.transform("p", lambda x: x["piece"]), glue).alias(name))


def extractive_answers(queries: DataFrame, hits: DataFrame, passages: DataFrame, max_sentences: int = 2) -> DataFrame:
    """(query_id, answer): one cited extract per passage; a fixed sentence when nothing was found.

    ``hits`` is a ranking, ``passages`` (item_id, text). Marker [i] is rank i.
    """
    terms = queries.select("query_id", tx.distinct_terms(F.col("text"), fixed.ANSWER_STOP_WORDS).alias("_terms"))
    joined = hits.select("query_id", "item_id", "rank").join(passages, "item_id").join(terms, "query_id")
    piece = F.concat(best_sentences(F.col("text"), F.col("_terms"), max_sentences), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    found = _per_query(joined, piece, "\n", "answer")
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("answer", F.lit(fixed.NO_CONTEXT_ANSWER)).alias("answer")
    )


def context_blocks(queries: DataFrame, hits: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, context): numbered sources in rank order; ``passages`` is (item_id, source, text)."""
    joined = hits.select("query_id", "item_id", "rank").join(passages, "item_id")
    piece = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (source: "), F.col("source"), F.lit(") "), F.col("text"))
    found = _per_query(joined, piece, "\n\n", "context")
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit(fixed.NO_SOURCES)).alias("context")
    )


def citation_numbers(hits: DataFrame) -> DataFrame:
    """(report_id, url, citation): URLs numbered by first appearance over (question_no, rank).

    ``hits`` is (report_id, question_no, rank, url). Each URL shrinks to its
    first place before the ranking; a report ranks its own URLs only.
    """
    first = hits.groupBy("report_id", "url").agg(F.min(F.struct("question_no", "rank")).alias("first"))
    order = Window.partitionBy("report_id").orderBy("first")
    return first.select("report_id", "url", F.row_number().over(order).alias("citation"))


def findings(questions: DataFrame, hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Answer of every sub-question from the snippets it retrieved.

    ``questions`` (query_id, report_id, question_no), ``hits`` a ranking,
    ``sources`` (item_id, title, url, body).
    """
    found = hits.select("query_id", "item_id", "rank").join(questions, "query_id").join(
        sources.select("item_id", "url", tx.snippet(F.col("body")).alias("snippet")), "item_id"
    )
    numbers = citation_numbers(found.select("report_id", "question_no", "rank", "url"))
    cited = found.join(numbers, ["report_id", "url"]).where(F.col("snippet") != "")
    piece = F.concat(
        F.rtrim(tx.first_sentence(F.col("snippet")), F.lit(".")), F.lit(" ["), F.col("citation").cast("string"), F.lit("].")
    )
    answers = _per_query(cited, piece, " ", "answer")
    return questions.join(answers, "query_id", "left").withColumn(
        "answer", F.coalesce("answer", F.lit(fixed.NO_ANSWER))
    )


def references(citations: DataFrame, titles: DataFrame) -> DataFrame:
    """Numbered reference lines (report_id, citation, line); ``titles`` is (url, title)."""
    return citations.join(titles, "url").select(
        "report_id", "citation",
        F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), F.col("title"), F.lit(" - "), F.col("url")).alias("line"),
    )


def rubric_score(
    df: DataFrame, text: str, rubric: Sequence[tuple[str, int, int, str]] = fixed.REPORT_RUBRIC,
    min_chars: int = fixed.REPORT_MIN_CHARS, brief: tuple[int, str] = (fixed.REPORT_BRIEF_WEIGHT, fixed.REPORT_BRIEF_ISSUE),
) -> DataFrame:
    """Adds ``score`` (10 minus the weights of failed checks, at least 0) and ``issues``.

    A rubric row is (pattern, least number of hits, weight, issue).
    """
    checks = [
        (F.regexp_count(F.col(text), F.lit(pattern)) < hits, weight, issue) for pattern, hits, weight, issue in rubric
    ]
    checks.append((F.length(text) < min_chars, *brief))
    lost = sum((F.when(failed, weight).otherwise(0) for failed, weight, _ in checks), F.lit(0))
    issues = F.filter(F.array(*[F.when(failed, F.lit(issue)) for failed, _, issue in checks]), lambda i: i.isNotNull())
    return df.withColumns({"score": F.greatest(F.lit(0), F.lit(10) - lost), "issues": issues})


def section_digest(df: DataFrame, row_id: str, section_bodies: Column) -> DataFrame:
    """(row_id, digest): the first sentence of each non-blank section as a bullet."""
    bullets = F.transform(
        F.filter(F.transform(section_bodies, tx.squeeze), lambda b: b != ""),
        lambda b: F.concat(F.lit("- "), tx.first_sentence(b)),
    )
    return df.select(row_id, F.when(F.size(bullets) > 0, F.array_join(bullets, "\n")).otherwise(F.lit(fixed.NO_FINDINGS)).alias("digest"))
