"""Ranked lexical search by NRA: sequential, impact-sorted reads with lower and upper bounds, no random access.

Documents are counted once: each keeps its number of terms and the query terms it
holds. Global numbers (documents, terms, documents per term) then fix every
posting's exact integer share of a score. Documents are searched in shards of a
bounded number of postings, many in one task: the lists of a shard, each by falling
share, are read from their tops down to a falling limit. What has been read gives
every document a lower bound, the tops of the unread parts an upper one. Documents
that cannot reach the k-th best lower bound, of this shard or of the task so far,
are out; reading ends when no other has a gap between its bounds. Then membership,
ties and scores are all certain. Only a task's k best per item leave it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from brightloom.llm.common import Workspace, ascii_lower, picked, stored

#: Terms are maximal runs of ASCII letters, digits and non-ASCII characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: (item, term) rows of one block of items, the only data that is sent to all tasks.
BLOCK_TERMS = 1 << 18
#: Postings and documents of one shard.
SHARD_POSTINGS, SHARD_DOCS = 1 << 21, 1 << 14
#: Every round reads down to this part of the limit before.
FALL = 0.6
# Bytes of terms lower-cased, all others as blanks.
_BYTES = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a whole UTF-8 text, with repeats, A-Z lower-cased."""
    return raw.translate(_BYTES).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def shares(weights: np.ndarray, tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """What each posting adds to a score, for documents of ``size`` terms, in 64-bit integers."""
    m = 10 + (90 * size * n) // max(total, 1)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


@dataclass
class Block:
    """Items searched together: ids, the terms' numbers, and each item's distinct terms by number."""

    ids: pa.Array
    numbers: dict[bytes, int]
    wanted: list[np.ndarray]


def _block(pairs: DataFrame) -> Block:
    held = pairs.toArrow()  # at most about BLOCK_TERMS rows
    words, ids = held["term"].combine_chunks().dictionary_encode(), held["item_id"].combine_chunks()
    numbers = {w.encode(): i for i, w in enumerate(words.dictionary.to_pylist())}
    term, item = words.indices.to_numpy(), ids.dictionary_encode("encode")
    order = np.argsort(item.indices.to_numpy(), kind="stable")
    counts = np.bincount(item.indices.to_numpy(), minlength=len(item.dictionary))
    return Block(item.dictionary, numbers, np.split(term[order], np.cumsum(counts)[:-1]))


def _counted(docs: DataFrame, block) -> DataFrame:
    """(doc_id, n, held, tf): terms of each document that has any; which of the block's terms it holds, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block.value.numbers
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                rows, sizes, held, tf = [], [], [], []
                for row, raw in enumerate(part["text"].cast(pa.binary())):
                    found = terms(raw.as_py() or b"")
                    if found:
                        known = [(numbers[t], c) for t, c in Counter(found).items() if t in numbers]
                        rows.append(row)
                        sizes.append(len(found))
                        held.append([t for t, _ in known])
                        tf.append([c for _, c in known])
                lists = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(held, lists), pa.array(tf, lists)],
                    ["doc_id", "n", "held", "tf"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, held array<int>, tf array<int>")


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, postings read) of all among ``size`` documents that may be in the first ``k``, and score ``floor`` or more.

    A list holds documents, each once, and their shares, the largest first. Documents of equal score stay together.
    """
    lists = [x for x in lists if len(x[0])]
    lower, depth = np.zeros(size, np.int64), [0] * len(lists)
    limit = max((int(share[0]) for _, share in lists), default=0)
    while True:
        limit = int(limit * FALL)
        bounds = []
        for i, (docs, share) in enumerate(lists):
            end = len(share) - int(np.searchsorted(share[::-1], limit, side="left"))
            read = slice(depth[i], end)
            lower[docs[read]] += share[read]
            depth[i] = max(end, depth[i])
            bounds.append(int(share[end]) if end < len(share) else 0)
        gap = np.full(size, sum(bounds), np.int64)
        for (docs, _), end, bound in zip(lists, depth, bounds, strict=True):
            if bound:
                gap[docs[:end]] -= bound
        kth = int(np.partition(lower, size - k)[size - k]) if size >= k else 0
        live = np.flatnonzero(lower + gap >= max(kth, floor, 1))
        if not gap[live].any():
            return live, lower[live], sum(depth)


class _Best:
    """The first ``k`` of one item so far, by score, then id."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.k else 0

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows = sorted([*self.rows, *((-s, i is None, i if i is not None else 0) for s, i in zip(scores.tolist(), ids, strict=True))])[: self.k]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of several batches, up to a shard's number of documents and postings; a document is never split."""
    held, postings = [], 0
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            more = len(part["held"].flatten())
            if held and (postings + more > SHARD_POSTINGS or sum(p.num_rows for p in held) + part.num_rows > SHARD_DOCS):
                yield pa.Table.from_batches(held)
                held, postings = [], 0
            held.append(part)
            postings += more
    if held:
        yield pa.Table.from_batches(held)


def _searched(counted: DataFrame, block, weights, n: int, total: int, k: int, item_type: str) -> DataFrame:
    """(item_id, doc_id, score): the k best of every task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, schema = [_Best(k) for _ in block.value.wanted], None
        for shard in _shards(batches):
            ids, schema = shard["doc_id"].combine_chunks(), shard.schema.field("doc_id").type
            place = np.empty(len(ids), np.int64)
            place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            held = shard["held"].combine_chunks()
            term, tf = held.flatten().to_numpy(), shard["tf"].combine_chunks().flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), held.value_lengths().to_numpy())
            size = shard["n"].to_numpy()[doc]
            share = shares(weights.value[term], tf, size, n, total)
            order = np.lexsort((-share, term))
            doc, share = doc[order], share[order]
            edges = np.searchsorted(term[order], np.arange(len(weights.value) + 1))
            for item, wanted in enumerate(block.value.wanted):
                lists = [(doc[edges[t] : edges[t + 1]], share[edges[t] : edges[t + 1]]) for t in wanted]
                found, scores, _ = nra(lists, len(ids), k, best[item].floor)
                first = np.lexsort((place[found], -scores))[:k]
                best[item].add(scores[first], ids.take(pa.array(found[first])).to_pylist())
        if schema is not None:
            rows = [(item, None if missing else i, -score) for item, b in enumerate(best) for score, missing, i in b.rows]
            items, docs, scores = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [block.value.ids.take(pa.array(items, pa.int64())), pa.array(docs, schema), pa.array(scores, pa.int64())],
                ["item_id", "doc_id", "score"],
            )

    doc_type = counted.schema["doc_id"].dataType.simpleString()
    return counted.mapInArrow(run, f"item_id {item_type}, doc_id {doc_type}, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of ``items(item_id, text)``."""
    found = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """For every item the ``k`` documents of highest score above 0: item_id, rank (from 1), doc_id, score.

    Equal scores rank by ascending doc_id, null ids last; rows that also share
    that id are told apart arbitrarily. Every row of ``docs`` is a document of
    its own; rows of ``items`` with the same id are one item with all their
    terms. Null texts, and texts without terms, match nothing and do not count
    as documents. Extra columns are ignored; empty tables give no rows. Items
    are searched in blocks of about BLOCK_TERMS terms, each against all documents.
    """
    spark = docs.sparkSession
    docs = picked(docs, doc_id=doc_id, text=text)
    items = picked(items, item_id=item_id, text=item_text)
    item_type = items.schema["item_id"].dataType.simpleString()
    with Workspace(spark, "nra") as tables:
        pairs = tables.stored(item_terms(items), "items")
        blocks = -(-pairs.count() // BLOCK_TERMS)
        found = [
            stored(_search_block(tables, docs, pairs.where(F.expr(f"pmod(xxhash64(item_id), {blocks})") == b), k, item_type), "ranked")
            for b in range(blocks)
        ]
    empty = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    return reduce(DataFrame.unionByName, found) if found else empty


def _search_block(tables: Workspace, docs: DataFrame, pairs: DataFrame, k: int, item_type: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    block = _block(pairs)
    shared = context.broadcast(block)
    counted = tables.stored(_counted(docs, shared), "counted")
    n, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    per_term = counted.select(F.explode("held").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(len(block.numbers), np.int64)
    for row in per_term.collect():  # a row per term of the block at most
        weights[row["term"]] = weight(n, row["df"])
    best = _searched(counted, shared, context.broadcast(weights), n, total, k, item_type)
    first = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
