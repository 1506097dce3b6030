"""N-gram Jaccard join: prefix filters under several global token orders, intersected before exact verification.

A document is its set of distinct word n-grams, as 64-bit hashes. Under any
global order of the n-grams, two sets similar enough share one among their first
few. Candidates come from the first order; they must also share a prefix n-gram
under every other order, and only then are the whole sets compared.

An order puts the most frequent n-grams last, so common passages do not make
candidates. Which of them are known to be frequent decides speed, never results.

Equal sets are one node. A posting list of any size is handled without listing
its pairs: first every node is compared with one pivot, which joins up families
of near copies; then only pairs from different components are compared. That
finds every link that matters for the components.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from brightloom.llm.common import most_frequent, stored, unused
from brightloom.llm.components import components

#: Size of the order's table of frequent n-grams and the document count from which one is listed.
ORDER_TERMS, ORDER_MIN = 1 << 18, 8
#: Documents of a frequent n-gram that share one pivot.
PIVOT_SPAN = 4096
#: Rounds in which families try to merge before pairs between them are listed, and pairs each tries a round. A round is worth
#: its passes over the postings only while there are more pairs to list than so many a posting; results do not depend on it.
MERGE_ROUNDS, TRIALS, PAIRS_A_POSTING = 2, 8, 8
BATCH_ROWS = 256
#: N-grams kept beyond a short prefix, so that a few frequent ones can be passed over.
SPARE = 16
#: Odd sketches, four 64-bit words a set, that thin out the pairs of different families.
_SKETCH = [f"s{i}" for i in range(4)]
#: Bits of the table that tells which documents' texts are fetched.
SIEVE_BITS = 1 << 20
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(seed | 1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: Hash of each letter in each of the first 64 places of a word; a word's hash sums those of its letters.
_PLACES = 64
_LETTERS = _mixed(np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(1), _SEEDS[1])
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word of a whole text, in order, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    inside = ~_BLANK[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    letters = raw[inside]
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(offsets.astype(np.int32), lengths)
    if lengths.max() <= _PLACES:
        hashed = _LETTERS.take((place << 8) + letters)
    else:
        hashed = _mixed(((place.astype(np.int64) << 8) + letters + 1).astype(np.uint64), _SEEDS[1])
    return _mixed(np.add.reduceat(hashed, offsets) ^ lengths.astype(np.uint64), _SEEDS[2])


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word runs of a whole text; all words as one run if fewer."""
    codes = word_hashes(text)
    if not len(codes):
        return codes
    width = min(width, len(codes))
    runs = np.full(len(codes) - width + 1, width, np.uint64)
    for i in range(width):
        runs = _mixed(runs ^ codes[i : len(codes) - width + 1 + i], _SEEDS[0])
    runs.sort()
    return runs[np.concatenate(([True], runs[1:] != runs[:-1]))]


def node_of(items: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(items.tobytes(), seed=len(items) & 0xFFFFFFFF) - (1 << 63)


def odd_sketches(sets: list[np.ndarray], words: int) -> np.ndarray:
    """(sets, words) numbers: bit h of a sketch is set where an odd number of hashes end in h.

    Two sketches differ in no more bits than one of the sets has hashes that the other has not.
    """
    bits = 64 * words
    places = [i * bits + (s & np.uint64(bits - 1)).astype(np.int64) for i, s in enumerate(sets)]
    odd = np.bincount(np.concatenate([np.zeros(0, np.int64), *places]), minlength=len(sets) * bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(sets), words)


def odd_filter(percent: int, names: Sequence[str]) -> Column:
    """True for every pair of sides a and b that links, by sizes and odd sketches; columns end in ``_a`` or ``_b``."""
    bits = reduce(Column.__add__, [F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in names])
    return (100 + percent) * bits <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


class Order:
    """Frequent n-grams last, by the bits of their document count; all others by hash."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray):
        self.terms, self.counts = terms, counts

    def counted(self, items: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(len(items), np.int64)
        at = np.minimum(np.searchsorted(self.terms, items), len(self.terms) - 1)
        return np.where(self.terms[at] == items, self.counts[at], 0)

    def prefix(self, items: np.ndarray, counted: np.ndarray, k: int, length: int) -> np.ndarray:
        """Places of the first ``length`` items in the ``k``-th order."""
        level = np.ceil(np.log2(counted + 1)).astype(np.uint8)
        keys = items if k == 0 else _mixed(items, _SEEDS[k])
        return np.lexsort((keys, level))[:length]


def _need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows: what a task holds of its texts' n-grams at a time."""
    return (batch.slice(start, rows) for batch in batches for start in range(0, batch.num_rows, rows))


def _prefix_lengths(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes - -(-percent * sizes // 100) + 1


def _keyed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, spot, node, n, sketch, low) of every row, and on one row of each slice (terms, counts).

    ``spot``, the text's hash, finds the texts that have no id. ``low`` has the
    n-grams of a set that come first by hash, 1.6 times as many as its prefix,
    once per task that meets the set. ``terms`` are the n-grams that recur among
    the documents of a slice, with the number of sets that hold them but not in
    their ``low``: common passages. Copies within a slice count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for part in _parts(batches, 8 * BATCH_ROWS):
            nodes, sizes, low, sets, odd = [], [], [], {}, []
            for t in part["text"]:
                items = shingles(t.as_py(), width)
                odd.append(odd_sketches([items], len(_SKETCH))[0])
                node = node_of(items) if len(items) else None
                nodes.append(node)
                sizes.append(len(items))
                if node is None or node in met:
                    low.append(None)
                    continue
                if len(met) >= 1_000_000:
                    met.clear()
                met.add(node)
                length = int(_prefix_lengths(np.int64(len(items)), percent))
                low.append(_long(items[: max(8 * length // 5, length + SPARE)]))
                sets[node] = items
            terms, counts = _counted([*sets.values()])
            terms, counts = terms[counts > 1], counts[counts > 1]
            held, lows = _counted([x.view(np.uint64) for x in low if x is not None])
            if len(held):
                at = np.minimum(np.searchsorted(held, terms), len(held) - 1)
                counts = counts - np.where(held[at] == terms, lows[at], 0)
            rest = [None] * (part.num_rows - 1)
            yield pa.RecordBatch.from_arrays([
                part["doc_id"], part["spot"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                *(pa.array(column) for column in np.ascontiguousarray(np.array(odd).T)), pa.array(low, pa.list_(pa.int64())),
                pa.array([_long(terms[counts > 0]), *rest], pa.list_(pa.int64())),
                pa.array([counts[counts > 0].astype(np.int32), *rest], pa.list_(pa.int32())),
            ], ["doc_id", "spot", "node", "n", *_SKETCH, "low", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = ", ".join(f"{c} long" for c in _SKETCH)
    return docs.select("doc_id", "text", _spot().alias("spot")).mapInArrow(
        run, f"doc_id {kind}, spot long, node long, n long, {sketch}, low array<long>, terms array<long>, counts array<int>"
    )


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of all sets, sorted, and how many sets hold each."""
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    every.sort()
    starts = np.flatnonzero(np.diff(every, prepend=every[:1] + np.uint64(1)))
    return every[starts], np.diff(starts, append=len(every))


def _spot() -> Column:
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def _order(keys: DataFrame) -> Order:
    """The most frequent n-grams of the whole corpus make the order."""
    each = keys.where("low is not null").select(F.explode("low").alias("term"), F.lit(1).alias("n"))
    more = keys.where("terms is not null").select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n"))))
    counted = each.unionByName(more).groupBy("term").agg(F.sum("n").alias("n"))
    top = most_frequent(stored(counted.where(F.col("n") >= ORDER_MIN), "frequent"), ORDER_TERMS).toArrow()
    terms = top["term"].to_numpy().astype(np.int64).view(np.uint64)
    sort = np.argsort(terms)
    return Order(terms[sort], top["n"].to_numpy().astype(np.int64)[sort])


_POSTING = ["term", "part", "node", "n", "place"]
_POSTING_TYPES = "term long, part int, node long, n int, place int"


def _postings(docs: DataFrame, keys: DataFrame, width: int, percent: int, shared) -> DataFrame:
    """(term, part, node, n, place): the prefix of every node in the first order, once per task that meets the node.

    The order begins with the n-grams that are not listed as frequent, by hash;
    so a prefix is taken from ``low``, unless too many there are listed. Only
    such texts are cut into n-grams again, with a few others, whose postings
    repeat what ``low`` gave.
    """

    def free(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """The n-grams of ``low``, their rows, ranks among the unlisted ones of their row, and the rows' sizes and prefix lengths."""
        low = batch["low"]
        lengths, sizes = low.value_lengths().to_numpy(), batch["n"].to_numpy()
        terms = low.flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        unlisted = shared.value.counted(terms) == 0
        upto = np.concatenate(([0], np.cumsum(unlisted)))
        ends = np.cumsum(lengths)
        found = upto[ends] - upto[ends - lengths]
        prefix = _prefix_lengths(sizes, percent)
        rank = np.where(unlisted, upto[1:] - np.repeat(upto[ends - lengths], lengths), 0)
        return terms, row, rank, sizes, prefix, found >= prefix

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, BATCH_ROWS):
            terms, row, rank, sizes, prefix, enough = free(batch)
            taken = (rank > 0) & (rank <= prefix[row]) & enough[row]
            row = row[taken]
            yield pa.RecordBatch.from_arrays([
                pa.array(_long(terms[taken])), pa.array(np.zeros(len(row), np.int32)), pa.array(batch["node"].to_numpy()[row]),
                pa.array(sizes[row].astype(np.int32)), pa.array(rank[taken].astype(np.int32)),
            ], _POSTING)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([batch["at"].filter(pa.array(~free(batch)[-1]))], ["at"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, met = shared.value, set()
        for batch in _parts(batches, BATCH_ROWS):
            terms, parts, nodes, sizes, lengths = [], [], [], [], []
            for t in batch["text"]:
                items = shingles(t.as_py(), width)
                node = node_of(items) if len(items) else None
                if node is None or node in met:
                    continue
                if len(met) >= 1_000_000:
                    met.clear()
                met.add(node)
                counted = order.counted(items)
                first = order.prefix(items, counted, 0, len(items) - _need(len(items), percent) + 1)
                terms.append(items[first])
                split = 1 + counted[first] // PIVOT_SPAN
                parts.append(np.where(split > 1, 1 + (node >> 7) % split, 0))
                nodes.append(node)
                sizes.append(len(items))
                lengths.append(len(first))
            lengths = np.asarray(lengths, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(_long(np.concatenate(terms or [np.zeros(0, np.uint64)]))),
                pa.array(np.concatenate(parts or [np.zeros(0)]).astype(np.int32)),
                pa.array(np.repeat(np.asarray(nodes, np.int64), lengths)),
                pa.array(np.repeat(np.asarray(sizes, np.int32), lengths)),
                pa.array((np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1).astype(np.int32)),
            ], _POSTING)

    at = F.when(F.col("doc_id").isNull(), F.col("spot")).otherwise(F.xxhash64("doc_id"))
    lows = keys.where("low is not null")
    again = stored(lows.select(at.alias("at"), "n", "low").mapInArrow(short, "at long"), "again")
    texts = docs.withColumn("spot", _spot()).select("text", at.alias("at")).where(_sieve(again, "at")).select("text")
    return lows.select("node", "n", "low").mapInArrow(first, _POSTING_TYPES).unionByName(texts.mapInArrow(whole, _POSTING_TYPES))


def _sieve(chosen: DataFrame, key: str = "doc_id") -> Column:
    """True for every chosen ``key`` and for few others, by a bit table of fixed size: spares most texts the shuffle of a join."""
    spot = f"pmod(xxhash64({key}), {SIEVE_BITS})"
    held = chosen.groupBy(F.expr(f"cast({spot} div 64 as int)").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({spot} % 64 as int))")).alias("bits")
    )
    table = [0] * (SIEVE_BITS // 64)  # so many numbers reach the driver at most
    for row in held.collect():
        table[row["word"]] = row["bits"]
    bits = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    word = F.get(bits, F.expr(f"cast({spot} div 64 as int)")).alias("word")
    return F.when(F.col(key).isNotNull(), F.getbit(word, F.expr(f"cast({spot} % 64 as int)")) == 1)


def _sets(docs: DataFrame, chosen: DataFrame, width: int, percent: int, shared) -> DataFrame:
    """(node, items, others): the whole set of each chosen node and its prefixes in the other orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in _parts(batches, BATCH_ROWS):
            rows = []
            for t, node in zip(batch["text"], batch["node"].to_pylist(), strict=True):
                items = shingles(t.as_py(), width)
                if len(items) and node_of(items) == node:
                    counted, p = order.counted(items), len(items) - _need(len(items), percent) + 1
                    rows.append((node, _long(items), [_long(items[order.prefix(items, counted, k, p)]) for k in range(1, len(_SEEDS))]))
            node, items, others = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([
                pa.array(node, pa.int64()), pa.array(items, pa.list_(pa.int64())),
                pa.array(others, pa.list_(pa.list_(pa.int64()))),
            ], ["node", "items", "others"])

    texts = docs.where(_sieve(chosen)).join(chosen, "doc_id").select("text", "node")
    nameless = chosen.where("doc_id is null").select("spot", "node")
    if not nameless.isEmpty():  # copies without id are told from no other, so one of each text goes on
        spots = docs.where("doc_id is null").withColumn("spot", _spot())
        once = spots.where(_sieve(nameless, "spot")).dropDuplicates(["spot", "text"])
        texts = texts.unionByName(once.join(nameless, "spot").select("text", "node"))
    return texts.mapInArrow(run, "node long, items array<long>, others array<array<long>>").dropDuplicates(["node"])


def _side(held: DataFrame, s: str, *more: str) -> DataFrame:
    names = {"node": s} | {c: f"{c}_{s}" for c in ("n", "place", *more)}
    return held.select("term", *[F.col(c).alias(to) for c, to in names.items()])


def _up(value: str, by: int) -> Column:
    """Whole-number division, rounded up."""
    return F.expr(f"({value} + {by - 1}) div {by}")


def _common(percent: int) -> Column:
    """Fewest n-grams that sets of n_a and n_b have in common if they link."""
    return _up(f"{percent} * (n_a + n_b)", 100 + percent)


def _early(percent: int) -> Column:
    """Can this place hold the first n-gram in common with a set of the same size or a larger one?"""
    return F.col("place") <= F.col("n") - _up(f"{2 * percent} * n", 100 + percent) + 1


def _promising(met: DataFrame, percent: int) -> DataFrame:
    """``met(a, b, n_a, n_b, place_a, place_b)``, a row per prefix n-gram that both hold -> the pairs that may link.

    What both have beyond their last common prefix n-gram lies behind it in both
    sets; and behind the end of the prefix that ends first nothing is counted yet.
    """
    pairs = met.groupBy("a", "b", "n_a", "n_b").agg(
        F.count(F.lit(1)).alias("c"), F.max("place_a").alias("place_a"), F.max("place_b").alias("place_b")
    )
    needed = _common(percent)
    beyond_last = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    beyond_prefix = _up(f"{percent} * greatest(n_a, n_b)", 100) - 1
    return pairs.where(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (F.col("c") + F.least(beyond_last, beyond_prefix) >= needed)
    ).select("a", "b")


def _promising_of(pairs: DataFrame, cards: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link: by sizes and odd sketches first, then by the prefix n-grams that both hold."""
    side = lambda s: cards.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", *_SKETCH)])
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    alike = pairs.join(side("a"), "a").join(side("b"), "b").where(sizes & odd_filter(percent, _SKETCH)).select("a", "b")
    alike = stored(alike, "alike")
    return _promising(alike.join(_side(postings, "a"), "a").join(_side(postings, "b"), ["term", "b"]), percent)


def _linked(docs: DataFrame, members: DataFrame, pairs: DataFrame, width: int, percent: int, shared) -> DataFrame:
    """The pairs (a, b) that pass the filter of every other order and whose whole sets are similar enough."""
    pairs = stored(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stored(_sets(docs, stored(nodes.join(members, "node"), "chosen"), width, percent, shared), "sets")

    def side(s: str) -> DataFrame:
        return sets.select(F.col("node").alias(s), F.col("items").alias(f"items_{s}"), F.col("others").alias(f"others_{s}"))

    overlaps = [F.arrays_overlap(F.col("others_a")[k], F.col("others_b")[k]) for k in range(len(_SEEDS) - 1)]
    both = F.size(F.array_intersect("items_a", "items_b"))
    similar = 100 * both >= percent * (F.size("items_a") + F.size("items_b") - both)
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    for passed in (*overlaps, similar):
        joined = joined.where(passed)
    return joined.select("a", "b")


def _labelled(postings: DataFrame, families: DataFrame) -> DataFrame:
    return stored(postings.join(families, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")


def _mixed_terms(labelled: DataFrame) -> DataFrame:
    """(term, pairs): the n-grams that several families hold, and the pairs of nodes from different ones."""
    m = F.col("m").cast("double")
    each = labelled.groupBy("term", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("term")
    found = each.agg(F.count(F.lit(1)).alias("k"), ((F.sum(m) * F.sum(m) - F.sum(m * m)) / 2).alias("pairs"))
    return stored(found.where("k > 1").select("term", "pairs"), "mixed")


def _trials(labelled: DataFrame) -> DataFrame:
    """(a, b): for every family a few pairs of one of its sets with one of the largest family met under the same n-gram."""
    spread_ = F.xxhash64("term", "node")  # another member under every n-gram
    groups = labelled.groupBy("term", "root").agg(F.min_by("node", spread_).alias("rep"), F.count(F.lit(1)).alias("m"))
    tops = groups.groupBy("term").agg(F.max(F.struct("m", "root", "rep")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
    met = groups.join(tops, "term").where("root <> top.root").groupBy("root", F.col("rep").alias("a"), F.col("top.rep").alias("b"))
    first = Window.partitionBy("root").orderBy(F.desc("c"), F.xxhash64("a", "b"))
    return met.agg(F.count(F.lit(1)).alias("c")).withColumn("nth", F.row_number().over(first)).where(
        F.col("nth") <= TRIALS
    ).select("a", "b")


def classify(
    docs: DataFrame, width: int = 4, percent: int = 85, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets. Null texts and texts without words have an empty set and link with
    nothing: their component is their own id. Texts below ``width`` words are
    one n-gram of all their words. Rows with equal sets link, whatever their
    ids; rows with a null id have a component too, if another member has an id.
    Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    keys = stored(_keyed(docs, width, percent), "keys")
    shared = spark.sparkContext.broadcast(_order(keys))  # at most ORDER_TERMS entries
    # n-grams in one node's prefix only find nothing; a frequent one has a pivot per part, and the parts' pivots meet again
    spot = Window.partitionBy("term", "part")
    postings = _postings(docs, keys, width, percent, shared).withColumns({
        "pivot": F.min("node").over(spot), "last": F.max("node").over(spot)
    })
    held = stored(
        postings.where((F.col("pivot") != F.col("last")) | (F.col("part") > 0)).drop("last").dropDuplicates(["term", "part", "node"]),
        "postings",
    )
    tops = held.select("term", "pivot").distinct().withColumn("top", F.min("pivot").over(Window.partitionBy("term")))
    near = held.select("node", "pivot").unionByName(tops.select(F.col("pivot").alias("node"), F.col("top").alias("pivot")))
    counts = near.where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("shared"))
    best = counts.groupBy("node").agg(F.max(F.struct("shared", "pivot"))["pivot"].alias("pivot"))
    stars = stored(best.select(F.col("node").alias("a"), F.col("pivot").alias("b")), "stars")

    members = keys.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("spot").alias("spot"))
    postings = held.select("term", "node", "n", "place")  # a node has one part of a term
    sketches = keys.where("node is not null").groupBy("node").agg(*[F.min(c).alias(c) for c in ("n", *_SKETCH)])
    cards = stored(sketches.join(held.select("node").distinct(), "node", "left_semi"), "cards")
    near_links = _linked(docs, members, _promising_of(stars, cards, postings, percent), width, percent, shared)
    first = stored(components(near_links, "families"), "families")

    # A few more pivots, where pairs are many: a family or lone set tries members of the largest family it shares n-grams with.
    labelled = _labelled(postings, first)
    mixed = _mixed_terms(labelled)
    for _ in range(MERGE_ROUNDS):
        if (mixed.agg(F.sum("pairs")).first()[0] or 0) <= PAIRS_A_POSTING * labelled.count():
            break
        more = _linked(docs, members, _promising_of(_trials(labelled), cards, postings, percent), width, percent, shared)
        old = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
        first = stored(components(more.unionByName(old), "families"), "families")
        labelled = _labelled(postings, first)
        mixed = _mixed_terms(labelled)

    # Every candidate pair from different families; terms of one family only have none.
    open_ = stored(labelled.join(mixed.select("term"), "term").join(cards.drop("n"), "node"), "open")
    # of two sets that link, the smaller one holds the first common n-gram early; so does the other, as its size allows
    x, y = _side(open_.where(_early(percent)), "a", "root", *_SKETCH), _side(open_, "b", "root", *_SKETCH)
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    spare = lambda s: F.col(f"place_{s}") <= F.col(f"n_{s}") - _common(percent) + 1
    cross = x.join(y, "term").where(
        smaller & (F.col("root_a") != F.col("root_b")) & (100 * F.col("n_a") >= percent * F.col("n_b")) & spare("a") & spare("b")
        & odd_filter(percent, _SKETCH)
    )
    pairs = cross.select("a", "b").distinct()
    met = pairs.join(_side(postings, "a"), "a").join(_side(postings, "b"), ["term", "b"])
    late = _linked(docs, members, _promising(met, percent), width, percent, shared)
    root = components(
        late.unionByName(first.select(F.col("node").alias("a"), F.col("root").alias("b"))), "components"
    )

    nodes = members.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id")
    smallest = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = stored(nodes.join(smallest, "root").select("node", "component_id"), "named")
    return keys.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, of which one per component stays: the one with the smallest id.

    Rows that share that id stay together; rows without id and rows without words all stay.
    """
    gone = unused(docs, "_gone")
    found = classify(docs, width, percent, text, doc_id)
    dropped = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "near-copies")
    return docs.join(dropped, docs[doc_id] == dropped[gone], "left_anti")
