"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles is reduced to 48 minima of 8 bits. The
signature is split into 8 chunks of 6 minima. By the pigeonhole principle two
signatures that differ in at most 15 places differ in at most one place of some
chunk; so every chunk is indexed once for each place that may differ, with that
place left out, and all pairs within the distance meet under one of the 48 keys.
Links are confirmed on the full sets.

How sure that is: each place differs with probability (1 - similarity) * 255/256.
At a similarity of 0.85 that is 7.2 places of 48 on average, more than 15 in one
pair of 2,000; and such a pair still meets unless all chunks differ twice: six
pairs in a million meet under no key (at 0.8: two in ten thousand). Documents
with equal sets always link.

Candidates are cut down by an odd sketch, 1,024 bits that tell whether an even or
odd number of a set's shingles hashes to each: two sketches differ in no more
bits than the sets differ in shingles, so no link is lost. Links are then
confirmed on the full sets.

Equal sets are one node. No group under a key is expanded into its links: nodes
are first compared with the nearest of the hubs under their keys, the nodes that
share most keys with others, then families try each other's
hubs; only nodes under one key that are then still in different families are
compared with each other, all of them, sketches inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brightloom.llm.common import Workspace, picked, stored
from brightloom.llm.components import components
from brightloom.llm.jaccard import node_of, odd_filter, odd_sketches, shingles

#: A signature has CHUNKS x PLACES minima of 8 bits; one place of a chunk may differ.
CHUNKS, PLACES = 8, 6
#: All pairs of signatures that differ in at most so many places meet.
GUARANTEED = 2 * CHUNKS - 1
#: 64-bit words of an odd sketch.
SKETCH_WORDS = 16
BATCH_ROWS = 256
#: Bits of the table by which sets that meet no others are left out before a join (4 MB, whatever the input).
SIEVE_BITS = 1 << 25
_CHUNK_NAMES = [f"c{i}" for i in range(CHUNKS)]
_SKETCH_NAMES = [f"s{i}" for i in range(SKETCH_WORDS)]
_RANDOM = np.random.default_rng(20)
_XOR = _RANDOM.integers(0, 1 << 64, CHUNKS * PLACES, np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, CHUNKS * PLACES, np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, CHUNKS) numbers of PLACES bytes each, for sets of hashes that are not empty."""
    out = np.zeros((len(sets), CHUNKS), np.int64)
    if not sets:
        return out
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for i in range(CHUNKS * PLACES):
        low = np.minimum.reduceat((every ^ _XOR[i]) * _ODD[i], starts)
        byte = ((low ^ (low >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
        out[:, i // PLACES] |= byte.astype(np.int64) << (8 * (i % PLACES))
    return out


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, n, c0.., s0.., items) of every row; ``items``, the whole set, once per task that meets the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in (batch.slice(i, BATCH_ROWS) for i in range(0, batch.num_rows, BATCH_ROWS)):
                sets = [shingles(t.as_py(), width) for t in part["text"]]
                nodes = [node_of(s) if len(s) else None for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                signed = np.zeros((len(sets), CHUNKS + SKETCH_WORDS), np.int64)
                signed[full, :CHUNKS] = signatures([sets[i] for i in full])
                signed[:, CHUNKS:] = odd_sketches(sets, SKETCH_WORDS)
                items = []
                for node, held in zip(nodes, sets, strict=True):
                    items.append(None if node is None or node in met else held.view(np.int64))
                    if len(met) >= 1 << 17:
                        met.clear()
                    met.add(node)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     *(pa.array(column) for column in np.ascontiguousarray(signed.T)), pa.array(items, pa.list_(pa.int64()))],
                    ["doc_id", "node", "n", *_CHUNK_NAMES, *_SKETCH_NAMES, "items"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in (*_CHUNK_NAMES, *_SKETCH_NAMES))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, n long, {numbers}, items array<long>")


def _sieved(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(row, items) of every chosen row and of few others: spares most sets the shuffle of the join that follows."""
    spot = F.pmod(F.xxhash64("row"), F.lit(SIEVE_BITS))
    at = chosen.select(F.floor(spot / 64).cast("int").alias("word"), (spot % 64).cast("int").alias("bit"))
    words = at.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()  # SIEVE_BITS / 64 rows at most
    table = np.zeros(SIEVE_BITS // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch["spot"].to_numpy()
            held = shared.value[spots >> 6] >> (spots & 63).astype(np.uint64) & np.uint64(1)
            yield batch.select(["row", "items"]).filter(pa.array(held.astype(bool)))

    return sets.select("row", "items", spot.alias("spot")).mapInArrow(run, "row long, items array<long>")


def index_keys(nodes: DataFrame) -> DataFrame:
    """(node, key): every chunk with one place left out; chunk and place are part of the key, which is exact."""
    keys = []
    for j, name in enumerate(_CHUNK_NAMES):
        for p in range(PLACES):
            above = F.shiftleft(F.shiftrightunsigned(name, 8 * (p + 1)), 8 * p)
            below = F.col(name).bitwiseAND(F.lit((1 << 8 * p) - 1).cast("long"))
            keys.append(F.lit((j * PLACES + p) << 8 * (PLACES - 1)).cast("long").bitwiseOR(above).bitwiseOR(below))
    return nodes.select("node", F.explode(F.array(*keys)).alias("key"))


def _xor(name: str) -> Column:
    return F.col(f"{name}_a").bitwiseXOR(F.col(f"{name}_b"))


def _all_bytes(byte: int) -> Column:
    return F.lit(sum(byte << 8 * p for p in range(PLACES))).cast("long")


def _differing(name: str) -> Column:
    """In how many places the two sides' chunks differ: the top bit of every byte of the difference that is not zero."""
    x = _xor(name)
    return F.bit_count(((x.bitwiseAND(_all_bytes(0x7F)) + _all_bytes(0x7F)).bitwiseOR(x)).bitwiseAND(_all_bytes(0x80)))


def distance() -> Column:
    """Places in which the signatures of sides a and b differ; a side's columns end in ``_a`` or ``_b``."""
    return reduce(Column.__add__, map(_differing, _CHUNK_NAMES))


def first_chunk(chunk: Column) -> Column:
    """Do the sides meet in no chunk before this one? (Kept short: the JVM compiles no method above 8,000 bytes.)"""
    return reduce(Column.__and__, [(chunk <= j) | (_differing(name) > 1) for j, name in enumerate(_CHUNK_NAMES[:-1])])


def _named(nodes: DataFrame, s: str) -> DataFrame:
    """Columns of one side of a pair; ``node`` becomes the side's name."""
    return nodes.select(*[F.col(c).alias(s if c == "node" else c if c == "key" else f"{c}_{s}") for c in nodes.columns])


class _Join:
    """The steps of one run over its tables: ``cards`` with sizes and sketches, ``sets`` with the full sets."""

    def __init__(self, tables: Workspace, cards: DataFrame, sets: DataFrame, percent: int):
        self.tables, self.cards, self.sets, self.percent = tables, cards, sets, percent

    def alike(self) -> Column:
        """May this pair link, by its sizes and sketches? True for every pair that does."""
        sizes = 100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")
        return sizes & odd_filter(self.percent, _SKETCH_NAMES)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs(a, b, ...)`` whose pair may link."""
        named = pairs.join(_named(self.cards, "a"), "a").join(_named(self.cards, "b"), "b")
        return named.where(self.alike()).select(pairs.columns)

    def confirmed(self, likely: DataFrame) -> DataFrame:
        """The pairs (a, b), the smaller node first, whose full sets are similar enough."""
        ordered = likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = self.tables.stored(ordered, "likely")
        # both sets of a pair come together once; sets outside all pairs stay where they are while the pairs are few
        sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node")).join(self.sets, "node")
        found = sides.groupBy("a", "b").agg(F.collect_list("items").alias("two"))
        both = F.size(F.array_intersect(F.get("two", 0), F.get("two", 1)))
        either = F.size(F.get("two", 0)) + F.size(F.get("two", 1)) - both
        return self.tables.stored(found.where(100 * both >= self.percent * either).select("a", "b"), "confirmed")

    def families(self, links: DataFrame) -> DataFrame:
        return self.tables.stored(components(links, "families", self.tables.stored), "families")


def _hub(*more: str) -> Column:
    """The node that shares most keys with others."""
    return F.max(F.struct("popular", "node", *more))


def _links(join: _Join, held: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between nodes that meet under a key: enough of them to connect all that any chain of links connects.

    ``held(key, node, popular)``: the keys that several nodes have.
    """
    hubs = held.groupBy("key").agg(_hub()["node"].alias("hub"))
    met = held.join(hubs, "key").where("node <> hub").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    nearest = join.likely(met).groupBy("a").agg(F.max(F.struct("shared", "b"))["b"].alias("b"))  # one pair a node
    stars = join.confirmed(nearest)

    # Families, roughly: a node goes with the most popular node it is linked with. Their hubs try those of the largest families.
    popular = held.select("node", "popular").distinct()
    linked = stars.select(F.col("a").alias("of"), F.col("b").alias("node")).unionByName(stars.select(F.col("b").alias("of"), F.col("a").alias("node")))
    leader = linked.join(popular, "node").groupBy("of").agg(_hub().alias("leader")).withColumnRenamed("of", "node")
    own = F.struct("popular", "node")
    labelled = held.join(leader, "node", "left").withColumn("family", F.greatest(F.coalesce("leader", own), own)["node"])
    groups = labelled.groupBy("key", "family").agg(_hub().alias("hub"), F.count(F.lit(1)).alias("size"))
    largest = groups.groupBy("key").agg(F.max(F.struct("size", "family", "hub")).alias("top"), F.count(F.lit(1)).alias("families"))
    tries = groups.join(largest.where("families > 1"), "key").where("family <> top.family")
    merged = join.confirmed(join.likely(tries.select(F.col("hub.node").alias("a"), F.col("top.hub.node").alias("b")).distinct()))
    links = stars.unionByName(merged)
    roots = join.families(links)
    rooted = join.tables.stored(held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")

    # Whatever is still apart under one key: all its pairs that sizes and sketches allow, each in the first chunk it meets in.
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ = rooted.join(apart, "key", "left_semi").select("key", "node", "root").join(nodes, "node")
    open_ = join.tables.stored(open_, "open")
    chunk = F.floor(F.shiftright("key", 8 * (PLACES - 1)) / PLACES)
    pairs = _named(open_, "a").join(_named(open_, "b"), "key").where(
        (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & join.alike() & first_chunk(chunk)
    )
    return links.unionByName(join.confirmed(pairs.select("a", "b")))


def classify(docs: DataFrame, width: int = 5, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets of distinct ``width``-word shingles, A-Z lower-cased; ``percent`` is 80
    or more, as far as the signatures are made for. Shorter texts are one shingle
    of all their words. Null texts and texts without words have an empty set and
    link with nothing. Rows with equal sets link whatever their ids; a row
    without id has the component of the others, if one has an id. ``kept`` is
    true where doc_id and component_id are equal or both null. Extra columns are
    ignored; an empty table gives no rows.
    """
    if percent < 80:
        raise ValueError("the signatures find pairs of a similarity of 80 % and more")
    docs = picked(docs, doc_id=doc_id, text=text)
    with Workspace(docs.sparkSession, "minhash") as tables:
        rows = tables.stored(_signed(docs, width).withColumn("row", F.monotonically_increasing_id()), "signed")
        sets = rows.where("items is not null")
        nodes = sets.groupBy("node").agg(*[F.min(c).alias(c) for c in ("row", "n", *_CHUNK_NAMES, *_SKETCH_NAMES)])
        # a set links with another one only if it holds at least that share of a set one larger
        nodes = tables.stored(nodes.where(100 * F.col("n") >= percent * (F.col("n") + 1)), "nodes")
        keys = index_keys(nodes)
        shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = tables.stored(keys.join(shared, "key"), "met")
        popular = met.groupBy("node").agg(F.sum("size").alias("popular"))
        held = tables.stored(met.join(popular, "node").select("key", "node", "popular"), "held")
        # only nodes that meet others go on
        nodes = tables.stored(nodes.join(popular, "node", "left_semi"), "chosen")
        full = _sieved(sets, nodes).join(nodes.select("row", "node"), "row")
        join = _Join(tables, nodes.select("node", "n", *_SKETCH_NAMES), tables.stored(full.select("node", "items"), "sets"), percent)
        root = join.families(_links(join, held, nodes.drop("row")))

        ids = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        grouped = ids.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
        named = tables.stored(grouped.join(smallest, "root").select("node", "component_id"), "named")
        component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return stored(
            rows.select("doc_id", "node", "n").join(named, "node", "left").select(
                "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                F.col("doc_id").eqNullSafe(component).alias("kept"),
            ), "near-copies",
        )
