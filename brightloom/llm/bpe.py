"""Byte-level BPE: merges found through a segment tree over the ranks of adjacent pairs.

The root of the tree is the leftmost pair of lowest rank; a merge changes at
most three leaves, each in logarithmic time, so even one word of a whole text's
length costs ``n log n``. Short pieces that are new to a block of texts are
merged together, their trees advancing in lockstep as rows of one array; pieces
met before come from a bounded cache.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from brightloom.llm.common import numbered


#: Fixed value: the pattern that cuts text into the pieces merges stay within.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PIECES, CACHED_BYTES, BLOCK_CHARS = 300_000, 64, 1_000_000
BATCH_ROWS = 256
_NONE = 1 << 62


def _byte_letters() -> dict[str, int]:
    """Printable stand-ins of the vocabulary file: visible Latin-1 bytes stand for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One vocabulary file (JSON with ``model.vocab``, ``model.merges``, ``added_tokens``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.byte_ids = [0] * 256
        for i, raw in self.bytes_of.items():
            if len(raw) == 1:
                self.byte_ids[raw[0]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (len(self.merges), vocab[a + b]))
        self.special = {t["content"]: np.asarray([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.cut = regex.compile(PIECES)
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pieces: dict[str, bytes] = {}
        ranked = sorted((rank, a, b, new) for (a, b), (rank, new) in self.merges.items())
        self._merged = np.asarray([r[3] for r in ranked], np.int64)
        keys = np.asarray([r[1] << 20 | r[2] for r in ranked], np.int64)
        self._rank = np.argsort(keys, kind="stable")
        self._keys = keys[self._rank]

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        ids, n = [self.byte_ids[b] for b in raw], len(raw)
        if n < 2:
            return ids
        merges, width = self.merges, 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                tree[width + i] = found[0] << 32 | i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        def rank(i: int) -> int:
            j = after[i]
            found = merges.get((ids[i], ids[j])) if j < n else None
            return found[0] << 32 | i if found else _NONE

        while (root := tree[1]) != _NONE:
            i = root & 0xFFFFFFFF
            j = after[i]
            ids[i], ids[j] = merges[ids[i], ids[j]][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, _NONE)
            put(i, rank(i))
            if before[i] >= 0:
                put(before[i], rank(before[i]))
        return [t for t in ids if t >= 0]

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._rank[at], len(self._keys))

    def merge_many(self, raws: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of at most ``width`` bytes: one tree per piece, all advanced in lockstep."""
        n = np.fromiter(map(len, raws), np.int64, len(raws))
        rows, none = np.repeat(np.arange(len(raws)), n), len(self._keys) * width
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        ids = np.full((len(raws), width + 1), -1, np.int64)  # the last column stands for "no neighbour"
        ids[rows, cols] = np.asarray(self.byte_ids)[np.frombuffer(b"".join(raws), np.uint8)]
        after = np.where(np.arange(1, width + 1) < n[:, None], np.arange(1, width + 1), width)
        before = np.tile(np.arange(-1, width), (len(raws), 1))
        leaf = np.where(ids[:, 1:] >= 0, self._pair_ranks(ids[:, :-1], np.maximum(ids[:, 1:], 0)), len(self._keys))
        tree = np.full((len(raws), 2 * width), none, np.int64)
        tree[:, width:] = np.minimum(leaf * width + np.arange(width), none)
        w = width
        while w > 1:
            w //= 2
            tree[:, w : 2 * w] = np.minimum(tree[:, 2 * w : 4 * w : 2], tree[:, 2 * w + 1 : 4 * w : 2])
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            rank, i = np.divmod(tree[live, 1], width)
            j, new = after[live, i], self._merged[rank]
            ids[live, i], ids[live, j] = new, -1
            k = after[live, i] = after[live, j]
            before[live, k] = i
            h = before[live, i]
            right = np.where(k < width, self._pair_ranks(new, np.maximum(ids[live, k], 0)), len(self._keys))
            left = np.where(h >= 0, self._pair_ranks(np.maximum(ids[live, h], 0), new), len(self._keys))
            tree[live, width + j] = none
            tree[live, width + i] = np.minimum(right * width + i, none)
            old = tree[live, width + h]  # h = -1 points below the leaves: keep what is there
            tree[live, width + h] = np.where(h >= 0, np.minimum(left * width + h, none), old)
            for leaf_at in (j, i, np.maximum(h, 0)):
                at = width + leaf_at
                for _ in range(width.bit_length() - 1):
                    at = at >> 1
                    tree[live, at] = np.minimum(tree[live, 2 * at], tree[live, 2 * at + 1])
            live = live[tree[live, 1] < none]
        kept = ids[:, :width] >= 0
        packed, ends = ids[:, :width][kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, fresh: set[str]) -> None:
        """Put pieces into the cache, which is emptied first when it would outgrow its bound."""
        if len(self.pieces) + len(fresh) > CACHED_PIECES:
            self.pieces.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in fresh:
            raw = piece.encode()
            by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, some in by_width.items():
            if width <= CACHED_BYTES:
                packed = self.merge_many([raw for _, raw in some], width)
            else:  # long pieces: one tree at a time
                packed = [np.asarray(self.merge(raw), "<u4").tobytes() for _, raw in some]
            self.pieces.update(zip([piece for piece, _ in some], packed, strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):  # a bounded number of characters at a time, one text at least
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= BLOCK_CHARS):
                chars, end = chars + len(texts[end]), end + 1
            out += self._encode_block(texts[start:end])
            start = end
        return out

    def _encode_block(self, texts: list[str]) -> list[bytes]:
        find, known = self.cut.findall, self.pieces
        cut = [
            [(part, None) if part in self.special else ("", find(part)) for part in self.split.split(text) if part]
            if self.split and self.split.search(text) else [("", find(text))]
            for text in texts
        ]
        fresh = {p for parts in cut for _, pieces in parts if pieces for p in pieces if p not in known}
        if len(known) + len(fresh) > CACHED_PIECES:  # the cache will be emptied: everything here is needed again
            fresh = {p for parts in cut for _, pieces in parts if pieces for p in pieces}
        if fresh:
            self._learn(fresh)
        return [
            b"".join([self.special[name] if pieces is None else b"".join([known[p] for p in pieces]) for name, pieces in parts])
            for parts in cut
        ]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def public_vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed package of public tokenizers; it is the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: the whole text's ids as bytes, 4 per id, little-endian.

    Null texts count as empty and get empty ids. Every row is kept as it is,
    repeated rows too; an existing column called ``ids``, in any case, is replaced.
    ``vocabulary`` is a path each executor can open.
    """
    return _mapped(docs, text, ids, "binary", vocabulary, lambda known, texts: known.encode_all([x or "" for x in texts]))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the text of ``ids``; null ids give an empty text. Ids outside the vocabulary are an error."""
    return _mapped(encoded, ids, text, "string", vocabulary, lambda known, rows: [known.decode(x or b"") for x in rows])


def _mapped(
    df: DataFrame, source: str, target: str, kind: str, vocabulary: str, work: Callable[[Codec, Iterable], list]
) -> DataFrame:
    """Rows stay in their partitions and come back in small batches. Columns called ``target`` but for case are replaced."""
    places = [i for i, c in enumerate(df.columns) if c.lower() != target.lower()]
    schema = StructType([df.schema.fields[i] for i in places]).add(target, kind)
    at, names, made = df.columns.index(source), [df.columns[i] for i in places], pa.binary() if kind == "binary" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                new = pa.array(work(known, part.column(at).to_pylist()), made)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in places] + [new], [*names, target])

    return numbered(df).mapInArrow(run, schema)
