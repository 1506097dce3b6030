"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is cut into words and punctuation runs. Features are their n-grams and,
for words never seen before, n-grams of their shapes (capitals, title, digits,
repeat of the word before...). A document is a sparse vector of shares per kind
of n-gram; its score is the logistic of one sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brightloom.llm.common import stored, unused

DIMENSIONS = 1 << 18
#: Labelled rows that a model is fitted on, within a few hundredths; chosen by the hash of their id. Every row is scored.
TRAINING_ROWS = 8_000
EPOCHS = 3
THRESHOLD = 0.7
#: Learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
#: Added to the length of a text, so that a few words move the score from the bias only a little.
SHORT = 4

#: Tokens that a worker remembers; results do not depend on it.
KNOWN_TOKENS = 1 << 17
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64(9)


class _Tokens(dict):
    """token -> crc32 in the low half, shape in the high half; emptied when full."""

    def __missing__(self, token: bytes) -> int:
        word = token.decode("utf-8", "replace")
        if not word[0].isalnum():
            shape = 16 + zlib.crc32(token) % 4096  # punctuation keeps its identity
        elif word.isdigit():
            shape = 1
        elif len(word) > 1 and word.isupper():
            shape = 2
        elif word[0].isupper():
            shape = 3 if word[1:].islower() or len(word) == 1 else 4
        else:
            shape = 5 if word.islower() else 6
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        code = self[token] = shape << 32 | zlib.crc32(token)
        return code


def _grams(codes: np.ndarray, kind: int, n: int) -> np.ndarray:
    h = np.full(len(codes) - n + 1, kind, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : len(codes) - n + 1 + i]) * _MIX
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(40)).astype(np.int64) % DIMENSIONS


def features(text: str | None, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text; both empty where there is no token."""
    codes = np.asarray([known[t] for t in _TOKEN.findall((text or "").encode("utf-8", "replace"))], np.uint64)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0)
    words, shapes = codes & np.uint64(0xFFFFFFFF), codes >> np.uint64(32)
    shapes[1:][words[1:] == words[:-1]] = _REPEAT
    found = [_grams(c, kind, n) for kind, (c, n) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3))) if len(c) >= n]
    return np.concatenate(found), np.concatenate([np.full(len(f), 1 / (len(f) + SHORT)) for f in found])


def _sparse(text: str | None, known: dict) -> tuple[np.ndarray, np.ndarray]:
    at, value = features(text, known)
    places, inverse = np.unique(at, return_inverse=True)
    return places, np.bincount(inverse, value, len(places))


class Follower:
    """The leader's state: per feature the sum of adjusted gradients and of their squares; the last one is the bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        at, value = np.append(at, DIMENSIONS), np.append(value, 1.0)
        w = self.weights(at)
        g = (_logistic(float(w @ value)) - label) * value
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 by 4. A null id is text without letters."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
    rows: int = TRAINING_ROWS, epochs: int = EPOCHS,
) -> np.ndarray:
    """Weights (the last is the bias), learned from labelled rows that are not held out.

    Label rows without id or label are left out; texts may be null or empty.
    Repeated ids count as often as they occur. Without any labelled row all
    weights are 0 and every score is 0.5. The sample has about ``rows`` rows;
    its features stream through one task in an order hashed per epoch, so the
    fit needs memory for one batch and the weights only.
    """
    usable = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label"))
        .where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    )
    # the rows whose hashed id lies in the lowest share of the range: spread over the tasks, nothing is ranked
    share = min(1.0, rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(stored(chosen, "labelled"), "doc_id")

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Tokens()
        for batch in batches:
            pairs = [_sparse(t, known) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype(str), "label": batch["label"],
                "at": [a.astype("<i4").tobytes() for a, _ in pairs], "value": [v.astype("<f4").tobytes() for _, v in pairs],
            })

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leader = Follower()
        for batch in batches:
            for at, value, y in zip(batch["at"], batch["value"], batch["label"], strict=True):
                leader.update(np.frombuffer(at, "<i4"), np.frombuffer(value, "<f4").astype(float), y)
        yield pd.DataFrame({"weights": [leader.weights(slice(None)).astype("<f4").tobytes()]})

    vectors = stored(texts.mapInPandas(sparse, "doc_id string, label double, at binary, value binary"), "vectors")
    ordered = vectors.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(1).sortWithinPartitions(
        "epoch", F.xxhash64("epoch", "doc_id"), "doc_id", "label"
    )
    fitted = ordered.select("at", "value", "label").mapInPandas(follow, "weights binary").first()
    return np.frombuffer(fitted["weights"], "<f4") if fitted else np.zeros(DIMENSIONS + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score (0 to 1) of each whole text; a null or empty one scores by the bias alone.

    Rows stay in place, repeated ones included; an existing column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # (2^18 + 1) 4-byte numbers, whatever the input

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, known = shared.value.astype(float), _Tokens()
        for batch in batches:  # texts become Python strings one at a time
            yield pa.array([_logistic(float(w[-1] + w[at] @ value)) for at, value in (features(t.as_py(), known) for t in batch)], pa.float64())

    return docs.withColumn(name, run(F.col(f"`{text}`")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    name = unused(docs, "_score")
    scored = score(docs, train(docs, labels, text=text), text, name)
    return scored.where(F.col(name) >= threshold).drop(name)
