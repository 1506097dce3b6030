"""Fill-in-the-middle: two cuts turn a text into prefix, middle and suffix, written in another order.

Cuts fall between units: words with the white space before them, or lines. A
batch of texts becomes one sequence of byte classes held as a wavelet matrix.
Its rank queries answer everything the transformation asks: ranks of the classes
that end a unit add up to the number of units before a place, ranks of UTF-8's
continuation bytes turn bytes into code points, and bisection on the ranks finds
the place where a given number of units ends, for all texts of the batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brightloom.llm.common import picked

#: Signs before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes and rows of text that share one wavelet matrix; a longer text has one of its own.
PART_BYTES, PART_ROWS = 1 << 22, 2048

# Byte classes, three bits. Of words: bit 0 continues a code point, bit 1 ends the word. Of white space (bit 2):
# bit 0 is a line feed, bit 1 ends the text.
LEVELS = 3
CONTINUES = (1, 3)
ENDS = {"words": (2, 3, 6, 7), "lines": (5, 7)}
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_FORMS = ("plain", "psm", "spm")


def byte_classes(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The class of every byte of texts that lie one after another between ``edges``."""
    blank = _BLANK[data]
    last = np.zeros(len(data), bool)
    last[edges[1:][edges[1:] > edges[:-1]] - 1] = True
    ends_word = np.append(blank[1:], True)[: len(data)] | last
    word = ((data & 0xC0) == 0x80) + 2 * ends_word.view(np.uint8)
    space = 4 + (data == 10) + 2 * last.view(np.uint8)
    return np.where(blank, space, word).astype(np.uint8)


class Bits:
    """Packed bits with a running count per 64: how many of the first ``i`` are set."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


class WaveletMatrix:
    """One bit vector per level, the highest bit first; each level stably moves its zeros before its ones."""

    def __init__(self, codes: np.ndarray, levels: int):
        self.levels = []
        for shift in reversed(range(levels)):
            bits = (codes >> shift & 1).astype(bool)
            self.levels.append(Bits(bits))
            codes = np.concatenate([codes[~bits], codes[bits]])

    def rank(self, code: int, i: np.ndarray) -> np.ndarray:
        """How many of the first ``i`` entries are ``code``."""
        start, end = np.zeros(1, np.int64), i
        for at, bits in enumerate(self.levels):
            ones, first = bits.ones(end), bits.ones(start)
            if code >> (len(self.levels) - 1 - at) & 1:
                start, end = bits.zeros + first, bits.zeros + ones
            else:
                start, end = start - first, end - ones
        return end - start

    def count(self, codes: Sequence[int], i: np.ndarray) -> np.ndarray:
        return sum(self.rank(code, i) for code in codes)

    def reach(self, codes: Sequence[int], k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first places from ``low`` to ``high`` behind ``k`` entries out of ``codes``; ``high`` where there are fewer."""
        goal, low, high = k + self.count(codes, low), low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high) // 2
            enough = self.count(codes, middle) >= goal
            high = np.where(enough, middle, high)
            low = np.where(enough | (low == high), low, middle + 1)
        return low


def cut(data: np.ndarray, edges: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """(units, first cut, second cut, code points before the first, between both) of every text; cuts are byte places."""
    matrix, ends = WaveletMatrix(byte_classes(data, edges), LEVELS), ENDS[unit]
    start, stop = edges[:-1], edges[1:]
    whole = matrix.count(ends, stop) - matrix.count(ends, start)
    inside = np.maximum(stop - 1, start)
    open_end = (stop > start) & (matrix.count(ends, stop) == matrix.count(ends, inside))  # text behind the last end
    units = whole + open_end
    first, second = np.minimum(h1 % (units + 1), h2 % (units + 1)), np.maximum(h1 % (units + 1), h2 % (units + 1))
    places = matrix.reach(ends, np.concatenate([first, second]), np.tile(start, 2), np.tile(stop, 2))
    one, two = places[: len(start)], places[len(start) :]
    points = lambda a, b: b - a - matrix.count(CONTINUES, b) + matrix.count(CONTINUES, a)
    return units, one, two, points(start, one), points(one, two)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with their texts' bytes and edges: at most PART_ROWS rows, and PART_BYTES unless one text is longer."""
    for batch in batches:
        texts = batch["text"].fill_null("").cast(pa.large_binary())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        row = 0
        while row < len(texts):
            fits = int(np.searchsorted(edges, edges[row] + PART_BYTES, side="right")) - 1
            end = min(max(fits, row + 1), row + PART_ROWS, len(texts))
            yield batch.slice(row, end - row), data[edges[row] : edges[end]], edges[row : end + 1] - edges[row]
            row = end


def transform(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = "42", fim_percent: int = 50,
    spm_percent: int = 80, unit: str = "words", marks: Sequence[str] = MARKS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars (code points), output (text).

    The sha256 of seed and id decides form and cuts, so reruns agree and rows
    with the same id are cut by the same numbers; a null id counts as an empty
    one. ``fim_percent`` of the texts are transformed, of these ``spm_percent``
    with the suffix first. Empty and null texts and texts that contain a mark
    stay ``plain``, without cut lengths. Whole texts of any length are
    transformed. Extra columns are ignored; an empty table gives no rows.
    """
    if unit not in ENDS:
        raise ValueError(f"no unit {unit!r}; there are {', '.join(ENDS)}")
    signs = [m.encode() for m in marks]
    prefix, suffix, middle = signs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, edges in _parts(batches):
            h = [part[f"h{i}"].to_numpy(zero_copy_only=False) for i in range(1, 5)]
            units, one, two, before, between = cut(data, edges, h[0], h[1], unit)
            raw, form, out = data.tobytes(), np.where(h[2] % 100 >= fim_percent, 0, np.where(h[3] % 100 < spm_percent, 2, 1)), []
            for i, (a, b, c, d) in enumerate(zip(edges[:-1].tolist(), one.tolist(), two.tolist(), edges[1:].tolist(), strict=True)):
                body = raw[a:d]
                if not body or any(s in body for s in signs):
                    form[i] = 0
                if form[i] == 0:
                    out.append(body)
                elif form[i] == 1:
                    out.append(b"".join((prefix, raw[a:b], suffix, raw[c:d], middle, raw[b:c])))
                else:
                    out.append(b"".join((suffix, raw[c:d], prefix, raw[a:b], middle, raw[b:c])))
            plain = form == 0
            yield pa.RecordBatch.from_arrays([
                part["doc_id"], pa.array(units), pa.array([_FORMS[f] for f in form]), pa.array(before, mask=plain),
                pa.array(between, mask=plain), pa.array(out, pa.binary()).view(pa.string()),
            ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    docs = picked(docs, doc_id=doc_id, text=text)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.withColumn("digest", digest).select("doc_id", "text", *numbers).mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The exact text behind an output: the parts between the marks, in their old order."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    back = lambda *order: F.concat(*[F.get(parts, i) for i in order])
    return F.when(form == "psm", back(1, 3, 2)).when(form == "spm", back(2, 3, 1)).otherwise(output)
