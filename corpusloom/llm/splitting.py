"""Splitting oversized texts at natural boundaries.

Every byte position of a text has a boundary strength (see `strengths`). A sparse table answers
"which is the strongest, and of equals the rightmost, position in this window" in two look-ups.
A piece may end anywhere between half the limit and the limit; the strongest boundary in that
window wins, and the next piece starts a given number of lines before the cut. Tables are built
for a stretch of the text at a time, so memory does not grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strengths of cuts, weakest to strongest.
CHAR, PUNCT, SPACE, SENTENCE, LINE = 1, 2, 3, 4, 8
#: A line break gains for a shallow next line, a next line at the margin, and a blank line.
SHALLOW, MARGIN, BLANK = 2, 4, 16

PIECES = "chunk_id long, piece_no int, line_start int, line_end int, uncompressed_len int, token_estimate int, text string"


def strengths(raw: np.ndarray) -> np.ndarray:
    """Strength of a cut before byte i, for i in 0..len: 0 where no cut may be (inside a UTF-8
    character or between CR and LF)."""
    n = len(raw)
    out = np.zeros(n + 1, dtype=np.int64)
    if n == 0:
        return out
    prev, nxt = raw[:-1], raw[1:]
    inner = out[1:n]
    inner[:] = CHAR
    inner[np.isin(prev, np.frombuffer(b",;:)]}>/|&+=", np.uint8))] = PUNCT
    space = (prev == 32) | (prev == 9)
    inner[space] = SPACE
    if n > 2:
        stop = np.isin(raw[:-2], np.frombuffer(b".!?", np.uint8))
        inner[1:][stop & space[1:]] = SENTENCE
    newline = np.flatnonzero(prev == 10)
    if len(newline):
        after = newline + 1
        following = raw[after]
        inner[newline] = LINE
        indented = (following == 32) | (following == 9)
        shallow = indented & ((after + 4 >= n) | ((raw[np.minimum(after + 4, n - 1)] != 32) & (following != 9)))
        inner[newline[shallow]] += SHALLOW
        inner[newline[~indented]] += MARGIN
        before = np.where(newline > 0, raw[np.maximum(newline - 1, 0)], 0)
        before2 = np.where(newline > 1, raw[np.maximum(newline - 2, 0)], 0)
        inner[newline[(before == 10) | ((before == 13) & (before2 == 10))]] += BLANK
    inner[(nxt & 0xC0) == 0x80] = 0
    inner[(prev == 13) & (nxt == 10)] = 0
    out[n] = 1 << 20
    return out


class RangeMaximum:
    """Sparse table over one stretch of strengths; positions are absolute."""

    def __init__(self, values: np.ndarray, offset: int) -> None:
        size = len(values)
        self.offset, self.size = offset, size
        # Strength first, position second: the maximum is the strongest and then the rightmost.
        level = (values.astype(np.int64) << 40) | np.arange(size, dtype=np.int64)
        self.levels = [level]
        step = 1
        while 2 * step <= size:
            level = np.maximum(level[:-step], level[step:])
            self.levels.append(level)
            step *= 2

    def strongest(self, lo: int, hi: int) -> tuple[int, int]:
        """(position, strength) of the maximum in [lo, hi]."""
        a, b = lo - self.offset, hi - self.offset
        k = (b - a + 1).bit_length() - 1
        best = max(int(self.levels[k][a]), int(self.levels[k][b - (1 << k) + 1]))
        return (best & ((1 << 40) - 1)) + self.offset, best >> 40


def cut_points(raw: bytes, limit: int, overlap_lines: int) -> list[tuple[int, int]]:
    """Byte ranges of the pieces of a text. Ranges cover the text, are at most `limit` bytes, and
    consecutive ones share `overlap_lines` whole lines, fewer where those would fill more than
    half the limit and none after a cut inside a line. Limits under 4 are taken as 4, so that any
    character fits. An empty text is one empty piece."""
    n = len(raw)
    limit = max(4, int(limit))
    if n <= limit:
        return [(0, n)]
    data = np.frombuffer(raw, np.uint8)
    stretch = max(8 * limit, 1 << 16)
    line_starts = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
    out, start, cut, table, base, strong = [], 0, 0, None, 0, None
    while n - start > limit:
        lo, hi = max(cut + 1, start + limit // 2), start + limit
        if table is None or hi >= base + table.size:
            base = max(0, lo - 4)
            end = min(n, base + stretch)
            # Two bytes on either side decide about a strength, six after a line break.
            strong = strengths(data[base : min(n, end + 8)])
            if end < n:
                strong = strong[: end - base]
            table = RangeMaximum(strong, base)
        cut, strength = table.strongest(lo, hi)
        if strength == 0:  # only inside one character: step back to its start
            cut = hi
            while cut > start and (raw[cut] & 0xC0) == 0x80:
                cut -= 1
        out.append((start, cut))
        nxt = cut
        if raw[cut - 1] == 10 and overlap_lines > 0:
            at = int(np.searchsorted(line_starts, cut))
            first = max(0, at - overlap_lines)
            while first < at and (cut - line_starts[first] > limit // 2 or line_starts[first] <= start):
                first += 1
            nxt = int(line_starts[first]) if first < at else cut
        start = nxt
    out.append((start, n))
    return out


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow form of split_oversized: rows of (chunk_id, text, line_start, line_end, limit, overlap)."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            raw = r["text"].encode("utf-8")
            breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
            first = first_line(r["line_start"], r["line_end"], len(breaks) + (not raw.endswith(b"\n")))
            for no, (a, b) in enumerate(cut_points(raw, r["limit"], r["overlap"] or 0)):
                top = first + int(np.searchsorted(breaks, a))
                last = first + int(np.searchsorted(breaks, max(a, b - 1)))
                rows.append((r["chunk_id"], no, top, last, b - a, max(1, -(-(b - a) * 10 // 32)), raw[a:b].decode("utf-8")))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def first_line(start: int | None, end: int | None, lines: int) -> int:
    """Line number of a text's first line from what was recorded: the smaller of swapped numbers;
    a missing start follows from the end; with both missing the text starts at line 1."""
    if start is not None and end is not None:
        return min(start, end)
    if start is not None:
        return start
    return max(1, end - lines + 1) if end is not None else 1


def oversized(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """(chunk_id, text, line_start, line_end, limit, overlap): chunks whose text is longer in UTF-8
    bytes than their catalog's max_chunk_bytes. Recorded sizes are not used. The length test
    comes before anything is moved; chunks delivered several times stay once, with their latest
    row. Null texts, keys and limits never exceed. Catalogs built several times stay once: of
    differing limits the greatest stands."""
    limits = meta.groupBy("catalog_id").agg(F.max("max_chunk_bytes").alias("limit"), F.max("overlap_lines").alias("overlap"))
    rows = chunks.where("text IS NOT NULL AND chunk_id IS NOT NULL")
    rows = rows.select("chunk_id", "catalog_id", "text", "line_start", "line_end", "loaded_at", F.octet_length("text").alias("bytes"))
    big = rows.join(limits, "catalog_id").where("bytes > limit")
    best = F.max_by(F.struct("text", "line_start", "line_end", "limit", "overlap"), F.struct("loaded_at", "text"))
    return big.groupBy("chunk_id").agg(best.alias("x")).select("chunk_id", "x.*")


def split_oversized(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """The pieces of every oversized chunk; columns are PIECES. piece_no counts from 0."""
    return oversized(chunks, meta).mapInArrow(pieces, PIECES)
