"""Cutting files into overlapping line windows, blocks and tree nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, normal_path, token_estimate
from corpusloom.session import numbered

CHUNK = "path string, line_start int, line_end int, text string"


def lines(text: Column) -> Column:
    """Lines of a text: cut at line feeds, without a trailing carriage return, without the empty
    piece after a final line feed."""
    parts = F.split(text, "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r$", ""))


def line_windows(files: DataFrame, window: int = 60, overlap: int = 12) -> DataFrame:
    """(path, line_start, line_end, text): windows of lines without a byte cap, in native columns.
    Windows start every window - overlap lines and end with the first that reaches the end of the
    file. Blank files and blank windows have no row; leading empty lines leave a window's text
    but not its line numbers. Null texts have no row."""
    stride = max(1, window - overlap)
    rows = files.where("text IS NOT NULL").select(normal_path("path").alias("path"), lines(F.col("text")).alias("ls"))
    rows = rows.where("size(ls) > 0").withColumn("n", F.size("ls"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - window) / F.lit(stride)).cast("int")) * stride
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0), last, F.lit(stride))))
    text = F.regexp_replace(F.array_join(F.slice("ls", F.col("start") + 1, window), "\n"), "^\n+", "")
    out = rows.select("path", (F.col("start") + 1).alias("line_start"), F.least(F.col("start") + window, F.col("n")).alias("line_end"), text.alias("text"))
    return out.where(F.regexp_replace("text", r"\s+", "") != "")


def capped_chunks(text: str, window: int = 60, overlap: int = 12, cap: int = 8192) -> list[tuple[int, int, str]]:
    """(line_start, line_end, text) of one file with a byte cap: a window ends early before the line
    that would exceed the cap; a line longer than the cap is cut at a character border."""
    if not text.strip():
        return []
    rows = text.split("\n")
    if rows[-1] == "":
        rows.pop()
    rows = [r[:-1] if r.endswith("\r") else r for r in rows]
    out, start, stride = [], 0, max(1, window - overlap)
    while start < len(rows):
        held, size, last = [], 0, start
        for i in range(start, min(start + window, len(rows))):
            raw = len(rows[i].encode())
            if held and size + raw + 1 > cap:
                break
            if held or raw:
                held.append(rows[i] if raw <= cap or held else rows[i].encode()[:cap].decode("utf-8", "ignore"))
                size += min(raw, cap) + (1 if len(held) > 1 else 0)
            last = i
        body = "\n".join(held)
        if body.strip():
            out.append((start + 1, last + 1, body))
        if last + 1 >= len(rows):
            break
        start += min(stride, max(1, last + 1 - start))
    return out


def windows_with_cap(files: DataFrame, window: int = 60, overlap: int = 12, cap: int = 8192) -> DataFrame:
    """capped_chunks over a table (path, text), as a narrow Arrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (path, *c)
                for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for c in capped_chunks(text, window, overlap, cap)
            ]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "line_start", "line_end", "text"])

    return files.where("text IS NOT NULL").select(normal_path("path").alias("path"), "text").mapInArrow(run, CHUNK)


def catalog_chunks(files: DataFrame, **limits: int) -> DataFrame:
    """Chunks with a dense id in (path, line) order, token estimate and content hash."""
    rows = numbered(windows_with_cap(files, **limits), ["path", "line_start"], "chunk_id")
    return rows.select("chunk_id", "path", "line_start", "line_end", "text", token_estimate("text").alias("token_estimate"), content_hash("text").alias("content_hash"))


def blank_line_leaves(files: DataFrame) -> DataFrame:
    """(path, leaf_no, start, end, leaf_id): blocks between blank lines with their byte range and
    a content-addressed id. Blank blocks have no row."""
    parts = F.split("text", "\n\n")
    rows = files.where("text IS NOT NULL").select("path", parts.alias("ps")).select("path", "ps", F.posexplode("ps").alias("leaf_no", "block"))
    before = F.aggregate(F.slice("ps", 1, F.col("leaf_no")), F.lit(0), lambda s, x: s + F.octet_length(x) + 2)
    rows = rows.withColumn("start", before)
    return rows.where(F.trim(F.regexp_replace("block", r"\s+", " ")) != "").select(
        "path", "leaf_no", "start", (F.col("start") + F.octet_length("block")).alias("end"), content_hash("block").alias("leaf_id")
    )
