"""Substring deduplication by content-defined chunks.

A gear rolling hash runs over the bytes of each text: h' = 2h + G[byte] modulo 2^32, so it depends on the last 32
bytes alone.  A chunk ends where the top bits of the hash are zero, at ``min_bytes`` at the earliest and ``max_bytes``
at the latest; an insertion moves the cuts near it and no others.  Cuts stay between UTF-8 characters.  Chunks are
compared by a 128-bit digest.  Of equal chunks the one in the smallest document id, then at the smallest offset, stays
(null ids come first).

Digests are counted with map-side partial sums and only repeated ones are joined back; that join has plain exchanges
on both sides, so adaptive execution splits a digest that very many chunks share.

Null and empty texts have no chunks and come back empty.  A text's tail shorter than ``min_bytes`` is never removed.
Rows have a number of their own, which chunks and spans go by: rows with equal ids, equal rows and rows without an id are
repeats of each other like any others, in an arbitrary but fixed order.  Other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from ledgerspark.llm.base import materialize, slices, text_or_empty

#: Chunks of 64 bytes in the mean: a repeated passage of 52 words shares a whole chunk in 99 of 100 places (82 with 48, 6, 512).
MIN_BYTES, MEAN_BITS, MAX_BYTES = 32, 5, 256


def gear_table(seed: int = 1) -> np.ndarray:
    """256 random 32-bit numbers, from a digest of seed and byte."""
    return np.array(
        [int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, key=seed.to_bytes(8, "little")).digest(), "little") for b in range(256)],
        np.uint32,
    )


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: windows of 1, 2, 4, .. 32 bytes, each made of two of half the length."""
    h = gear[data]
    for width in (1, 2, 4, 8, 16):
        grown = h.copy()
        grown[width:] += h[:-width] << np.uint32(width)
        h = grown
    return h


def cut_points(data: np.ndarray, gear: np.ndarray, min_bytes: int, bits: int, max_bytes: int) -> list[int]:
    """Ends of the chunks of one text."""
    if len(data) == 0:
        return []
    marks = np.flatnonzero(gear_hashes(data, gear) >> np.uint32(32 - bits) == 0) + 1
    inside = marks[marks < len(data)]
    marks = inside[(data[inside] & 0xC0) != 0x80]
    cuts, start, total = [], 0, len(data)
    for mark in [*marks.tolist(), total]:
        while mark - start > max_bytes:
            end = start + max_bytes
            while data[end] & 0xC0 == 0x80:
                end -= 1
            cuts.append(end)
            start = end
        if mark - start >= min_bytes or mark == total:
            if mark > start:
                cuts.append(mark)
            start = mark
    return cuts


def chunks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_bytes: int = MIN_BYTES,
    mean_bits: int = MEAN_BITS,
    max_bytes: int = MAX_BYTES,
    row_col: str = "row",
) -> DataFrame:
    """One row per chunk: ``id, row long, start int, size int, digest binary``; offsets count UTF-8 bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        gear = gear_table()
        for whole in batches:
            for batch in slices(whole, 2):
                rows, starts, sizes, digests = [], [], [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    raw = text.encode()
                    start = 0
                    for end in cut_points(np.frombuffer(raw, np.uint8), gear, min_bytes, mean_bits, max_bytes):
                        rows.append(i)
                        starts.append(start)
                        sizes.append(end - start)
                        digests.append(hashlib.blake2b(raw[start:end], digest_size=16).digest())
                        start = end
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int32())),
                        batch.column(1).take(pa.array(rows, pa.int32())),
                        pa.array(starts, pa.int32()),
                        pa.array(sizes, pa.int32()),
                        pa.array(digests, pa.binary()),
                    ],
                    ["id", "row", "start", "size", "digest"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(row_col).alias("row"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, row long, start int, size int, digest binary")


def repeated_chunks(pieces: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The chunks to remove: all but the first of those with an equal digest; ``row, start, size, first_id``."""
    pieces = pieces.where(F.col("size") >= min_bytes)
    first = materialize(
        pieces.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "row", "start")).alias("first"))
        .where("copies > 1"),
        "gear-repeated",
    )
    return (
        pieces.join(first, "digest")
        .where(F.struct("id", "row", "start") != F.col("first"))
        .select("row", "start", "size", F.col("first.id").alias("first_id"))
    )


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """One row per document: its id, ``text`` without repeated chunks, ``removed_bytes long`` and
    ``spans array<struct<start int, size int, first_id>>``, byte offsets in the given text in order, neighbours
    apart.  ``first_id`` is the document that keeps the chunk."""
    spark = docs.sparkSession
    numbered = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    # Written, so that a row has the same number in both passes.
    numbered = materialize(numbered, "gear-documents")
    pieces = materialize(chunks(numbered, "id", "text", **sizes), "gear-chunks")
    spans = (
        repeated_chunks(pieces, sizes.get("min_bytes", MIN_BYTES))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "size", "first_id"))).alias("spans"))
    )
    kind = docs.schema[id_col].dataType.simpleString()
    span_kind = f"array<struct<start:int,size:int,first_id:{kind}>>"

    def run(batches):
        for batch in batches:
            out, removed = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone = sum(s["size"] for s in spans)
                removed.append(gone)
                if not gone:
                    out.append(text)
                    continue
                raw, kept, at = text.encode(), [], 0
                for span in spans:
                    kept.append(raw[at : span["start"]])
                    at = span["start"] + span["size"]
                out.append((b"".join(kept) + raw[at:]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array(removed, pa.int64()), batch.column(2)],
                ["id", "text", "removed_bytes", "spans"],
            )

    none = F.from_json(F.lit("[]"), span_kind)
    joined = numbered.join(spans, "row", "left").select("id", "text", F.coalesce("spans", none).alias("spans"))
    return joined.mapInArrow(run, f"id {kind}, text string, removed_bytes long, spans {span_kind}").withColumnRenamed("id", id_col)
