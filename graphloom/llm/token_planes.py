"""Operator 8: token ids in a bit-plane shuffled binary format.

A segment is a self-contained file image::

    "GLBP" | header length u32 | header (JSON) | document table | planes of chunk 0, 1, ...

Ids are cut into chunks of ``CHUNK``; a chunk is transposed into planes (bit planes, or byte planes)
and each plane is compressed with zstandard.  The header's chunk index has the id count and plane
sizes of every chunk, so any range of ids is read without the rest.  The document table has the
ids and id counts of the segment's documents.

``write`` encodes documents in ascending doc_id order (range partitions, sorted), and stores
segments as rows of a Parquet table in the shared folder, so that Spark's commit protocol
covers a lost executor and any store that Spark can write works.  A segment knows how many ids stand
before it in its partition; only the partitions' totals, a row each, are summed up and broadcast.
``export`` writes segments as plain files, which ``Segment`` reads.

Defined results: a null text has no ids but the end id; rows of equal doc_id stand by text; a null
doc_id stands first.  Very long texts are read whole; extra columns are ignored; no rows give none.
"""

from __future__ import annotations

import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CHUNK = 1 << 16
SEGMENT = 1 << 18
MAGIC = b"GLBP"


def planes_of(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of a chunk, the lowest first; leading planes of zeros are left out."""
    ids = ids.astype("<u4")
    if mode == "byte":
        table = ids.view(np.uint8).reshape(-1, 4)
        return [np.ascontiguousarray(table[:, i]).tobytes() for i in range(max(1, (int(ids.max()).bit_length() + 7) // 8))] if len(ids) else []
    bits = int(ids.max()).bit_length() if len(ids) else 0
    return [np.packbits((ids >> np.uint32(i) & np.uint32(1)).astype(np.uint8)).tobytes() for i in range(bits)]


def ids_of(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for i, plane in enumerate(planes):
        if mode == "byte":
            out |= np.frombuffer(plane, np.uint8).astype(np.uint32) << np.uint32(8 * i)
        else:
            out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(i)
    return out


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, mode: str = "byte", level: int = 3) -> bytes:
    """A segment of documents with their ids, end to end."""
    press = zstandard.ZstdCompressor(level=level)
    body, index = [], []
    for a in range(0, len(ids), CHUNK):
        chunk = ids[a : a + CHUNK]
        planes = [press.compress(p) for p in planes_of(chunk, mode)]
        index.append([len(chunk), [len(p) for p in planes]])
        body += planes
    table = [np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array(counts, "<i8"), np.array([d is None for d in doc_ids], "u1")]
    tables = press.compress(b"".join(t.tobytes() for t in table))
    header = json.dumps({"mode": mode, "docs": len(doc_ids), "ids": len(ids), "table": len(tables), "chunks": index}, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, tables, *body])


class Segment:
    """Reader of a segment: ``doc_ids``, ``counts`` and ``ids(start, stop)``."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.data, size = memoryview(data), struct.unpack("<I", data[4:8])[0]
        self.head = json.loads(bytes(data[8 : 8 + size]))
        at, n = 8 + size, self.head["docs"]
        self._open = zstandard.ZstdDecompressor()
        table = self._open.decompress(self.data[at : at + self.head["table"]])
        names, nulls = np.frombuffer(table, "<i8", n), np.frombuffer(table, "u1", n, 16 * n)
        self.doc_ids = [None if z else i for i, z in zip(names.tolist(), nulls.tolist())]
        self.counts = np.frombuffer(table, "<i8", n, 8 * n)
        self.places, at, first = [], at + self.head["table"], 0
        for count, sizes in self.head["chunks"]:
            self.places.append((first, count, at, sizes))
            first, at = first + count, at + sum(sizes)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.head["ids"] if stop is None else stop
        parts = [np.empty(0, np.uint32)]
        for first, count, at, sizes in self.places:
            if first < stop and first + count > start:
                planes = []
                for size in sizes:
                    planes.append(self._open.decompress(self.data[at : at + size]))
                    at += size
                parts.append(ids_of(planes, count, self.head["mode"])[max(0, start - first) : stop - first])
        return np.concatenate(parts)


def _encode(path: str | None, end: int, mode: str, segment: int):
    def apply(frames):
        encoder, part, number = tokens.encoder(path), TaskContext.get().partitionId(), 0
        names, counts, held, size, before = [], [], [], 0, 0

        def flush():
            nonlocal number, names, counts, held, size, before
            data = pack(names, counts, np.concatenate(held) if held else np.empty(0, encoder.dtype), mode)
            row = pa.RecordBatch.from_pydict({"part": [part], "segment": [number], "in_part": [before], "n_ids": [size], "data": [data]}, schema=pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("in_part", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]))
            number, names, counts, held, size, before = number + 1, [], [], [], 0, before + size
            return row

        last = np.array([end], encoder.dtype)
        for frame, first, texts in tokens.batches(frames, 1):
            for name, ids in zip(frame.column(0).slice(first, len(texts)).to_pylist(), encoder.batch(texts)):
                held += [ids, last]
                names.append(name)
                counts.append(len(ids) + 1)
                size += len(ids) + 1
                if size >= segment:
                    yield flush()
        if names:
            yield flush()

    return apply


def write(docs: DataFrame, tokenizer: str | None = None, end: int = 0, mode: str = "byte", segment: int = SEGMENT) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and store them; the written segments
    (part, segment, first_id, n_ids, data), ``first_id`` being the ids of all documents before."""
    common.ship(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    stored = common.materialize(ordered.mapInArrow(_encode(tokenizer, end, mode, segment), "part int, segment int, in_part long, n_ids long, data binary"), "token-segments")
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_first"))
    # As many rows as the job has partitions.
    return stored.join(F.broadcast(parts), "part").select("part", "segment", (F.col("part_first") + F.col("in_part")).alias("first_id"), "n_ids", "data")


def documents_of(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from segments."""
    common.ship(segments.sparkSession)

    def apply(frames):
        for frame in frames:
            for first, data in zip(frame.column(0).to_pylist(), frame.column(1)):
                segment = Segment(data.as_py())
                ids = segment.ids().astype("<u4")
                ends = np.cumsum(segment.counts)
                starts = ends - segment.counts
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(segment.doc_ids, pa.int64()), pa.array(first + starts), pa.array(segment.counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("first_id", "data").mapInArrow(apply, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(segments: DataFrame, folder: str) -> list[str]:
    """Write each segment as a plain file under a local ``folder`` (one at a time, for small exports)."""
    out = []
    for row in segments.orderBy("part", "segment").toLocalIterator():
        path = Path(folder, f"{row['part']:06d}-{row['segment']:06d}.glbp")
        path.write_bytes(bytes(row["data"]))
        out.append(str(path))
    return out
