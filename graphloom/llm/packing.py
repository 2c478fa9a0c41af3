"""Operator 9: packing documents into sequences by Karmarkar-Karp multiway differencing.

Each document's ids (with the end id) give as many full sequences as they fill; the rest is one item.
Items are gathered to groups of about ``windows`` sequences, and a group is dealt into equal loads by
differencing: the two partial partitions with the largest spread are merged again and again, the
fullest set of one with the emptiest of the other.  Only what must be cut is cut: the longest items,
``CUT`` shares of the group one after the other, go into pieces of ``PIECES`` ids, small ones to fill
what large ones leave.  If a load exceeds the capacity even so, the group is dealt anew over one
more window.

Packing works through each input partition as it comes: no shuffle, no row leaves its task, and
memory is a group and a batch of texts.  Sequence ids carry the partition's number.

Defined results: a null text is its end id alone; repeated rows, and rows of one doc_id with other
texts, are packed each; a null doc_id stays null; very long texts are packed whole; extra columns,
whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` dealt into ``k`` sets of near-equal sums.

    A partial partition is a list of (sum, members) by descending sum, of which the smallest sum is
    subtracted; members are nested pairs, unfolded at the end.
    """
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Only sets with members are kept; up to k are free, and those stand at sum 0 + floor.
        free = k - len(a)
        merged = a + b[:free] if len(b) <= free else a[: k - len(b)] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[k - len(b) :], reversed(b[free:]))] + b[:free]
        merged.sort(key=lambda s: -s[0])
        if len(merged) == k and merged[-1][0]:
            low = merged[-1][0]
            merged = [(s - low, m) for s, m in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, count, merged))
        count += 1
    out = []
    for _, nested in heap[0][2] if heap else []:
        members, work = [], [nested]
        while work:
            x = work.pop()
            if isinstance(x, tuple):
                work += x
            else:
                members.append(x)
        out.append(members)
    return out


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets of indices with sums up to ``capacity``; one more window whenever it is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, k)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return sets
        k += 1


#: Shares of a group that are cut, tried in turn, and the sizes of the pieces in turn.
CUT, PIECES = (0.05, 0.1, 0.2, 1.0), (96, 48, 24, 12)


def cut(sizes: list[int], share: float) -> list[tuple[int, int, int]]:
    """(item, start, length) of the pieces of items, of which the longest ``share`` is cut."""
    out, left = [], share * sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at, k = 0, 0
        while at < sizes[i]:
            length = min(PIECES[k % len(PIECES)], sizes[i] - at) if left > 0 else sizes[i]
            out.append((i, at, length))
            at, k = at + length, k + 1
        left -= sizes[i]
    return out


class Packer:
    """Takes documents, gives rows (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, first: int, capacity: int, windows: int, slack: float):
        self.sequence, self.capacity = first, capacity
        self.goal = max(capacity, int(windows * capacity * (1 - slack)))
        self.items: list[tuple] = []
        self.size = 0

    def add(self, name, ids: np.ndarray) -> list[tuple]:
        """Rows that are settled with this document (ids as 32-bit little-endian)."""
        n, cap, out = len(ids), self.capacity, []
        full = n // cap * cap
        for a in range(0, full, cap):
            out.append((name, a, cap, zlib.crc32(ids[a : a + cap]), n, self.sequence, 0))
            self.sequence += 1
        while full < n:
            length = min(n - full, self.goal - self.size)
            self.items.append((name, full, ids[full : full + length].copy(), n))
            full, self.size = full + length, self.size + length
            if self.size >= self.goal:
                out += self.flush()
        return out

    def flush(self) -> list[tuple]:
        sizes, out, sets = [len(i[2]) for i in self.items], [], None
        for share in CUT:
            pieces = cut(sizes, share)
            lengths = [p[2] for p in pieces]
            sets = differencing(lengths, max(1, -(-self.size // self.capacity)))
            if all(sum(lengths[m] for m in s) <= self.capacity for s in sets):
                break
        else:
            sets = deal(lengths, self.capacity)
        for members in sets:
            offset = 0
            for m in sorted(members, key=lambda m: pieces[m][:2]):
                i, at, length = pieces[m]
                name, start, ids, n = self.items[i]
                out.append((name, start + at, length, zlib.crc32(ids[at : at + length]), n, self.sequence, offset))
                offset += length
            self.sequence += bool(members)
        self.items, self.size = [], 0
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end: int = 0, windows: int = 64, slack: float = 0.008) -> DataFrame:
    """A row for each piece of each document of ``docs`` (doc_id, text).

    Adjacent pieces of a document that land in one sequence are rows of their own.
    """
    common.ship(docs.sparkSession)
    names = [s.split()[0] for s in SCHEMA.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    def apply(frames):
        encoder = tokens.encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, windows, slack)
        last, rows = np.array([end], "<u4"), []
        for frame, first, texts in tokens.batches(frames, 1):
            for name, ids in zip(frame.column(0).slice(first, len(texts)).to_pylist(), encoder.batch(texts)):
                rows += packer.add(name, np.concatenate([ids.astype("<u4"), last]))
            if len(rows) > 4096:
                yield table(rows)
                rows = []
        rows += packer.flush()
        if rows:
            yield table(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, SCHEMA)
