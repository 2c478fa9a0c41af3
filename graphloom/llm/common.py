"""Shared pieces of the training-data operators: hashing, grouping, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import materialize, materialize_observed, shared_dir, ship  # noqa: F401  shared by all operators

U64 = np.uint64
#: Bytes that belong to a word: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTES = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Text bytes handled at once by the vectorised hashing, to bound a worker's memory.
SLICE_BYTES = 2 << 20

_BASE = U64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


# ---------------------------------------------------------------- words and hashes


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    return x ^ (x >> U64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of whole texts; a null is an empty text.

    A text over ``limit`` bytes makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (with a final total)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = table[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    edges = offsets[offsets <= len(data)]
    begins = inside & ~before
    begins[edges] |= inside[edges]
    ends = before & ~inside
    ends[edges] |= before[edges]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans by prefix sums of a polynomial hash."""
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[stops] - sums[starts]) * down[starts])


def group_ends(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows of ``table`` at which one of the keys changes."""
    import pyarrow.compute as pc

    new = np.zeros(max(0, table.num_rows - 1), bool)
    for key in keys:
        column = table.column(key)
        new |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def batches(frames: Iterator[pa.RecordBatch], keys: str | list[str], target: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from rows sorted by ``keys``, with the group offsets.

    A group is never cut; groups are gathered until ``target`` rows.
    """
    keys = [keys] if isinstance(keys, str) else keys
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in frames:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < target:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        ends = group_ends(table, keys)
        if len(ends):
            cut = int(ends[-1])
            yield table.slice(0, cut), np.concatenate(([0], ends))
            rest = table.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.concatenate(([0], group_ends(table, keys), [table.num_rows]))


# ---------------------------------------------------------------- components


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the given links."""
    root = np.arange(n)
    if not len(left):
        return root
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        root = root[root]
        if (root == before).all():
            return root


#: Rows of one key up to which it is never hot, and the most keys that can be hot at a time.
HOT, MOST_HOT = 512, 100_000


def with_counted(rows: DataFrame, counted: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``counted`` (key, n, ...), which has a row for each key and its number of ``rows``.

    Keys of more than total / ``MOST_HOT`` rows are fewer than ``MOST_HOT``, so their part is broadcast,
    and the rows of a hot key stay where they are.
    """
    hot = max(HOT, total // MOST_HOT)
    if total <= hot:
        return rows.join(counted, key)
    hubs = F.broadcast(counted.where(F.col("n") > hot))
    few = rows.join(F.broadcast(counted.where(F.col("n") > hot).select(key)), key, "left_anti").join(counted.where(F.col("n") <= hot), key)
    return rows.join(hubs, key).unionByName(few)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of links (a, b): the smallest node reachable.

    Alternating large-star and small-star steps.  Every step is a partial minimum by node, which is
    then brought to the node's links; the rows of a step never exceed the links.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    sums = {"n": F.count("*"), "h": F.sum(F.hash("u", "v").cast("long")), "su": F.sum(F.col("u").cast("decimal(38,0)")), "sv": F.sum(F.col("v").cast("decimal(38,0)"))}
    links, seen = materialize_observed(links, "links", **sums)
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = with_counted(both, low, "u", 2 * seen["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_counted(large, low, "u", 2 * seen["n"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links, now = materialize_observed(small.where("u <> v").distinct(), "links", **sums)
        if now == seen:
            return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classes(reps: DataFrame, linked: DataFrame) -> DataFrame:
    """Class and link count of representatives (rid, id, copies, ...).

    ``linked`` has (rid, links, root) rows from comparisons: links to count, and a link to follow.
    """
    parts = components(linked.select(F.col("rid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rid")
    counts = linked.groupBy("rid").agg(F.sum("links").alias("links"))
    known = reps.join(counts, "rid", "left").join(parts, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    firsts = known.groupBy("component").agg(F.min("id").alias("class_id"))
    count = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return known.join(firsts, "component").withColumn("n_links", count).drop("component", "links", "id", "copies")
