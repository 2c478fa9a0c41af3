"""Operator 1: similarity self-join on word n-grams by a chosen-path recursion.

Each text is a set of hashed shingles (``n`` consecutive words, lower-cased letter by letter in
all scripts; a text of fewer words is one shingle) embedded as ``POSITIONS`` min-hash tokens.  A run picks one token
position; texts that share the token there fall into a bucket.  A bucket over ``leaf`` members
is split again on further sampled positions, up to ``DEPTH`` levels, unless its members are so
alike that splitting can't part them; what is then small or alike is compared by brute force, a
large bucket block against block.  Runs are
repeated until the chance that a pair at the threshold never meets is below ``1 - recall``.

Equal sets collapse to one representative first, which gets a number of its own.  Members that meet in several buckets are
charged to the first bucket they share, so each link is counted once and no list of pairs is
ever built: a bucket gives per-member link counts and one link to its local root.
Where an earlier bucket holds most of a bucket's members, pairs within that part aren't looked at again.
Candidates pass a sketch filter five standard deviations below the threshold and are then held
to the exact Jaccard of the whole sets.

Defined results: null, empty or word-less texts have no shingle and link with nothing; copies
(rows with equal sets, repeated rows included) link with each other.  Very long texts are read whole
and their blocks are smaller.  A class is named by its smallest doc_id, a null one only where it has no
other; rows with a null doc_id link like others.  Similarities equal to the threshold link.  Extra
columns, whatever their names, are ignored; no rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

POSITIONS = 128
DEPTH = 3
FANOUT = 2
#: Members whose mean similarity makes a bucket one to compare rather than to split, and how
#: many of a bucket's members (about) are looked at for that.
ALIKE, LOOKED_AT = 0.5, 32
#: Shingles of a block at most, unless a single text has more.
BLOCK_ITEMS = 1 << 20
_FACTORS = (np.random.default_rng(20240601).integers(0, 1 << 31, POSITIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_MASKS = np.random.default_rng(77).integers(0, 1 << 32, POSITIONS, dtype=np.uint32)


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``."""
    met = threshold * (1 - (1 - threshold) ** FANOUT) ** (DEPTH - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def slot_tree(runs: int, seed: int = 5) -> tuple[list[tuple[int, ...]], dict[int, list[int]]]:
    """Position tuples of all slots, and the child slots of each: the sampled paths."""
    rng = np.random.default_rng(seed)
    slots = [(int(p),) for p in rng.choice(POSITIONS, runs, replace=runs > POSITIONS)]
    level, children = list(range(runs)), {}
    for _ in range(DEPTH - 1):
        below = []
        for s in level:
            free = [p for p in range(POSITIONS) if p not in slots[s]]
            children[s] = list(range(len(slots), len(slots) + FANOUT))
            slots += [(*slots[s], int(p)) for p in rng.choice(free, FANOUT, replace=False)]
            below += children[s]
        level = below
    return slots, children


def lowered(column: pa.Array) -> pa.Array:
    """Texts with every letter in lower case, each by itself (no final sigma, one letter for one)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:  # bytes that are no UTF-8: they stay, the letters around them are lowered
        texts = [None if t is None else t.decode("utf-8", "surrogateescape") for t in column.cast(pa.large_binary()).to_pylist()]
        out = [None if t is None else "".join(c.lower()[0] for c in t).encode("utf-8", "surrogateescape") for t in texts]
        return pa.array(out, pa.large_binary()).view(pa.large_string())


def shingle_sets(column: pa.Array, n: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, in runs of texts."""
    odd = [common.mix64(np.array([i + 1], U64))[0] | U64(1) for i in range(n)]
    for _, data, offsets in common.text_slices(lowered(column)):
        starts, stops, firsts = common.word_spans(data, offsets)
        words = common.span_hashes(data, starts, stops)
        whole = np.zeros(max(0, len(words) - n + 1), U64)
        for i in range(n):
            whole += words[i : i + len(whole)] * odd[i]
        whole = common.mix64(whole)
        out = []
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(whole[a : b - n + 1]))
            elif b > a:
                part = np.array([b - a], U64)
                for i in range(b - a):
                    part = part * odd[0] + words[a + i : a + i + 1] * odd[i]
                out.append(common.mix64(part))
            else:
                out.append(np.empty(0, U64))
        yield out


def set_identity(items: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a = common.mix64(np.array([items.sum(dtype=U64) + U64(len(items))], U64))[0]
        b = common.mix64(items + U64(0x632BE59BD9B4E019)).sum(dtype=U64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash tokens (len(sets) x POSITIONS) of non-empty sets."""
    flat = np.concatenate(sets)
    low = (flat >> U64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), POSITIONS), np.uint32)
    held = np.empty_like(low)
    for i in range(POSITIONS):
        np.multiply(low ^ _MASKS[i], _FACTORS[i], out=held)
        out[:, i] = np.minimum.reduceat(held, at)
    return out


def bucket_keys(sketch: np.ndarray, slots: list[tuple[int, ...]], which: list[int]) -> np.ndarray:
    """Bucket keys of rows (one column for each slot of ``which``)."""
    out = np.empty((len(sketch), len(which)), U64)
    for k, s in enumerate(which):
        key = np.full(len(sketch), s + 1, U64)
        for p in slots[s]:
            key = common.mix64(key * U64(0x9FB21C651E98DF25) + sketch[:, p].astype(U64))
        out[:, k] = key | U64(1)
    return out


def _signatures(n: int, runs: int):
    slots, _ = slot_tree(runs)

    def apply(frames):
        for frame in frames:
            row = 0
            for sets in shingle_sets(frame.column(1), n):
                full = [i for i, s in enumerate(sets) if len(s)]
                rows, row = frame.column(0).slice(row, len(sets)).take(pa.array(full, pa.int64())), row + len(sets)
                if not full:
                    continue
                found = [sets[i] for i in full]
                sketch = sketches(found)
                names = np.array([set_identity(s) for s in found], np.int64)
                keys = bucket_keys(sketch, slots, list(range(runs))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, runs, dtype=np.int32), keys.ravel())],
                    ["doc_id", "h1", "h2", "items", "sketch", "keys"],
                )

    return apply


def _children(runs: int):
    slots, below = slot_tree(runs)

    def apply(frames):
        for frame in frames:
            if not frame.num_rows:
                continue
            sketch = np.frombuffer(b"".join(frame.column(3).to_pylist()), np.uint32).reshape(-1, POSITIONS)
            rid, items, slot = (frame.column(i).to_numpy() for i in (0, 1, 2))
            for s in np.unique(slot).tolist():
                mine = slot == s
                keys = bucket_keys(sketch[mine], slots, below[s]).view(np.int64)
                for k, child in enumerate(below[s]):
                    yield pa.RecordBatch.from_arrays([pa.array(rid[mine]), pa.array(items[mine]), pa.array(np.full(len(keys), child, np.int32)), pa.array(keys[:, k])], ["rid", "items", "slot", "key"])

    return apply


def _likeness(frames):
    """Mean sketch similarity of the members at hand of each bucket."""
    for table, ends in common.batches(frames, "key", 4096):
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, POSITIONS)
        means = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            i, j = np.triu_indices(min(b - a, 4 * LOOKED_AT), 1)
            means.append(float((sketch[a + i] == sketch[a + j]).mean()) if len(i) else 0.0)
        yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks().take(pa.array(ends[:-1])), pa.array(means)], ["key", "alike"])


def _owners(column: pa.Array, width: int) -> np.ndarray:
    """Rows x slots: the key of the leaf bucket that a row is in, else 0."""
    flat = column.flatten()
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    out = np.zeros((len(column), width), np.int64)
    out[rows, flat.field("slot").to_numpy()] = flat.field("key").to_numpy()
    return out


def _owned(owner: np.ndarray, i: np.ndarray, j: np.ndarray, slot: int) -> np.ndarray:
    """Whether ``slot`` is the first one in which rows i and j share a leaf bucket."""
    out = np.empty(len(i), bool)
    for a in range(0, len(i), 1 << 15):
        x = owner[i[a : a + (1 << 15)]]
        same = (x == owner[j[a : a + (1 << 15)]]) & (x != 0)
        out[a : a + (1 << 15)] = same.argmax(1) == slot
    return out


def _met_before(owner: np.ndarray, slot: int) -> np.ndarray:
    """Rows of the largest leaf bucket of an earlier slot that is among the given rows: their pairs are owned there."""
    best = np.zeros(len(owner), bool)
    for s in np.flatnonzero((owner[:, :slot] != 0).any(0)).tolist():
        names, place, times = np.unique(owner[:, s], return_inverse=True, return_counts=True)
        times[names == 0] = 0
        if times.max() > max(1, best.sum()):
            best = place == times.argmax()
    return best


def _row_pairs(n: int, side: np.ndarray, met: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a group, or those over the two sides of a cell, in blocks of rows; none between rows ``met``."""
    first = np.arange(n) if met is None else np.flatnonzero(~met)
    step = max(1, (1 << 17) // max(1, n))
    cross = bool(side.any())
    for a in range(0, len(first), step):
        i, j = np.meshgrid(first[a : a + step], np.arange(n), indexing="ij")
        keep = i < j if met is None else (i < j) | met[j]  # a pair of one row met and one not is seen from the latter
        if cross:
            keep &= side[i] != side[j]
        yield i[keep], j[keep]


def _candidates(width: int, least: int):
    """Rows of each group that have a likely partner there."""

    def apply(frames):
        for table, ends in common.batches(frames, "cell"):
            sketch = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(-1, POSITIONS)
            owner = _owners(table.column("own").combine_chunks(), width)
            side, slot = (table.column(c).to_numpy() for c in ("side", "slot"))
            hit = np.zeros(table.num_rows, bool)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if b - a < 2:
                    continue
                met = _met_before(owner[a:b], int(slot[a])) if b - a > 8 else None
                for i, j in _row_pairs(b - a, side[a:b], met):
                    near = (sketch[a + i] == sketch[a + j]).sum(1) >= least
                    if near.any():
                        i, j = a + i[near], a + j[near]
                        good = _owned(owner, i, j, int(slot[a]))
                        hit[i[good]] = True
                        hit[j[good]] = True
            kept = table.drop_columns(["bits"]).filter(pa.array(hit))
            yield from kept.to_batches()

    return apply


def _sets(n: int):
    """Replace the text by its shingles; rows whose text isn't the representative's go."""

    def apply(frames):
        for frame in frames:
            table, row = pa.Table.from_batches([frame]), 0
            for sets in shingle_sets(frame.column(frame.schema.get_field_index("text")), n):
                part = table.slice(row, len(sets))
                row += len(sets)
                names = zip(part.column("h1").to_pylist(), part.column("h2").to_pylist())
                right = np.array([len(s) > 0 and set_identity(s) == name for s, name in zip(sets, names)], bool)
                part = part.drop_columns(["text", "h1", "h2"])
                part = part.append_column("items", pa.array([s.tobytes() for s in sets], pa.binary())).filter(pa.array(right))
                yield from part.to_batches()

    return apply


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of blocks of the incidence matrix."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    names, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float64)
    step = max(256, (1 << 22) // n)
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, (a, a + step))
        block = np.zeros((n, step), np.float32)
        block[row[lo:hi], column[lo:hi] - a] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _verify(width: int, threshold: float):
    def apply(frames):
        for table, ends in common.batches(frames, "cell", 512):
            owner = _owners(table.column("own").combine_chunks(), width)
            side, slot, rid, copies = (table.column(c).to_numpy() for c in ("side", "slot", "rid", "copies"))
            items = table.column("items").to_pylist()
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                pick = a + np.unique(rid[a:b], return_index=True)[1]  # a repeated row counts once
                if len(pick) < 2:
                    continue
                sets = [np.frombuffer(items[x], U64) for x in pick]
                sizes = np.array([len(s) for s in sets])
                common_items = overlaps(sets)
                links, left, right = np.zeros(len(pick), np.int64), [], []
                for i, j in _row_pairs(len(pick), side[pick]):
                    both = common_items[i, j]
                    near = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
                    i, j = i[near], j[near]
                    good = _owned(owner, pick[i], pick[j], int(slot[a]))
                    i, j = i[good], j[good]
                    np.add.at(links, i, copies[pick[j]])
                    np.add.at(links, j, copies[pick[i]])
                    left.append(i)
                    right.append(j)
                root = common.local_roots(len(pick), np.concatenate(left), np.concatenate(right))
                on = links > 0
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(rid[pick][on]), pa.array(links[on]), pa.array(rid[pick][root[on]])], ["rid", "links", "root"])

    return apply


def ngram_jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, leaf: int = 256, recall: float = 1 - 1e-7, block: int = 2048) -> DataFrame:
    """(doc_id, class_id, n_links, kept) for every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id reachable over links, ``n_links`` the number of other rows
    with similarity of ``threshold`` or more, ``kept`` whether the row is its class's first.
    """
    common.ship(docs.sparkSession)
    runs = runs_for(threshold, recall)
    slots, _ = slot_tree(runs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = math.floor(POSITIONS * threshold - 5 * math.sqrt(POSITIONS * threshold * (1 - threshold)))

    signed = common.materialize(docs.mapInArrow(_signatures(n, runs), "doc_id long, h1 long, h2 long, items long, sketch binary, keys array<long>"), "signed")
    reps = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("items").alias("items"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    reps, seen = common.materialize_observed(reps.withColumn("rid", F.monotonically_increasing_id()), "reps", n=F.count("*"))

    rows, leaves, total = reps.select("rid", "items", F.posexplode("keys").alias("slot", "key")), None, runs * seen["n"]
    for level in range(DEPTH):
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("items").alias("all_items")).where("n > 1")
        found = common.with_counted(rows, sizes, "key", total).withColumnRenamed("n", "size")
        found, seen = common.materialize_observed(found, "rows", large=F.count_if(F.col("size") > leaf))
        large = found.where(F.col("size") > leaf)
        if level == DEPTH - 1 or not seen["large"]:
            leaves = found if leaves is None else leaves.unionByName(found)
            break
        looked_at = large.where(F.pmod(F.xxhash64("rid", "key"), F.ceil(F.col("size") / LOOKED_AT)) == 0).join(reps.select("rid", "sketch"), "rid")
        alike = looked_at.select("key", "sketch").repartition("key").sortWithinPartitions("key").mapInArrow(_likeness, "key long, alike double")
        alike = common.materialize(alike.where(F.col("alike") >= ALIKE), "alike").select("key")
        settled = found.where(F.col("size") <= leaf).unionByName(large.join(alike, "key", "left_semi"))
        leaves = settled if leaves is None else leaves.unionByName(settled)
        split = large.join(alike, "key", "left_anti")
        below = split.join(reps.select("rid", "sketch"), "rid").select("rid", "items", "slot", "sketch").mapInArrow(_children(runs), "rid long, items long, slot int, key long")
        rows, total = common.materialize(below, "below"), FANOUT * seen["large"]  # stored: read by the counts and by the join

    # A large bucket is cut into blocks, by members and by shingles; every pair of blocks is a group of its own.
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("all_items") / BLOCK_ITEMS)).cast("int")
    owned = leaves.groupBy("rid").agg(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), "key", F.least(blocks, F.col("size").cast("int")).alias("blocks"))).alias("leaf"))
    bits = reps.select("rid", "h1", "h2", "doc_id", "copies", "sketch").join(owned, "rid")
    spread = bits.select("rid", "h1", "h2", "doc_id", "copies", "sketch", F.transform("leaf", lambda x: F.struct(x.slot.alias("slot"), x.key.alias("key"))).alias("own"), F.inline("leaf"))
    spread = spread.withColumn("block", F.pmod(F.hash("rid"), F.col("blocks")))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    spread = spread.select("rid", "doc_id", "copies", "slot", "own", cell.alias("cell"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), (F.col("block") == F.col("other")).alias("within"), "sketch", "h1", "h2")
    shape = "rid long, doc_id long, copies long, slot int, own array<struct<slot:int,key:long>>, cell long, side int, h1 long, h2 long"
    narrow = spread.mapInArrow(_narrow, f"{shape}, bits binary")
    near = narrow.repartition("cell").sortWithinPartitions("cell").mapInArrow(_candidates(len(slots), least), shape)
    near = common.materialize(near, "near")

    texts = docs.withColumnRenamed("doc_id", "of").join(near, F.col("of").eqNullSafe(F.col("doc_id"))).drop("of")
    sets = texts.select("rid", "copies", "slot", "own", "cell", "side", "h1", "h2", "text").mapInArrow(_sets(n), "rid long, copies long, slot int, own array<struct<slot:int,key:long>>, cell long, side int, items binary")
    linked = sets.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verify(len(slots), threshold), "rid long, links long, root long")
    linked = common.materialize(linked, "linked")

    known = common.classes(reps.select("rid", "h1", "h2", F.col("doc_id").alias("id"), "copies"), linked)
    whole = signed.select("doc_id", "h1", "h2").join(known, ["h1", "h2"]).select("doc_id", "class_id", "n_links")
    # Texts without words are in no set: their rows come from the input itself.
    plain = docs.where(~F.coalesce("text", F.lit("")).rlike("[0-9A-Za-z]|[^\\x00-\\x7f]")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return whole.unionByName(plain).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _narrow(frames):
    """Keep the low byte of each token, and set the sides of groups that stand for two blocks."""
    for frame in frames:
        if not frame.num_rows:
            continue
        sketch = np.frombuffer(b"".join(frame.column(8).to_pylist()), np.uint8).reshape(-1, 4 * POSITIONS)[:, ::4]
        within = frame.column(7).to_numpy(zero_copy_only=False)
        side = np.where(within, 0, frame.column(6).to_numpy() + 1).astype(np.int32)
        columns = [frame.column(i) for i in range(6)] + [pa.array(side), frame.column(9), frame.column(10), pa.array([x.tobytes() for x in sketch], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "copies", "slot", "own", "cell", "side", "h1", "h2", "bits"])
