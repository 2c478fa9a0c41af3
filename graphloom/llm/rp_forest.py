"""Operator 2: embedding near-duplicates by a forest of random-projection trees with spill.

Vectors of different lengths never meet: each length has its own forest, for the ``FORESTS``
commonest lengths with more than ``leaf`` different vectors; another length is a single leaf.
Trees are fitted in the driver on at most ``sample`` vectors of a length (a fixed bound, and no more
than ``sample_bytes``): a node projects on a random direction and cuts at the median, and vectors
within ``spill`` of it, by rank, go to both sides.  Where links are among the members looked at, it
takes of several directions and cuts the one that parts the fewest; a node whose members are mostly
within the threshold isn't split.  The links that some vectors have in the sample are then looked
up in the forest, and while the leaves hold less than ``recall`` of them it is fitted again with
leaves four times as large, up to a single one.  Every vector is then indexed in every tree.
Within a leaf all pairs are compared by cosine in double precision; a leaf over ``block`` vectors
is compared block against block, so what the sample did not foresee costs more tasks but loses nothing.

Directions come from a pool of ``POOL``, drawn from a seed on each worker: what is sent to tasks is
cuts and numbers, some 20 bytes a node whatever the vectors' length.

Equal vectors collapse to one representative, which gets a number of its own.  A pair that shares
several leaves belongs to the first, so links are counted once and no list of pairs is built.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links
with nothing.  Repeated rows are copies and link; a null vec_id is never the name of a component
that has another.  Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors


#: Share of linked pairs that makes a node one to compare rather than to split, how many of its
#: members are looked at for that, and the directions and cuts tried where links are at stake.
ALIKE, LOOKED_AT, TRIES, CUTS = 0.5, 256, 12, (0.5, 0.35, 0.65, 0.2, 0.8)
#: Directions that all trees of a length choose from, and lengths that get a forest.
POOL, FORESTS = 1024, 8
#: Rows of a table of leaf sizes up to which it is broadcast.
SMALL = 1_000_000

_pools: dict[tuple[int, int], np.ndarray] = {}


def pool(dim: int, seed: int) -> np.ndarray:
    """The directions of a length; a worker keeps them from task to task."""
    if (dim, seed) not in _pools:
        _pools[dim, seed] = np.random.default_rng((seed, dim)).standard_normal((POOL, dim))
    return _pools[dim, seed]


def _cut(x: np.ndarray, rows: np.ndarray, ways: np.ndarray, spill: float, threshold: float, rng: np.random.Generator) -> tuple[int, float] | None:
    """Direction and rank of the cut of a node, or nothing if its members are alike."""
    seen = x[rows if len(rows) <= LOOKED_AT else rng.choice(rows, LOOKED_AT, replace=False)]
    tried = rng.choice(len(ways), TRIES, replace=False).tolist()
    i, j = np.nonzero(np.triu(seen @ seen.T >= threshold, 1))
    if not len(i):
        return tried[0], CUTS[0]
    if len(i) >= ALIKE * len(seen) * (len(seen) - 1) / 2:
        return None
    best = None
    for way in tried:
        at = seen @ ways[way]
        low, high = np.minimum(at[i], at[j]), np.maximum(at[i], at[j])
        for cut in CUTS:
            a, b = np.quantile(at, (cut - spill, cut + spill)) if spill < min(cut, 1 - cut) else (at.min(), at.max())
            parted = int(((low < a) & (high > b)).sum())
            if best is None or parted < best[0]:
                best = parted, way, cut
        if not best[0]:
            break
    return best[1:]


def fit_tree(x: np.ndarray, ways: np.ndarray, leaf: int, spill: float, rng: np.random.Generator, threshold: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (by number), (low, high) cuts and children of inner nodes; a child below 0 is leaf ``-1 - child``."""
    directions, cuts, children, leaves = [], [], [], 0
    work = [(np.arange(len(x)), None, 0)]
    while work:
        rows, parent, side = work.pop()
        name = None
        split = _cut(x, rows, ways, spill, threshold, rng) if len(rows) > leaf else None
        if split:
            way, cut = split
            at = x[rows] @ ways[way]
            low, high = np.quantile(at, (max(0.0, cut - spill), min(1.0, cut + spill))).astype(np.float32)
            left, right = rows[at <= high], rows[at >= low]
            if max(len(left), len(right)) < len(rows):
                name = len(directions)
                directions.append(way)
                cuts.append((low, high))
                children.append([0, 0])
                work += [(left, name, 0), (right, name, 1)]
        if name is None:
            name, leaves = -1 - leaves, leaves + 1
        if parent is not None:
            children[parent][side] = name
    return np.array(directions, np.int16), np.array(cuts, np.float32).reshape(-1, 2), np.array(children, np.int32).reshape(-1, 2)


def leaves_of(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], ways: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every place of every row in a tree."""
    directions, cuts, children = tree
    if not len(directions):
        return np.arange(len(x)), np.zeros(len(x), np.int64)
    rows, found, work = [], [], [(0, np.arange(len(x)))]
    while work:
        node, mine = work.pop()
        if not len(mine):
            continue
        if node < 0:
            rows.append(mine)
            found.append(np.full(len(mine), -1 - node))
            continue
        at = x[mine] @ ways[directions[node]]
        work += [(int(children[node, 0]), mine[at <= cuts[node, 1]]), (int(children[node, 1]), mine[at >= cuts[node, 0]])]
    return np.concatenate(rows), np.concatenate(found)


def share_met(x: np.ndarray, forest, ways: np.ndarray, threshold: float, rng: np.random.Generator, some: int = 512) -> tuple[int, int]:
    """How many of the links that ``some`` vectors have in ``x`` lie within leaves, and all of them."""
    some = rng.choice(len(x), min(some, len(x)), replace=False)
    held = []
    for tree in forest:
        rows, leaf = leaves_of(x, tree, ways)
        order = np.argsort(leaf, kind="stable")
        held.append((rows[order], np.searchsorted(leaf[order], np.arange(leaf.max() + 2))))
    found = total = 0
    for a in range(0, len(some), 64):
        mine = some[a : a + 64]
        near = x[mine] @ x.T >= threshold
        near[np.arange(len(mine)), mine] = False
        met = np.zeros_like(near)
        for tree, (rows, ends) in zip(forest, held):
            for r, leaf in zip(*(v.tolist() for v in leaves_of(x[mine], tree, ways))):
                met[r, rows[ends[leaf] : ends[leaf + 1]]] = True
        found, total = found + int((near & met).sum()), total + int(near.sum())
    return found, total


def fit_forest(x: np.ndarray, trees: int, leaf: int, spill: float, threshold: float, recall: float, seed: int) -> list:
    """Trees whose leaves hold at least ``recall`` of the links looked up (three are taken for chance)."""
    ways = pool(x.shape[1], seed)
    while True:
        rng = np.random.default_rng(seed)
        forest = [fit_tree(x, ways, leaf, spill, rng, threshold) for _ in range(trees)]
        if leaf >= len(x):
            return forest
        found, total = share_met(x, forest, ways, threshold, rng)
        if total - found <= (1 - recall) * total + 3:
            return forest
        leaf *= 4


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _assign(forests: dict[int, list], seed: int, kind: str):
    def apply(frames):
        for batch in frames:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                for a in range(0, len(mine), 2048):
                    part = batch.take(pa.array(mine[a : a + 2048]))
                    if dim not in forests:
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([[0]] * part.num_rows, pa.list_(pa.int32()))], ["rid", "copies", "dim", "vec", "own"])
                        continue
                    x, forest, ways = unit(vectors.matrix(part.column(3), dim, kind)), forests[dim], pool(dim, seed)
                    step = 1 + max(max(0, -int(t[2].min())) if len(t[2]) else 1 for t in forest)
                    rows, places = [], []
                    for t, tree in enumerate(forest):
                        r, leaf = leaves_of(x, tree, ways)
                        rows.append(r)
                        places.append(leaf + t * step)
                    rows, places = np.concatenate(rows), np.concatenate(places)
                    places = places[np.lexsort((places, rows))]
                    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(x)))))
                    own = pa.ListArray.from_arrays(ends.astype(np.int32), places.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*part.columns, own], ["rid", "copies", "dim", "vec", "own"])

    return apply


def _earlier(own: list[np.ndarray], leaf: int) -> np.ndarray:
    """Whether two rows of a leaf also share a leaf that comes before it."""
    size = [len(o) for o in own]
    flat, row = np.concatenate(own), np.repeat(np.arange(len(own)), size)
    before = flat < leaf
    _, column = np.unique(flat[before], return_inverse=True)
    held = np.zeros((len(own), column.max() + 1 if len(column) else 1), np.float32)
    held[row[before], column] = 1
    return held @ held.T > 0


def _roots(near: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row; rows are read once, so no list of pairs is built."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            root[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & (root < 0))
                root[front] = i
    return root


def _compare(kind: str, threshold: float):
    def apply(frames):
        for table, ends in common.batches(frames, ["cell", "dim", "leaf"], 4096):
            rid, copies, leaf, side, dims = (table.column(c).to_numpy() for c in ("rid", "copies", "leaf", "side", "dim"))
            matrices = {d: unit(vectors.matrix(table.column("vec").take(pa.array(np.flatnonzero(dims == d))), d, kind)) for d in np.unique(dims).tolist()}
            place = np.empty(len(dims), np.int64)  # of each row in the matrix of its length
            for d in matrices:
                place[dims == d] = np.arange(len(matrices[d]))
            lists = table.column("own").combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if b - a < 2:
                    continue
                x = matrices[int(dims[a])][place[a] : place[a] + b - a]  # a cell has one length
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                if side[a:b].any():
                    near &= side[a:b, None] != side[None, a:b]
                if not near.any():
                    continue
                hot = np.flatnonzero(near.any(1))
                near = near[np.ix_(hot, hot)] & ~_earlier([flat[at[a + h] : at[a + h + 1]] for h in hot.tolist()], int(leaf[a]))
                links = near @ copies[a + hot]
                root = _roots(near)
                on = links > 0
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(rid[a + hot][on]), pa.array(links[on].astype(np.int64)), pa.array(rid[a + hot[root]][on])], ["rid", "links", "root"])

    return apply


def _sample(reps: DataFrame, dim: int, count: int, most: int, kind: str) -> np.ndarray:
    """At most ``most`` vectors of a length, the same in every run."""
    part = min(1.0, 0.95 * most / max(1, count))  # the limit below then cuts nothing, and reruns agree
    drawn = reps.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(part * (1 << 30)))).select("vec").limit(most).toArrow()
    x = unit(vectors.matrix(drawn.column(0), dim, kind)) if len(drawn) else np.zeros((0, dim))
    return x[np.lexsort(x.T)]  # the fit doesn't depend on the order of arrival


def embedding_near_duplicates(frame: DataFrame, threshold: float = 0.9, trees: int = 12, leaf: int = 256, spill: float = 0.05, sample: int = 65_536, block: int = 2048, seed: int = 3, recall: float = 0.98, sample_bytes: int = 1 << 28) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``frame`` (vec_id, embedding)."""
    common.ship(frame.sparkSession)
    kind = vectors.element_type(frame)
    rows = common.materialize(vectors.packed(frame, kind, zero_ok=False), "vectors")
    reps = rows.where("vec is not null").groupBy("dim", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    reps = common.materialize(reps.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    common_lengths = reps.groupBy("dim").count().where(F.col("count") > leaf).orderBy(F.desc("count"), "dim").limit(FORESTS).collect()
    forests = {}
    for dim, count in common_lengths:
        x = _sample(reps, dim, count, min(sample, max(leaf, sample_bytes // (8 * dim))), kind)
        small = max(8, math.floor(leaf * len(x) / max(1, count)))
        forests[dim] = fit_forest(x, trees, small, spill, threshold, recall, seed)

    shape = "rid long, copies long, dim int, vec binary, own array<int>"
    placed = common.materialize(reps.select("rid", "copies", "dim", "vec").mapInArrow(_assign(forests, seed, kind), shape), "placed")
    # Only leaves over a block are cut; how many there are decides how their table is joined.
    sizes = placed.select("dim", F.explode("own").alias("leaf")).groupBy("dim", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    sizes, seen = common.materialize_observed(sizes, "sizes", n=F.count("*"))
    sizes = F.broadcast(sizes) if seen["n"] <= SMALL else sizes
    cells = placed.select("*", F.explode("own").alias("leaf")).join(sizes, ["dim", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("block", F.pmod(F.hash("rid"), F.col("blocks")))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("rid", "copies", "dim", "vec", "own", "leaf", F.xxhash64("dim", "leaf", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))
    linked = cells.repartition("cell").sortWithinPartitions("cell", "dim", "leaf").mapInArrow(_compare(kind, threshold), "rid long, links long, root long")
    linked = common.materialize(linked, "linked")

    known = common.classes(reps.select("rid", "dim", "vec", "id", "copies"), linked)
    good = rows.where("vec is not null").join(known, ["dim", "vec"]).select("vec_id", "n_links", F.col("class_id").alias("component_id"))
    bad = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
