"""Operator 10: exact top-k by integer inner product, with a ball tree for each shard.

Candidates are dealt into shards and queries into blocks; each pair of shard and block is a group
of its own, so neither side is ever sent whole to a task.  A group's candidates come first: their
ball tree is built once, and the block's queries stream past it, some at a time.  The search
descends depth first with all of them at once: a node is left to those queries whose bound
(q . centre + |q| radius) can still reach their kth score, children with the higher mean bound
first.  The first shard is searched before all others, and its kth scores start the rest.

A shard is at most ``shard`` rows and ``shard_bytes``, smaller where that leaves cores idle.  Candidates
are copied once for each ``block`` queries: up to that number they are shuffled once.  Vectors
of different lengths have no inner product and never meet.  Scores are exact below 2**53.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part,
neither as queries nor as candidates.  Rows with the query's own vec_id aren't its candidates.
A query row that is repeated is answered once; a candidate row that is repeated counts each time.
A vec_id with several different vectors is one query: its k best over all of them, where a
candidate may stand once for each of them.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

LEAF = 64


class BallTree:
    """Centres, radii, children and row ranges over the rows of ``x`` in ``order``."""

    def __init__(self, x: np.ndarray):
        self.order, self.centre, self.radius, self.children, self.span = np.arange(len(x)), [], [], [], []
        self._grow(x, 0, len(x))

    def _grow(self, x: np.ndarray, a: int, b: int) -> int:
        rows = self.order[a:b]
        mine, node = x[rows], len(self.span)
        centre = mine.mean(0)
        away = np.sqrt(((mine - centre) ** 2).sum(1))
        self.centre.append(centre)
        self.radius.append(away.max())
        self.span.append((a, b))
        self.children.append(())
        if b - a > LEAF and away.max() > 0:
            far = mine[away.argmax()]
            other = mine[((mine - far) ** 2).sum(1).argmax()]
            self.order[a:b] = rows[np.argsort(mine @ (other - far), kind="stable")]
            middle = (a + b) // 2
            self.children[node] = (self._grow(x, a, middle), self._grow(x, middle, b))
        return node


def search(tree: BallTree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, qid: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Top k (scores, ids) of each query over the rows of ``x``; a score below its ``floor`` may be left out."""
    scores, names = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    least, norm = floor.copy(), np.sqrt((q * q).sum(1))

    def bound(node: int, active: np.ndarray) -> np.ndarray:
        return (q[active] @ tree.centre[node] + norm[active] * tree.radius[node]) * (1 + 1e-12) + 1e-6

    def visit(node: int, active: np.ndarray, above: np.ndarray) -> None:
        active = active[above >= least[active]]  # earlier leaves may have raised the kth score
        if not len(active):
            return
        if not tree.children[node]:
            a, b = tree.span[node]
            rows = tree.order[a:b]
            for s in range(0, len(active), max(1, (1 << 20) // (b - a))):
                some = active[s : s + max(1, (1 << 20) // (b - a))]
                got = q[some] @ x[rows].T
                got[qid[some][:, None] == ids[rows][None, :]] = -np.inf
                better = got.max(1) >= least[some]
                some, got = some[better], got[better]
                all_scores, all_names = np.hstack([scores[some], got]), np.hstack([names[some], np.broadcast_to(ids[rows], got.shape)])
                order = np.lexsort((all_names, -all_scores), axis=1)[:, :k]
                scores[some], names[some] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_names, order, 1)
                least[some] = np.maximum(least[some], scores[some, -1])
            return
        ways = [(bound(c, active), c) for c in tree.children[node]]
        for above, child in sorted(ways, key=lambda w: -w[0].mean()):
            visit(child, active, above)

    everyone = np.arange(len(q))
    visit(0, everyone, bound(0, everyone))
    return scores, names


_KEYS = ["dim", "shard", "block", "query"]


def _groups(k: int):
    def apply(frames):
        at, held, tree = None, [], None
        for frame in frames:
            table = pa.Table.from_batches([frame])
            ends = [0, *common.group_ends(table, _KEYS).tolist(), table.num_rows] if table.num_rows else [0]
            for a, b in zip(ends[:-1], ends[1:]):
                part = table.slice(a, b - a)
                dim, shard, block, query = (part.column(c)[0].as_py() for c in _KEYS)
                if (dim, shard, block) != at:
                    at, held, tree = (dim, shard, block), [], None
                if not query:
                    held.append(part)
                    continue
                if tree is None:
                    if not held:
                        continue  # a shard without candidates
                    whole = pa.concat_tables(held)
                    x, ids = vectors.matrix(whole.column("vec"), dim, "<f8"), whole.column("vec_id").to_numpy()
                    tree, held = BallTree(x), [None]
                for i in range(0, part.num_rows, 2048):
                    some = part.slice(i, 2048)
                    qid, floor = some.column("vec_id").to_numpy(), some.column("floor").to_numpy()
                    scores, names = search(tree, x, ids, vectors.matrix(some.column("vec"), dim, "<f8"), qid, k, floor)
                    row, rank = np.nonzero(np.isfinite(scores))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(names[row, rank]), pa.array(scores[row, rank].astype(np.int64))], ["query_id", "vec_id", "score"])

    return apply


def exact_top_k(frame: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, scale: float = 256.0, shard: int = 1 << 16, block: int = 1 << 16, shard_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``frame`` that ``queries`` selects, against all rows."""
    spark = frame.sparkSession
    common.ship(spark)
    good = vectors.packed(frame, "<f8", lambda x: np.floor(scale * x)).where("vec is not null and vec_id is not null")
    # Equal rows are one candidate that counts up to k times: more can't show.
    rows = good.groupBy("dim", "vec_id", "vec").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    rows = common.materialize(rows, "vectors")
    asked_for = F.expr(queries)
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(asked_for).alias("q")).where("q > 0")
    idle = F.ceil(F.col("n") / (2 * spark.sparkContext.defaultParallelism))
    size = F.least(F.lit(shard), F.greatest(F.lit(2048), idle), F.greatest(F.lit(1024), F.floor(F.lit(shard_bytes) / (8 * F.col("dim")))))
    counts = counts.select("dim", F.ceil(F.col("n") / size).cast("int").alias("shards"), F.ceil(F.col("q") / block).cast("int").alias("blocks"))
    counts, seen = common.materialize_observed(counts, "lengths", n=F.count("*"), shards=F.max("shards"))
    counts = F.broadcast(counts) if seen["n"] <= 100_000 else counts  # a row for each length
    known = rows.join(counts, "dim")
    start = F.lit(float("-inf"))
    dealt = known.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.col("shards")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("dim", "shard", "block", F.lit(False).alias("query"), "vec_id", "vec", start.alias("floor"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("__copy")).drop("__copy")
    asked = known.where(asked_for).select("dim", "shards", F.pmod(F.xxhash64("vec_id", "vec", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("query"), "vec_id", "vec")

    def wave(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        groups = candidates.unionByName(queries.select(candidates.columns))
        return groups.repartition("dim", "shard", "block").sortWithinPartitions(*_KEYS).mapInArrow(_groups(k), "query_id long, vec_id long, score long")

    found = wave(dealt.where("shard = 0"), asked.withColumn("shard", F.lit(0)).withColumn("floor", start))
    if (seen["shards"] or 0) > 1:
        found = common.materialize(found, "topk")
        # With k scores at hand the least of them is a floor for every other shard.
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), False).alias("best"))
        floors = floors.select("vec_id", F.when(F.col("n") >= k, F.element_at("best", k)).cast("double").alias("reached"))
        raised = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("reached", start)).where("shards > 1")
        raised = raised.withColumn("shard", F.explode(F.sequence(F.lit(1), F.col("shards") - 1)))
        found = found.unionByName(wave(dealt.where("shard > 0"), raised))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
