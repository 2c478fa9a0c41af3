"""Operator 3: quality classifier, a factorisation machine over hashed words and structure.

A text is its word occurrences (hashed to ``BUCKETS`` names, each of weight 1/sqrt(words)), a few
statistics of its characters, words and lines, and its length as stored (``n_chars``, where the
table has it).  The score is the logistic of a bias, linear weights and all pairwise products
of the features through ``RANK`` latent factors, computed in linear time as half of
(sum v x)^2 - sum (v x)^2.

The model is fitted in numpy on at most ``sample`` labelled documents, chosen by a hash of their id;
executors turn those into features, so texts stay where they are, and a document comes as its
different words with counts (no more than ``BUCKETS``).

Defined results: null and empty texts get the score of their (empty) features; labels that are
null or outside 0 and 1 teach nothing; several labels of one document count as their maximum;
of rows that share a doc_id, one teaches: that whose text has the smallest hash, so reruns agree;
without any label every score is 0.5.  Very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import U64

BUCKETS = 1 << 15
RANK = 8
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "wide": range(128, 256), "stop": (33, 44, 46, 58, 59, 63), "bar": (124,), "bang": (33,), "line": (10,)}
_NAMES = [*_KINDS, "symbol"]
#: Weights of a byte in the character statistics.
_TABLE = np.array([[b in _KINDS[k] for k in _KINDS] for b in range(256)], np.float32)
_TABLE = np.hstack([_TABLE, 1 - _TABLE[:, :6].max(1, keepdims=True)])
STATS = len(_NAMES) + 8


def features(column: pa.Array, lengths: np.ndarray | None = None):
    """(first row, word buckets, offsets of their texts, statistics) of runs of texts."""
    kinds = (_TABLE * (1 << np.arange(_TABLE.shape[1]))).sum(1).astype(np.uint16)
    bits = ((np.arange(1 << _TABLE.shape[1])[:, None] >> np.arange(_TABLE.shape[1])) & 1).astype(np.float32)
    classes, code = np.unique(kinds, return_inverse=True)
    code = code.astype(np.uint8)
    for row, data, offsets in common.text_slices(column):
        n = len(offsets) - 1
        starts, stops, firsts = common.word_spans(data, offsets)
        hashes = common.span_hashes(LOWER[data], starts, stops)
        words = np.diff(firsts)
        owner = np.repeat(np.arange(n), words)
        size = np.maximum(1, np.diff(offsets))
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        counts = np.bincount(doc * np.int32(len(classes)) + code[data], minlength=n * len(classes)).reshape(n, -1)
        shares = counts @ bits[classes] / size[:, None]
        spaces = (shares[:, _NAMES.index("space")] * size) + 1
        long = stops - starts
        total = np.bincount(owner, long, n)
        square = np.bincount(owner, long.astype(float) ** 2, n)
        each = np.maximum(1, words)
        different = _distinct(hashes, owner, n)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        repeats = np.bincount(owner[again], minlength=n)
        # Lines: spans between line feeds, repeated ones by their hashes.
        is_line = np.arange(256) != 10
        begin, end, at = common.word_spans(data, offsets, is_line)
        lines = np.diff(at)
        line_owner = np.repeat(np.arange(n), lines)
        distinct_lines = _distinct(common.span_hashes(data, begin, end), line_owner, n)
        stored = np.diff(offsets) if lengths is None else lengths[row : row + n]
        rest = np.column_stack([total / each / 10, np.sqrt(np.maximum(0, square / each - (total / each) ** 2)) / 10, different / each, repeats / each, distinct_lines / np.maximum(1, lines), words / spaces, np.log1p(size) / 10, np.log1p(np.maximum(0, stored)) / 10])
        yield row, (hashes >> U64(49)).astype(np.uint16), firsts, np.hstack([shares, rest]).astype(np.float32)


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each owner."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


@dataclass
class Machine:
    """Weights: rows are word buckets, then statistics; column 0 linear, the rest latent."""

    bias: float
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, buckets: np.ndarray, firsts: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = len(firsts) - 1
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        dense = self.weights[BUCKETS:]
        words = np.diff(firsts)
        value = (1 / np.sqrt(np.maximum(1, words))).astype(np.float32)
        sums, squares = np.zeros((n, RANK + 1), np.float32), np.zeros(n, np.float32)
        if len(buckets):
            full = np.flatnonzero(words)
            rows = self.weights[buckets]
            sums[full] = np.add.reduceat(rows, firsts[full], axis=0) * value[full, None]
            squares[full] = np.add.reduceat((self.weights[:, 1:] ** 2).sum(1)[buckets], firsts[full]) * value[full] ** 2
        sums += x @ dense
        squares += x**2 @ (dense[:, 1:] ** 2).sum(1)
        return self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)


def fit(words: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray, steps: int = 1000, batch: int = 128, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Fit by ``steps`` (or a little more, to whole epochs) mini-batch gradient steps with per-weight rates.

    A document is its different word buckets and their counts, whose occurrences all weigh the same:
    sums over occurrences are sums over buckets times counts.
    """
    rng = np.random.default_rng(seed)
    weights = np.zeros((BUCKETS + STATS, RANK + 1), np.float32)
    weights[:, 1:] = rng.normal(0, 0.02, (len(weights), RANK))
    if not len(y):
        return Machine(0.0, np.zeros_like(weights), np.zeros(STATS, np.float32), np.ones(STATS, np.float32))
    mean, scale = stats.mean(0), stats.std(0) + 1e-3
    model = Machine(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), weights, mean, scale)
    seen, bias_seen = np.full(weights.shape, 1e-2, np.float32), 1e-2
    value = np.array([1 / np.sqrt(max(1, n.sum())) for _, n in words], np.float32)
    entries = [(n * v).astype(np.float32) for (_, n), v in zip(words, value)]
    sizes = np.array([len(w) for w, _ in words])
    number, room = np.empty(BUCKETS, np.int64), np.empty(batch * (BUCKETS + STATS), np.float32)
    for _ in range(-(-steps // -(-len(y) // batch))):
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            rows = order[a : a + batch]
            flat = np.concatenate([words[r][0] for r in rows.tolist()])
            number[:] = 0
            number[flat] = 1
            used = np.flatnonzero(number)
            number[used] = np.arange(len(used))
            # Batch documents by batch buckets, then statistics.
            width = len(used) + STATS
            once = room[: len(rows) * width]
            once[:] = 0
            once[np.repeat(np.arange(len(rows)) * width, sizes[rows]) + number[flat]] = np.concatenate([entries[r] for r in rows.tolist()])
            once = once.reshape(len(rows), width)
            once[:, len(used) :] = np.clip((stats[rows] - mean) / scale, -6, 6)
            index = np.concatenate([used, np.arange(BUCKETS, BUCKETS + STATS)])
            now, so_far = weights.take(index, axis=0), seen.take(index, axis=0)
            step, pull = gradient(model.bias, now, once, value[rows], y[rows])
            step += decay * now
            so_far += step * step
            step *= rate
            step /= np.sqrt(so_far)
            now -= step
            weights[index], seen[index] = now, so_far
            bias_seen += pull**2
            model.bias -= rate * float(pull / np.sqrt(bias_seen))
    return model


def gradient(bias: float, weights: np.ndarray, once: np.ndarray, value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Derivatives of the mean loss by ``weights`` (column 0 linear, the rest latent) and by the bias.

    ``once`` is documents by features: a word's count times the ``value`` of one occurrence in that
    document, and at the end the ``STATS`` statistics.  Linear: g x; latent: g (x sum - v x^2), where the
    squares of a word's occurrences add up to its entry times the value.
    """
    split = weights.shape[0] - STATS
    x, energy = once[:, split:], (weights[:, 1:] ** 2).sum(1)
    sums = once @ weights
    squares = value * (once[:, :split] @ energy[:split]) + x**2 @ energy[split:]
    logits = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
    g = ((1 / (1 + np.exp(-logits)) - y) / len(y)).astype(once.dtype)
    sums[:, 0] = 1
    out = once.T @ np.hstack([g[:, None] * sums, (g * value)[:, None]])
    own = out[:, -1].copy()
    own[split:] = x.T**2 @ g
    out = out[:, :-1]
    out[:, 1:] -= own[:, None] * weights[:, 1:]
    return out, float(g.sum())


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Machine:
    """A model from at most ``sample`` labelled rows outside the held-out fold."""
    common.ship(docs.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text", _stored_length(docs).alias("n_chars"))
    picked = rows.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    # Rows of one id become one before anything is sent, on the side that reads them first.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "n_chars", "quality")).alias("one")
    picked = picked.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.n_chars", "one.quality")

    def apply(frames):
        for frame in frames:
            for row, buckets, firsts, stats in features(frame.column(1), _lengths(frame.column(2), frame.column(1))):
                n = len(firsts) - 1
                words = [np.unique(buckets[a:b], return_counts=True) for a, b in zip(firsts[:-1], firsts[1:])]
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(row, n), frame.column(3).slice(row, n), pa.array([w.tobytes() for w, _ in words], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in words], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], ["doc_id", "quality", "words", "counts", "stats"])

    got = picked.mapInArrow(apply, "doc_id long, quality int, words binary, counts binary, stats binary").toArrow().sort_by("doc_id")
    words = [(np.frombuffer(w, np.uint16), np.frombuffer(c, np.int32)) for w, c in zip(got.column("words").to_pylist(), got.column("counts").to_pylist())]
    stats = np.frombuffer(b"".join(got.column("stats").to_pylist()), np.float32).reshape(-1, STATS)
    return fit(words, stats, got.column("quality").to_numpy().astype(np.float32))


def _lengths(column: pa.Array, texts: pa.Array) -> np.ndarray:
    """Stored lengths; characters of the text where there is none."""
    import pyarrow.compute as pc

    return pc.coalesce(column, pc.utf8_length(texts).cast(pa.float64())).fill_null(0).to_numpy(zero_copy_only=False)


def _stored_length(docs: DataFrame) -> Column:
    return F.expr("try_cast(n_chars as double)") if "n_chars" in docs.columns else F.lit(None).cast("double")


def score(docs: DataFrame, model: Machine, name: str = "score") -> DataFrame:
    """``docs`` (doc_id, text, ...) with a score for every row, in a column ``name``."""
    common.ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]
    source = docs.select(*[f"`{c}`" for c in kept], _stored_length(docs).alias("__length"))
    shape = T.StructType([*source.schema.fields[:-1], T.StructField(name, T.DoubleType())])

    def apply(frames):
        text = kept.index("text")
        for frame in frames:
            lengths = _lengths(frame.column(len(kept)), frame.column(text))
            out = np.empty(frame.num_rows)
            for row, buckets, firsts, stats in features(frame.column(text), lengths):
                out[row : row + len(firsts) - 1] = model.logits(buckets, firsts, stats)
            yield pa.RecordBatch.from_arrays([*(frame.column(i) for i in range(len(kept))), pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40))))], [*kept, name])

    return source.mapInArrow(apply, shape)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 8000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    source = docs.select("doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else []))
    scored = score(source, train(docs, labels, sample))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
