"""Operator 5: language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units of ``HIDDEN`` cells read windows of ``WINDOW`` bytes forwards and
backwards; every position gets language probabilities from both states, and a text's
probabilities are the mean over all its positions.  Whole texts are read, in windows that start
afresh.  Training is backpropagation through time in numpy, in the driver, and so on a sample of a
fixed size: about ``per_language`` texts of each language, chosen by a hash of the id, up to
``per_text`` windows spread over each, and of those ``windows`` in all, the same for each language
(drawn with repetition where there are fewer).  A window that a text doesn't fill teaches by the
bytes it has, so that short texts teach too.  Up to ``languages`` languages are learned, the most frequent
ones, and of many languages fewer texts each, so that the sample keeps its size.

Defined results: a text of any length is read whole, one under ``WINDOW`` bytes as one partial window; null texts and texts without a letter are ``und`` with score 0; rows with a null
``lang`` teach nothing; without any training row every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

HIDDEN = 8
WINDOW = 64
#: Bytes as the network sees them: lower case, digits alike, other ASCII signs alike.
SEEN = np.arange(256, dtype=np.uint8)
SEEN[65:91] += 32
SEEN[48:58] = 48
SEEN[[b for b in range(33, 128) if not chr(b).isalnum()]] = 33
SEEN[[b for b in range(33)]] = 32


@dataclass
class Network:
    """For each direction: input table (3H x 256), recurrent weights (3H x H), output (L x H)."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: list[np.ndarray]
    bias: np.ndarray


def _step(table_part: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step of a gated recurrent unit on columns: (state, gates, candidate, gated recurrence)."""
    k = HIDDEN
    drive = u @ h
    gates = np.tanh((table_part[: 2 * k] + drive[: 2 * k]) * 0.5)
    gates *= 0.5
    gates += 0.5
    inner = gates[k:] * drive[2 * k :]
    new = np.tanh(table_part[2 * k :] + inner)
    return new + gates[:k] * (h - new), gates, new, drive[2 * k :]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(0))
    return x / x.sum(0)


def window_probabilities(net: Network, windows: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Sums of the probabilities over the valid positions of windows (steps x n): languages x n."""
    steps, n = windows.shape
    forward = np.empty((steps, len(net.languages), n), np.float32)
    h = np.zeros((HIDDEN, n), np.float32)
    for t in range(steps):
        h, *_ = _step(net.tables[0].take(windows[t], axis=1), net.recurrent[0], h)
        np.matmul(net.output[0], h, out=forward[t])
    h = np.zeros((HIDDEN, n), np.float32)
    total = np.zeros((len(net.languages), n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, *_ = _step(net.tables[1].take(windows[t], axis=1), net.recurrent[1], h)
        h *= valid[t]  # padding stands at the end: the backward state starts at the last byte
        p = np.exp(forward[t] + net.output[1] @ h + net.bias)
        p *= valid[t] / p.sum(0)
        total += p
    return total


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (steps x n) of whole texts, their valid positions, and the text of each."""
    size = np.diff(offsets)
    each = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), each)
    first = np.concatenate(([0], np.cumsum(each)))[:-1]
    start = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    left = np.minimum(WINDOW, offsets[1:][owner] - start)
    at = start[None, :] + np.arange(WINDOW)[:, None]
    valid = np.arange(WINDOW)[:, None] < left[None, :]
    return np.where(valid, SEEN[data[np.minimum(at, len(data) - 1)]], 32).astype(np.uint8), valid.astype(np.float32), owner


def gradients(p: list[np.ndarray], x: np.ndarray, on: np.ndarray, wanted: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the valid positions of windows ``x`` (steps x n), and its derivatives by the weights ``p``."""
    k, steps, n = HIDDEN, x.shape[0], x.shape[1]
    trace = [[], []]
    for d, times in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
        h = np.zeros((k, n), p[0].dtype)
        for t in times:
            before = h
            h, gates, new, drive = _step(p[d].take(x[t], axis=1), p[2 + d], h)
            h = h * on[t]  # as in use: the backward state starts at the last byte
            trace[d].append((t, before, gates, new, drive, h))
    states = [{s[0]: s[5] for s in trace[d]} for d in (0, 1)]
    said = {t: _softmax(p[4] @ states[0][t] + p[5] @ states[1][t] + p[6]) for t in range(steps)}
    loss = -sum(float((np.log((said[t] * wanted).sum(0) + 1e-30) * on[t]).sum()) for t in range(steps)) / float(on.sum())
    wrong = {t: (said[t] - wanted) * (on[t] / on.sum()) for t in range(steps)}
    g = [np.zeros_like(v) for v in p]
    for t in range(steps):
        g[4] += wrong[t] @ states[0][t].T
        g[5] += wrong[t] @ states[1][t].T
        g[6] += wrong[t].sum(1, keepdims=True)
    for d in (0, 1):
        back = np.zeros((k, n), p[0].dtype)
        for t, before, gates, new, drive, _ in reversed(trace[d]):
            back = (back + p[4 + d].T @ wrong[t]) * on[t]
            keep, reset = gates[:k], gates[k:]
            d_new = back * (1 - keep) * (1 - new**2)
            d_keep = back * (before - new) * keep * (1 - keep)
            d_reset = d_new * drive * reset * (1 - reset)
            into = np.vstack([d_keep, d_reset, d_new])
            recurrent = np.vstack([d_keep, d_reset, d_new * reset])
            np.add.at(g[d].T, x[t], into.T)
            g[2 + d] += recurrent @ before.T
            back = back * keep + p[2 + d].T @ recurrent
    return loss, g


def fit(windows: np.ndarray, targets: np.ndarray, languages: list[str], epochs: int = 12, batch: int = 256, rate: float = 0.01, seed: int = 7, valid: np.ndarray | None = None) -> Network:
    """Backpropagation through time with Adam; the loss is the mean cross-entropy of valid positions."""
    valid = np.ones(windows.shape, np.float32) if valid is None else valid
    rng = np.random.default_rng(seed)
    k, m = HIDDEN, len(languages)
    p = [rng.normal(0, 0.3, (3 * k, 256)), rng.normal(0, 0.3, (3 * k, 256)), rng.normal(0, 0.3, (3 * k, k)), rng.normal(0, 0.3, (3 * k, k)), rng.normal(0, 0.3, (m, k)), rng.normal(0, 0.3, (m, k)), np.zeros((m, 1))]
    p = [x.astype(np.float32) for x in p]
    first, second, count = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    n = windows.shape[1]
    total = max(1, epochs * -(-n // batch))
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            rows = order[a : a + batch]
            _, g = gradients(p, windows[:, rows], valid[:, rows], np.eye(m, dtype=np.float32)[targets[rows]].T)
            size = np.sqrt(sum(float((v**2).sum()) for v in g))
            count += 1
            now = rate * (1 - 0.9 * count / total)
            for i, v in enumerate(g):
                v *= min(1.0, 1.0 / max(size, 1e-9))
                first[i] += 0.1 * (v - first[i])
                second[i] += 0.01 * (v**2 - second[i])
                p[i] -= now * (first[i] / (1 - 0.9**count)) / (np.sqrt(second[i] / (1 - 0.99**count)) + 1e-8)
    return Network(languages, p[0:2], p[2:4], p[4:6], p[6])


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train(docs: DataFrame, per_language: int = 400, windows: int = 3000, seed: int = 19, per_text: int = 16, languages: int = 200) -> Network | None:
    """A network from about ``per_language`` texts of each language outside the held-out fold.

    The driver gets no more than about 100 x ``per_language`` texts of ``per_text`` windows each.
    """
    common.ship(docs.sparkSession)
    rows = docs.where("lang is not null and doc_id is not null").where(~held_out()).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    each = F.least(F.lit(float(per_language)), 100.0 * per_language / F.count("*").over(Window.partitionBy()))
    counts = counts.withColumn("each", each)  # a row for each language, ``languages`` at most
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = rows.join(F.broadcast(counts), "lang").where(rank < F.col("each") / F.col("count")).select("lang", "doc_id", "text")

    def some(frames):
        # A text teaches by windows spread over all of it, so that long ones don't fill the driver.
        for frame in frames:
            for row, data, offsets in common.text_slices(frame.column(2)):
                w, valid, owner = cut(data, offsets) if len(data) else (None, None, np.empty(0, int))
                for i in range(len(offsets) - 1):
                    mine = np.flatnonzero(owner == i)
                    if len(mine):
                        mine = mine[np.linspace(0, len(mine) - 1, min(per_text, len(mine))).astype(int)]
                        yield pa.RecordBatch.from_arrays([frame.column(0).slice(row + i, 1), frame.column(1).slice(row + i, 1), pa.array([np.ascontiguousarray(w[:, mine].T).tobytes()], pa.binary()), pa.array([valid[:, mine].sum(0).astype(np.uint8).tobytes()], pa.binary())], ["lang", "doc_id", "windows", "sizes"])

    got = chosen.mapInArrow(some, "lang string, doc_id long, windows binary, sizes binary").toArrow().to_pandas().sort_values(["lang", "doc_id"])
    got = got[got.windows.map(len) > 0]
    languages = sorted(got.lang.unique().tolist())  # from here on, their names
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    parts, sizes, targets = [], [], []
    for k, name in enumerate(languages):
        all_windows = np.frombuffer(b"".join(got.windows[got.lang == name]), np.uint8).reshape(-1, WINDOW)
        some = max(1, windows // len(languages))
        take = rng.choice(len(all_windows), some, replace=len(all_windows) < some)
        parts.append(all_windows[take].T)
        sizes.append(np.frombuffer(b"".join(got.sizes[got.lang == name]), np.uint8)[take])
        targets.append(np.full(len(take), k))
    valid = (np.arange(WINDOW)[:, None] < np.concatenate(sizes)[None, :]).astype(np.float32)
    return fit(np.hstack(parts), np.concatenate(targets), languages, valid=valid)


def label(docs: DataFrame, net: Network | None, said: str = "lang_pred", sure: str = "score") -> DataFrame:
    """``docs`` (doc_id, text, ...) with the language and its probability for every row."""
    common.ship(docs.sparkSession)
    names = [c for c in docs.columns if c not in (said, sure)]
    docs = docs.select(*[f"`{c}`" for c in names], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    shape = T.StructType([*docs.schema.fields[:-1], T.StructField(said, T.StringType()), T.StructField(sure, T.DoubleType())])

    def apply(frames):
        for frame in frames:
            lettered = frame.column(len(names)).to_numpy(zero_copy_only=False)
            best, top = np.zeros(frame.num_rows, int), np.zeros(frame.num_rows)
            for row, data, offsets in common.text_slices(frame.column(names.index("text")), 1 << 19):
                if net is None or not len(data):
                    continue
                windows, valid, owner = cut(data, offsets)
                sums = np.zeros((len(net.languages), len(offsets) - 1))
                for a in range(0, len(owner), 2048):
                    got = window_probabilities(net, np.ascontiguousarray(windows[:, a : a + 2048]), np.ascontiguousarray(valid[:, a : a + 2048]))
                    for k in range(len(sums)):
                        sums[k] += np.bincount(owner[a : a + 2048], got[k], len(offsets) - 1)
                best[row : row + len(offsets) - 1] = sums.argmax(0)
                top[row : row + len(offsets) - 1] = sums.max(0) / np.maximum(1, np.diff(offsets))
            on = lettered & (net is not None)
            language = [net.languages[b] if o else "und" for b, o in zip(best.tolist(), on.tolist())]
            yield pa.RecordBatch.from_arrays([*(frame.column(i) for i in range(len(names))), pa.array(language, pa.string()), pa.array(np.where(on, np.clip(top, 0, 1), 0.0))], [*names, said, sure])

    return docs.mapInArrow(apply, shape)


def identify(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""
    scored = label(docs.select("doc_id", "text"), train(docs, per_language))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
