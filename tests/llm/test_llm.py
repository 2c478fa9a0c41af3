"""The training-data operators against brute force, SQL, round trips and held-out accuracy."""

import collections
import hashlib
import json
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from graphloom.llm import ball_tree, catalogue, chat_format, language_gru, ngram_join, packing, quality_fm, rp_forest, source_mix, token_planes, tokens, url_filter

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, size int, `key` string"


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", "s"), None if t is None else len(t), 7, 8, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n", "a", "one two three four", "Ünï çødé 日本 words here go on", "x" * 30_000, "word " * 6000, "same text of six words here", "same text of six words here"]


# ---------------------------------------------------------------- 1


def brute_links(texts):
    sets = [set(s.tolist()) for part in ngram_join.shingle_sets(pa.array(texts, pa.string()), 5) for s in part]
    n, links, low = len(texts), [0] * len(texts), list(range(len(texts)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(n)]


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    base, passage, texts = rng.choices(words, k=120), rng.choices(words, k=60), list(ODD)
    for _ in range(260):
        near = list(base)
        for _ in range(rng.randrange(5)):
            near[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(near))
    texts += [" ".join(rng.choices(words, k=30) + passage + rng.choices(words, k=10)) for _ in range(120)]
    # Small leaf and block: recursion, alike buckets and block pairs all take part.
    out = ngram_join.ngram_jaccard_join(docs_of(spark, texts), leaf=24, block=50).toPandas().sort_values("doc_id")
    links, classes = brute_links(texts)
    assert out.n_links.tolist() == links and out.class_id.tolist() == classes
    assert (out.kept == (out.doc_id == out.class_id)).all()


def plain_shingles(text, n=5):
    """Shingles by the definition, without the operator's own code."""
    words = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", "".join(c.lower()[0] for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def test_ngram_join_takes_no_notice_of_case(spark):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("wort", "été", "живой", "über", "x1") for b in ("", "än", "ñu", "я", "k", "zed")]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    texts += [t.upper() for t in texts[:10]] + [t.title() for t in texts[5:15]] + [" ".join(w.upper() if i > 50 else w for i, w in enumerate(t.split())) for t in texts[12:20]] + ["ABC def", "abc DEF", "", None, *ODD[4:6]]
    sets = [plain_shingles(t) for t in texts]
    links = [sum(i != j and bool(a) and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    out = ngram_join.ngram_jaccard_join(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    assert out.n_links.tolist() == links and sum(links) > 50


def test_ngram_join_of_null_ids_and_ties(spark):
    """Rows with null and repeated ids link like others; a similarity of exactly 0.8 links; long texts in small blocks."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=12)  # 8 shingles
    tie = [*base, "x"]  # 9 shingles, 8 of them shared: 8/9
    half = [*base[:-1], "y"]  # 7 of 9 shared: below
    exact = [f"t{i}" for i in range(13)]  # 9 shingles against 9 with one other at each end: 8 of 10
    other = ["z", *exact[:-1]]
    texts = [(None, base), (None, base), (3, tie), (3, half), (4, exact), (5, other), (None, words[:40]), (8, ["w1"] * 30_000)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    out = ngram_join.ngram_jaccard_join(docs).toPandas()
    sets = [plain_shingles(" ".join(t)) for _, t in texts]
    links = [sum(i != j and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert links[4:6] == [1, 1] and len(sets[4] & sets[5]) * 5 == 4 * len(sets[4] | sets[5])
    got = sorted((-1 if pd.isna(r.doc_id) else r.doc_id, r.n_links) for r in out.itertuples())
    assert got == sorted((-1 if i is None else i, n) for (i, _), n in zip(texts, links))
    assert out[out.doc_id.isna()].sort_values("n_links").class_id.fillna(-1).tolist() == [-1, 3, 3]


def test_lower_case_of_broken_text():
    raw = pa.array(["ÀB".encode() + b"\xff" + "ŞİЖ".encode(), "ÀBŞİЖ".encode(), None], pa.binary()).cast(pa.large_binary()).view(pa.large_string())
    got = ngram_join.lowered(raw).view(pa.large_binary()).to_pylist()
    assert got == ["àb".encode() + b"\xff" + "şiж".encode(), "àbşiж".encode(), None]
    assert ngram_join.lowered(raw.slice(1)).to_pylist() == ["àbşiж", None]


def test_ngram_join_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = docs.orderBy("doc_id").toPandas().text.tolist()
    out = catalogue.op1_ngram_jaccard_join(spark, SMALL).toPandas().sort_values("doc_id")
    links, classes = brute_links(texts)
    assert out.n_links.tolist() == links and out.class_id.tolist() == classes


# ---------------------------------------------------------------- 2, 10


def clustered(n=600, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 3):
        x[i] = x[rng.integers(n)] + rng.normal(size=dim) * 0.12
    x[5] = x[6] = x[7]
    return x.astype(np.float32)


VECTORS = "vec_id long, embedding array<float>, label int, rid long, cell long"


def test_forest_equals_brute_force(spark):
    x = clustered()
    rows = [(i, v.tolist(), 0, 1, 2) for i, v in enumerate(x)] + [(900, None, 0, 1, 2), (901, [0.0] * 16, 0, 1, 2), (902, [float("nan")] * 16, 0, 1, 2), (903, [1.0], 0, 1, 2), (904, [None] * 16, 0, 1, 2), (905, [], 0, 1, 2)]
    out = rp_forest.embedding_near_duplicates(spark.createDataFrame(rows, VECTORS), leaf=48, block=40).toPandas().set_index("vec_id")
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = out.n_links.reindex(range(len(x))).to_numpy()
    assert (got <= near.sum(1)).all() and got.sum() >= 0.99 * near.sum()
    assert len(out) == len(rows) and (out.loc[900:905].n_links == 0).all() and out.loc[900:905].kept.all()
    assert out.component_id[[5, 6, 7]].nunique() == 1


def test_mixed_lengths_agree_with_sql(spark, tmp_path):
    """Vectors of three lengths, a null id, repeated ids: each length meets its own, in code and in SQL."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(360):
        dim = (16, 16, 3, 5)[i % 4]
        x = rng.normal(size=dim) if i < 200 else np.array(rows[i - 200][1]) + rng.normal(size=dim) * 0.1
        rows.append((i, x.astype(np.float32).tolist(), 0, 1, 2))
    rows += [(400, [1.0, 2.0, 3.0], 0, 1, 2), (401, [1.0, 2.0, 3.0], 0, 1, 2), (450, [0.5], 0, 1, 2), (451, [0.25], 0, 1, 2), (500, [], 0, 1, 2), (550, None, 0, 1, 2), (551, [None, 1.0], 0, 1, 2), (600, [0.0, 0.0, 0.0], 0, 1, 2)]
    frame = spark.createDataFrame(rows, VECTORS)
    frame.coalesce(1).write.parquet(str(tmp_path / "embeddings"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings/*.parquet')")
    for name, got in (("op2_embedding_near_dedup", rp_forest.embedding_near_duplicates(frame, leaf=32, block=20)), ("op10_exact_top_k", ball_tree.exact_top_k(frame, shard=50))):
        got, want = got.toPandas(), con.execute(catalogue.oracle_sql()[name]).df()[got.columns]
        assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def test_forest_sends_little_to_tasks():
    """Cuts and numbers only: below 10 MB at 1,024 components, with as many nodes as the sample allows."""
    import pickle

    rng = np.random.default_rng(0)
    x = rp_forest.unit(rng.normal(size=(2048, 1024)))
    tree = rp_forest.fit_tree(x, rp_forest.pool(1024, 3), 8, 0.0, rng)
    nodes = len(tree[0])
    assert len(pickle.dumps(tree)) / nodes * 12 * (65_536 / 2) < 10 << 20


def test_ball_tree_of_an_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [0.25, 2.0]), (3, [0.0, 0.0])]
    out = ball_tree.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).toPandas()
    assert out.sort_values("rank")[["vec_id", "score"]].values.tolist() == [[2, 131072], [1, 65536], [1, 32768]]


def test_forest_keeps_the_links_of_a_large_cluster(spark):
    """A third of all vectors in one cluster, at cosines of about 0.95 and about 0.9."""
    rng = np.random.default_rng(8)
    for noise in (0.05, 0.1):
        x = rng.normal(size=(3000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x[:1000] = x[0] + np.sqrt(noise / (1 - noise)) * x[:1000]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = u @ u.T >= 0.9
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = rp_forest.embedding_near_duplicates(frame, leaf=32, block=200).toPandas().sort_values("vec_id").n_links.to_numpy()
        want = near.sum(1) - 1
        assert (got <= want).all() and got.sum() >= 0.97 * want.sum()


def test_ball_tree_equals_brute_force(spark):
    x = np.floor(256 * clustered(700).astype(float))
    rows = [(i, (v / 256).tolist(), 0, 1, 2) for i, v in enumerate(x)] + [(1000, None, 0, 1, 2), (1050, [float("inf")] * 16, 0, 1, 2), (700, (x[3] / 256).tolist(), 0, 1, 2), (700, (x[3] / 256).tolist(), 0, 1, 2)]
    out = ball_tree.exact_top_k(spark.createDataFrame(rows, VECTORS), shard=90, block=5).toPandas()
    ids, every = np.array([*range(700), 700, 700]), np.vstack([x, x[3], x[3]])
    assert set(out.query_id) == set(range(0, 701, 50))
    for q, found in out.sort_values("rank").groupby("query_id"):
        scores = every @ every[np.flatnonzero(ids == q)[0]]
        mine = np.flatnonzero(ids != q)
        best = mine[np.lexsort((ids[mine], -scores[mine]))[:5]]
        assert found.vec_id.tolist() == ids[best].tolist() and found.score.tolist() == scores[best].astype(int).tolist()


# ---------------------------------------------------------------- 3, 5


def test_quality_held_out(spark):
    out = catalogue.op3_quality_classifier(spark, MIDDLE).toPandas()
    labels = pd.read_parquet(f"{MIDDLE}/labels.parquet").merge(out, on="doc_id")
    fold = labels[labels.held_out]
    assert all(out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id])
    assert len(fold) > 40 and (fold.predicted == fold.quality).mean() > 0.94
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, None, 0), (8, 0, 1), (77, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_fm.classify(docs_of(spark, ODD), labels).toPandas()
    assert len(out) == len(ODD) and out.score.between(0, 1).all()
    none = quality_fm.classify(docs_of(spark, ODD), labels.where("false")).toPandas()
    assert (none.score == 0.5).all()
    assert quality_fm.score(docs_of(spark, ODD), quality_fm.fit([], np.empty((0, quality_fm.STATS)), np.empty(0)), "size").count() == len(ODD)


def test_machine_matches_the_pairwise_sum():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(0, 0.2, (quality_fm.BUCKETS + quality_fm.STATS, quality_fm.RANK + 1)).astype(np.float32), np.zeros(quality_fm.STATS), np.ones(quality_fm.STATS))
    words, stats = rng.integers(0, quality_fm.BUCKETS, 6), rng.normal(size=(1, quality_fm.STATS))
    index = [*words, *range(quality_fm.BUCKETS, quality_fm.BUCKETS + quality_fm.STATS)]
    value = [1 / np.sqrt(6)] * 6 + stats[0].tolist()
    want = 0.3 + sum(m.weights[i, 0] * v for i, v in zip(index, value))
    want += sum(value[a] * value[b] * float(m.weights[index[a], 1:] @ m.weights[index[b], 1:]) for a in range(len(index)) for b in range(a))
    assert m.logits(words, np.array([0, 6]), stats)[0] == pytest.approx(want, rel=1e-4)


def test_quality_gradient_matches_differences_of_the_loss():
    """The fit's derivatives against differences of the loss of the pairwise form, word by word."""
    rng = np.random.default_rng(2)
    words, buckets = [[3, 1, 1, 0], [], [1, 2]], 4
    weights, bias = rng.normal(0, 0.3, (buckets + quality_fm.STATS, quality_fm.RANK + 1)), 0.1
    x, y = rng.normal(size=(3, quality_fm.STATS)), np.array([1.0, 0.0, 1.0])

    def loss():
        out = 0.0
        for w, s, t in zip(words, x, y):
            index, value = [*w, *range(buckets, len(weights))], [1 / np.sqrt(max(1, len(w)))] * len(w) + s.tolist()
            z = bias + sum(weights[i, 0] * v for i, v in zip(index, value))
            z += sum(value[a] * value[b] * float(weights[index[a], 1:] @ weights[index[b], 1:]) for a in range(len(index)) for b in range(a))
            out += (np.log1p(np.exp(z)) - t * z) / len(y)
        return out

    times = np.array([[w.count(k) for k in range(buckets)] for w in words], float)
    value = np.array([1 / np.sqrt(max(1, len(w))) for w in words])
    got, pull = quality_fm.gradient(bias, weights, np.hstack([times * value[:, None], x]), value, y)
    for i in range(len(weights)):
        for column in (0, 3):
            before, sides = weights[i, column], []
            for way in (1e-5, -1e-5):
                weights[i, column] = before + way
                sides.append(loss())
            weights[i, column] = before
            assert got[i, column] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-8)
    base = loss()
    bias += 1e-6
    assert pull == pytest.approx((loss() - base) / 1e-6, rel=1e-3)


def test_quality_of_repeated_ids_is_the_same_in_every_run(spark):
    rows = [(i % 40, f"text {i} of many words {i * i} {'z' * (i % 7)}", 10) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    a, b = (quality_fm.train(d, labels) for d in (docs, docs.orderBy(docs.text.desc()).repartition(5)))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_language_held_out(spark):
    out = catalogue.op5_language_id(spark, MIDDLE).toPandas().merge(pd.read_parquet(f"{MIDDLE}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    fold = out[out.held_out]
    assert all(out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id])
    assert (fold.lang_pred == fold.lang).mean() > 0.97


def test_language_odd_rows(spark):
    out = language_gru.identify(docs_of(spark, [*ODD, "12 34 --"], lang="xx")).toPandas().sort_values("doc_id")
    assert out.lang_pred.tolist() == ["und"] * 3 + ["xx"] * 7 + ["und"] and out.score.between(0, 1).all()
    assert (language_gru.identify(docs_of(spark, ODD, lang=None)).toPandas().lang_pred == "und").all()


def test_language_of_short_texts_is_learned(spark):
    rng = random.Random(6)
    said = lambda letters, k: " ".join("".join(rng.choices(letters, k=4)) for _ in range(k))
    rows = [(i, said("abcde", 60), "long") for i in range(80)] + [(100 + i, said("vwxyz", 6), "short") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_gru.identify(docs).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "lang"]), on="doc_id")
    fold = out[out.held_out]
    assert set(fold.lang) == {"long", "short"} and (fold.lang_pred == fold.lang).all()


def plain_probabilities(net, text):
    """The network by its equations, a byte at a time: update and reset gates, candidate, both ways, softmax."""
    k, sig = language_gru.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    seen = [int(language_gru.SEEN[b]) for b in text]

    def states(way, order):
        h, out = np.zeros(k), {}
        for t in order:
            entry, u = net.tables[way][:, seen[t]], net.recurrent[way]
            keep, reset = sig(entry[:k] + u[:k] @ h), sig(entry[k : 2 * k] + u[k : 2 * k] @ h)
            new = np.tanh(entry[2 * k :] + reset * (u[2 * k :] @ h))
            h = keep * h + (1 - keep) * new
            out[t] = h
        return out

    ahead, back = states(0, range(len(seen))), states(1, range(len(seen) - 1, -1, -1))
    sums = np.zeros(len(net.languages))
    for t in range(len(seen)):
        z = net.output[0] @ ahead[t] + net.output[1] @ back[t] + net.bias[:, 0]
        e = np.exp(z - z.max())
        sums += e / e.sum()
    return sums


def test_language_network_equals_its_equations(spark):
    """Labels of whole texts, long and short, against the network run a byte at a time."""
    rng = np.random.default_rng(9)
    k = language_gru.HIDDEN
    draw = lambda *shape: rng.normal(0, 0.5, shape).astype(np.float32)
    net = language_gru.Network(["p", "q", "r"], [draw(3 * k, 256), draw(3 * k, 256)], [draw(3 * k, k), draw(3 * k, k)], [draw(3, k), draw(3, k)], draw(3, 1))
    texts = ["a", "Ab 12 %$ zé", "x" * 63, "y z" * 40, "long text " * 31]
    out = language_gru.label(docs_of(spark, texts), net).toPandas().sort_values("doc_id")
    for text, got in zip(texts, out.itertuples()):
        data = text.encode()
        sums = sum(plain_probabilities(net, data[a : a + language_gru.WINDOW]) for a in range(0, len(data), language_gru.WINDOW)) / len(data)
        assert got.lang_pred == net.languages[int(sums.argmax())] and got.score == pytest.approx(sums.max(), abs=1e-4)


def test_language_gradient_matches_differences_of_the_loss():
    """Backpropagation through time against finite differences, with windows that are partly filled."""
    rng = np.random.default_rng(4)
    k, m, steps, n = language_gru.HIDDEN, 3, 6, 4
    p = [rng.normal(0, 0.4, s) for s in ((3 * k, 256), (3 * k, 256), (3 * k, k), (3 * k, k), (m, k), (m, k), (m, 1))]
    x, wanted = rng.integers(97, 101, (steps, n)).astype(np.uint8), np.eye(m)[rng.integers(0, m, n)].T
    on = (np.arange(steps)[:, None] < np.array([6, 3, 1, 5])[None, :]).astype(float)
    _, g = language_gru.gradients(p, x, on, wanted)
    for i, v in enumerate(p):
        for _ in range(12):
            at = (rng.integers(v.shape[0]), 97 + rng.integers(4) if i < 2 else rng.integers(v.shape[1]))
            before, sides = v[at], []
            for way in (1e-5, -1e-5):
                v[at] = before + way
                sides.append(language_gru.gradients(p, x, on, wanted)[0])
            v[at] = before
            assert g[i][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-8)


def test_language_training_learns_byte_patterns():
    """Training lowers the loss and learns two byte patterns."""
    w = np.hstack([np.tile(np.frombuffer(b"abab", np.uint8)[:, None], (4, 20)), np.tile(np.frombuffer(b"cdcd", np.uint8)[:, None], (4, 20))])
    net = language_gru.fit(w, np.repeat([0, 1], 20), ["p", "q"], epochs=20, batch=8)
    p = language_gru.window_probabilities(net, w, np.ones(w.shape, np.float32)) / len(w)
    assert p[0, :20].min() > 0.9 and p[1, 20:].min() > 0.9


# ---------------------------------------------------------------- 4


def test_chat_round_trip(spark):
    rows = [(1, 2, "user", "<|turn|>&lt;|&amp;"), (1, 1, "assistant", "a<|im_end|>\n<|im_start|>user\nx"), (1, 3, "user", None), (1, 3, "user", None), (2, None, "assistant", ""), (2, 0, "assistant", "<"), (2, 1, "as\nsist&n;", "|im_end|>"), (3, 0, None, "y" * 50_000), (None, 0, "user", "n")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, rows int")
    out = chat_format.digests(chat_format.format_conversations(turns)).toPandas()
    assert len(out) == 4
    for conv, got in zip(out.conv_id, out.itertuples()):
        mine = sorted((r for r in rows if (r[0] is None and pd.isna(conv)) or r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_merges_and_masks(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_conversations(turns).first()
    assert row["formatted"] == "<|im_start|>user\na<|turn|>b<|im_end|>\n<|im_start|>assistant\nc<|turn|>d<|im_end|>\n"
    assert [(m["loss"], m["head"], m["body"]) for m in row["mask"]] == [(False, 17, 10), (True, 22, 10)]


# ---------------------------------------------------------------- 6


def test_url_rules_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7x?q#f", "x://example.com/en/8", "https://acom/en/1", "https://a.example.net/de/8/9", "https://b.net/de/1", "https://sub.a.org/es/", "https://org/es/1", "https://É.com/en/", "https://ex.com?/en/", "a://b.net/de/?://c.com/en/", "https://casinobestwin.example.io/play", "https://citynews.example.io/today", "http://k.com\n/en/1"]
    out = url_filter.judge(spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")).toPandas().sort_values("page_id")
    for url, got in zip(urls, out.itertuples()):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fit = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got.host, got.path) == (host, path)
        assert (got.rule, got.verdict) == (best[0] + best[1], best[2]) if best else got.rule is None
    assert out.verdict.tolist()[14:16] == ["block", "allow"]


def test_url_words_come_from_pages_and_classes_from_more_than_subdomains(spark):
    urls = ["https://m.ads-track.example.com/fr/1", "https://blog.adult-x.example.net/fr/2", "https://www.qorvani.example.io/x", "https://zelt.example.io/qorvani/zelt", "https://qorvanizelt.example.io/", "https://blog.qorvani.example.io/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(pages).orderBy("page_id").collect()] == ["block", "block"] + ["allow"] * 4
    cut = pages.select(url_filter.host_of(pages.url).alias("host"), url_filter.path_of(pages.url).alias("path"))
    counts = url_filter.token_counts(cut, 1000)
    assert (counts["example"], counts["qorvani"], counts["zelt"], counts["qorvanizelt"]) == (6, 3, 2, 1)
    assert url_filter.UrlModel(counts=counts).segment("qorvanizelt") == ("qorvani", "zelt")
    assert url_filter.UrlModel(counts=counts).segment("zeltcasino") == ("zelt", "casino")


def test_url_odds_equal_a_plain_count(spark):
    """Two rounds of expectation maximisation, by plain Python over whole word lists; long and odd URLs included."""
    urls = ["https://m.casino-spam.example.com/fr/1", "https://casino.example.com/glimmer", "https://glimmer.example.net/fr/2", "https://city-news.example.org/de/3", "https://quiet.example.org/de/" + "q" * 5000, "x", None, "https://glimmer.example.net/fr/2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    cut = pages.select(url_filter.host_of(pages.url).alias("host"), url_filter.path_of(pages.url).alias("path"))
    counts = url_filter.token_counts(cut, 1000)
    got = url_filter.learn(cut, counts, 1000)
    seeds = {c: collections.Counter(w for r in url_filter._rows(t) for w in r) for c, t in url_filter.EXAMPLES.items()}
    plain, rows = url_filter.UrlModel(counts=counts), [(r["host"], r["path"]) for r in cut.collect()]
    odds, prior = None, math.log((len(url_filter._rows(url_filter.EXAMPLES["block"])) + 1) / (len(url_filter._rows(url_filter.EXAMPLES["allow"])) + 1))
    for k in range(2):
        sums, urls_of = {c: collections.Counter() for c in ("block", "allow")}, collections.Counter()
        for host, path in rows:
            words = plain.words(host, path)
            if odds is None:
                chance = lambda w, c: 1.0 * seeds[c][w] / sum(seeds[c].values()) + url_filter.UNSEEN
                known = [math.log(chance(w, "block") / chance(w, "allow")) for w in words if w in seeds["block"] | seeds["allow"]]
            else:
                known = [odds[w] for w in words if w in odds]
            p = 1 / (1 + math.exp(-(prior + sum(known)))) if known else 0.0
            urls_of.update({"block": p, "allow": 1 - p})
            for w in words:
                sums["block"][w] += p
                sums["allow"][w] += 1 - p
        every = set(seeds["block"]) | set(seeds["allow"]) | set(sums["allow"])
        mixed = lambda w, c: 0.5 * seeds[c][w] / sum(seeds[c].values()) + 0.5 * sums[c][w] / sum(sums[c].values()) + url_filter.UNSEEN
        odds = {w: math.log(mixed(w, "block") / mixed(w, "allow")) for w in every}
        prior = math.log((urls_of["block"] + 1) / (urls_of["allow"] + 1))
    assert got.prior == pytest.approx(prior) and got.odds.keys() == odds.keys()
    assert all(got.odds[w] == pytest.approx(odds[w], abs=1e-9) for w in odds)
    out = url_filter.judge(pages).toPandas().sort_values("page_id")
    assert out.verdict.tolist() == ["block", "block"] + ["allow"] * 6
    for host, path, verdict, by in zip(out.host, out.path, out.block_log_odds, out.rule):
        known = [odds[w] for w in plain.words(host, path) if w in odds]
        assert verdict == pytest.approx(prior + sum(known), abs=1e-6) if known else verdict == -math.inf


def test_segmentation_equals_exhaustive_search():
    model = url_filter.UrlModel()

    def cost(words):
        return sum(model.cost[w] if w in model.cost else model.unknown + len(w) * model.letter for w in words)

    def all_splits(s):
        if not s:
            yield []
        for i in range(1, len(s) + 1):
            for rest in all_splits(s[i:]):
                yield [s[:i], *rest]

    for name in ("casinowin", "newstoday", "qzcasino", "abc", "winqqcash"):
        best = max(all_splits(name), key=cost)
        assert cost(model.segment(name)) == pytest.approx(cost(best))
    assert model.segment("casinowin") == ("casino", "win")


# ---------------------------------------------------------------- 7


def check_mix(out, block=16):
    assert (out.taken <= 2 * out["size"]).all() and (out.taken >= 0).all()
    by = out.groupby(out.source.fillna("~null")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), known=("source_size", "first"))
    assert (by["size"] == by.known).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert by.target.sum() == pytest.approx(1.5 * by["size"].sum())
    return (by.taken - by.target).abs()


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 400)), None, rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(600)] + [(600, None, None, "empty"), (5, "w w", None, "a"), (5, "w w", None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = source_mix.mix(docs).toPandas()
    assert len(whole) == len(rows) and check_mix(whole).max() <= 16
    parts = source_mix.mix(docs, shard=2000).toPandas()  # many shards for the hot source
    assert check_mix(parts).max() <= 16 * 4
    again = source_mix.mix(docs.repartition(7), shard=2000).toPandas()
    assert sorted(map(str, parts.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))


def test_seats_are_the_highest_quotients(spark):
    votes = [530, 240, 130, 100, 7, 7]
    frame = spark.createDataFrame([(chr(97 + i), float(v)) for i, v in enumerate(votes)], "p string, v double")
    from pyspark.sql import functions as F

    for total in (0, 1, 5, 17, 101):
        got = {r["p"]: r["quota"] for r in source_mix.seats(frame, [], "v", F.lit(total)).collect()}
        quotients = sorted(((-v / (2 * s + 1), chr(97 + i)) for i, v in enumerate(votes) for s in range(total)))[:total]
        want = collections.Counter(p for _, p in quotients)
        assert got == {chr(97 + i): want[chr(97 + i)] for i in range(len(votes))}


# ---------------------------------------------------------------- 8, 9


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path(None))


STRANGE = [*ODD, "it's I'LL don't\t\n x", "½ Ⅷ 12٣ ²", "\x1c\x1d a \x85b\u2003c", "<|endoftext|> a <|endoftext|>", "é́ß😀", "_foo__ bar!! ..."]


def test_encoder_equals_the_library(library):
    rng = random.Random(1)
    texts = STRANGE + ["".join(rng.choice(" \n\ta1é'.!s²ß\u3000\u0301_日") for _ in range(50)) for _ in range(300)]
    for memo in (10**6, 20):
        got = tokens.Encoder(memo=memo).batch(texts)
        assert all(g.tolist() == library.encode(t or "", add_special_tokens=False).ids for g, t in zip(got, texts))


def test_encoder_cuts_texts_of_all_scripts_as_the_library(library):
    """Endings, blanks of all sizes, ends of texts, zero bytes, long words; what a text ends with doesn't touch the next."""
    rng = random.Random(2)
    signs = [*" \n\t''.!a1sdLl\x00\x1c\x85\xa0é½ß\u0301\u0378\u1680\u2028\u3000日٠Ⅷ😀𝒳", "'re", "'s", " it's", "<|", "<|endoftext|>", "щука", "x" * 70]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["'", "s", "x'", "re", " ", "a", "\u3000", None, "b\0", "b", "b\0\0"]
    for memo in (10**6, 50):
        encoder = tokens.Encoder(memo=memo)
        got = [ids for a in range(0, len(texts), 700) for ids in encoder.batch(texts[a : a + 700])]
        assert [g.tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_asks_for_a_word_once():
    """300,000 words of a vocabulary are remembered; the library isn't asked for any of them again."""

    class Counting:
        def __init__(self, of):
            self.of, self.signs = of, 0

        def __getattr__(self, name):
            def call(texts, **options):
                self.signs += len(texts) if isinstance(texts, str) else sum(map(len, texts))
                return getattr(self.of, name)(texts, **options)

            return call

    encoder, letters = tokens.Encoder(), "abcdefghijklmnopqrstuvwxyz"
    text = "".join(f" {''.join(letters[i // 26**k % 26] for k in range(4))}" for i in range(300_000))
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    (first,) = encoder.batch([text])
    assert counting.signs >= len(text)
    counting.signs = 0
    (again,) = encoder.batch([text])
    assert counting.signs == 0 and again.tolist() == first.tolist()


def test_known_words_cost_a_tenth_of_the_library(library):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(400)]
    encoder = tokens.Encoder()
    encoder.batch(texts)

    def seconds(work):
        began = time.thread_time()
        work()
        return time.thread_time() - began

    whole = min(seconds(lambda: [library.encode(t, add_special_tokens=False) for t in texts]) for _ in range(3))
    assert min(seconds(lambda: encoder.batch(texts)) for _ in range(5)) < whole / 10


def test_encoder_of_another_kind_equals_the_library():
    """A file with a normalizer and another pre-tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, other = tokens.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.by_word and tokens.Encoder().by_word
    texts = [*STRANGE, "It's   a LONG\n\nline, isn't it?"]
    assert [g.tolist() for g in encoder.batch(texts)] == [other.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_segments_round_trip(spark, library, tmp_path):
    rows = [(100 - i, t, 1) for i, t in enumerate(STRANGE)] + [(None, "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t, _ in rows}
    for mode in ("byte", "bit"):
        segments = token_planes.write(docs, mode=mode)
        out = token_planes.documents_of(segments).toPandas()
        at = 0
        for d in sorted(ids, key=lambda d: (d is not None, d or 0)):
            row = out[out.doc_id.isna()] if d is None else out[out.doc_id == d]
            data = np.array(ids[d], "<u4").tobytes()
            assert (row.start.item(), row.n_tokens.item(), row.ids_crc32.item()) == (at, len(ids[d]), zlib.crc32(data))
            at += len(ids[d])
    read = token_planes.Segment(open(token_planes.export(segments, tmp_path)[0], "rb").read())
    assert read.ids(3, 9).tolist() == read.ids().tolist()[3:9]


def test_token_segments_of_repeated_ids(spark, library):
    """Rows of one id stand by text; many segments in a partition, each with its own place."""
    rows = [(i % 5, f"text {i} of id") for i in range(60)] + [(3, None), (3, "same"), (3, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    segments = token_planes.write(docs, segment=8)
    assert segments.count() > 20
    out = token_planes.documents_of(segments).toPandas().sort_values("start")
    at = 0
    for (d, t), got in zip(sorted((d, t or "") for d, t in rows), out.itertuples()):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_planes_invert():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 50257, 200_000), np.zeros(5, int), np.array([2**32 - 1, 0, 7]), np.empty(0, int)):
        for mode in ("bit", "byte"):
            seg = token_planes.Segment(token_planes.pack([1], [len(ids)], ids.astype(np.uint32), mode))
            assert seg.ids().tolist() == ids.tolist()


def test_packing_covers_every_id(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(STRANGE)], "doc_id long, text string"))
    out, texts = packing.pack(docs).toPandas(), dict(docs.toPandas().itertuples(index=False))
    for d, mine in out.sort_values("start").groupby("doc_id"):
        ids = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (mine.start + mine.length).tolist() == [*mine.start.tolist()[1:], len(ids)] and (mine.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32 for r in mine.itertuples())
    assert set(out.doc_id) == set(texts)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *(s.offset + s.length).tolist()[:-1]] and s.length.sum() <= 1024
    assert out.length.sum() / (1024 * out.sequence_id.nunique()) > 0.95


def test_differencing_is_a_near_even_partition():
    rng = random.Random(5)
    for k in (1, 2, 7):
        sizes = [rng.randrange(1, 129) for _ in range(80)]
        sets = packing.differencing(sizes, k)
        assert sorted(i for s in sets for i in s) == list(range(80)) and len(sets) == k
        loads = [sum(sizes[i] for i in s) for s in sets]
        assert max(loads) - min(loads) <= 8
    assert packing.differencing([], 3) == [] and sorted(packing.deal([5, 5, 5], 8)) == [[0], [1], [2]]
    assert all(sum([600, 600, 600][i] for i in s) <= 1024 for s in packing.deal([600, 600, 600], 1024))


def test_dealing_against_the_best_packing():
    """Small groups: no more windows than the best packing of whole items needs, and one if all fit."""
    def fewest(sizes, cap, loads=()):
        if not sizes:
            return len(loads)
        best = len(loads) + len(sizes)
        for i, load in enumerate(loads):
            if load + sizes[0] <= cap:
                best = min(best, fewest(sizes[1:], cap, (*loads[:i], load + sizes[0], *loads[i + 1 :])))
        return min(best, fewest(sizes[1:], cap, (*loads, sizes[0])))

    rng = random.Random(8)
    for _ in range(40):
        sizes = [rng.randrange(1, 1025) for _ in range(6)]
        packer = packing.Packer(0, 1024, 64, 0.008)
        out = [r for i, n in enumerate(sizes) for r in packer.add(i, np.arange(n, dtype="<u4"))] + packer.flush()
        loads = collections.Counter()
        for r in out:
            loads[r[5]] += r[2]
        assert max(loads.values()) <= 1024 and sum(loads.values()) == sum(sizes) and len(loads) <= fewest(sizes, 1024)
        for i, n in enumerate(sizes):
            mine = sorted((r[1], r[2]) for r in out if r[0] == i)
            assert [a for a, _ in mine] == [0, *np.cumsum([k for _, k in mine]).tolist()[:-1]] and sum(k for _, k in mine) == n


def test_packing_cuts_little(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").coalesce(1)
    out = packing.pack(docs).toPandas()
    assert out.length.sum() / (1024 * out.sequence_id.nunique()) > 0.99
    assert len(out) / docs.count() < 3


# ---------------------------------------------------------------- all


def test_empty_tables(spark):
    docs, vectors = docs_of(spark, []), spark.createDataFrame([], VECTORS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frames = [
        ngram_join.ngram_jaccard_join(docs), rp_forest.embedding_near_duplicates(vectors), quality_fm.classify(docs, labels), chat_format.digests(chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
        language_gru.identify(docs), url_filter.judge(spark.createDataFrame([], "page_id long, url string")), source_mix.mix(docs), token_planes.documents_of(token_planes.write(docs)), packing.pack(docs), ball_tree.exact_top_k(vectors),
    ]
    assert [f.count() for f in frames] == [0] * 10


def test_odd_documents_everywhere(spark):
    docs = docs_of(spark, ODD)
    assert ngram_join.ngram_jaccard_join(docs).count() == source_mix.mix(docs).count() == token_planes.documents_of(token_planes.write(docs)).count() == len(ODD)
    assert packing.pack(docs).select("doc_id").distinct().count() == len(ODD)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    got, want = catalogue.queries()[name](spark, SMALL).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(json.dumps([str(v) for v in r]) for r in f[sorted(f.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(5000, None, None, "src1", None), (5001, "", "en", None, 0), (5002, "1 2 3", "en", "src1", 5)], docs.schema)
    docs, columns = docs.unionByName(extra), docs.columns
    kept = [docs]
    for _, stage in cp.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SMALL).cache())
        assert kept[-1].columns == columns
    labels = pd.read_parquet(f"{SMALL}/labels.parquet")
    ids = [f.toPandas() for f in kept]
    good, bad = set(labels.doc_id[labels.quality == 1]), set(labels.doc_id[labels.quality == 0])
    assert len(good & set(ids[1].doc_id)) >= 0.97 * len(good) and len(bad & set(ids[1].doc_id)) <= 0.2 * len(bad)
    assert not {5000, 5001, 5002} & set(ids[2].doc_id) and len(ids[2]) >= 0.97 * len(ids[1])
    before = ids[2].sort_values("doc_id").reset_index(drop=True)
    _, classes = brute_links(before.text.tolist())
    assert sorted(ids[3].doc_id) == sorted(before.doc_id[[i for i, c in enumerate(classes) if c == i]])
    size = lambda f: f.text.str.split().str.len().groupby(f.source).sum()
    assert abs(size(ids[4]).sum() - 1.5 * size(ids[3]).sum()) <= 16 * 20
    assert (size(ids[4]) <= 2 * size(ids[3]).reindex(size(ids[4]).index)).all()
    run = cp.run(spark, SMALL).toPandas()
    assert run.groupby("sequence_id").length.sum().max() <= 1024


def test_pipeline_keeps_texts_whose_ids_are_null_or_repeated(spark):
    import corpus_pipeline as cp

    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(12)]
    near = " ".join([*texts[0].split()[:-1], "other"])
    rows = [(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:9]] + [(8, texts[9]), (9, texts[10]), (9, texts[10]), (10, texts[11]), (11, near), (12, texts[6]), (None, texts[9])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_duplicates(spark, docs, SMALL).cache()
    want = [(11, near)] + [(None, t) for t in texts[1:5]] + [(7, t) for t in texts[5:9]] + [(8, texts[9]), (9, texts[10]), (10, texts[11])]
    assert kept.columns == docs.columns
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in kept.collect())
    mixed = cp.mixing(spark, kept, SMALL).toPandas()
    taken = mixed.text.str.split().str.len().sum()
    assert abs(taken - 1.5 * 80 * len(want)) <= 16
