import math
import zlib
from collections import Counter

import numpy as np

from shelfsight.llm import language_model as lm
from shelfsight.llm.language_model import END, HEAD, GatedModel, score_language, score_texts, words_of

DIR = "/root/testdata/sf0.01"


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    model = GatedModel()
    model.p = {k: v.astype(np.float64) * 3 for k, v in model.p.items()}
    x = rng.integers(0, HEAD + lm.TAILS, (5, 3))
    y = rng.integers(0, HEAD + lm.TAILS, (5, 3))
    fresh = (rng.random((5, 3)) < 0.3).astype(float)
    used = rng.random((5, 3)) < 0.8
    h0 = rng.normal(size=(3, lm.HIDDEN))

    def loss():
        states = []
        h = h0
        for t in range(5):
            out, h, _ = model.run(x[t : t + 1], fresh[t : t + 1], h)
            states.append(h)
        h = np.stack(states).reshape(-1, lm.HIDDEN)[used.ravel()]
        return -model.log_probs(h, y.ravel()[used.ravel()]).mean()

    g, _, total = model.gradients(x, fresh, y, used, h0)
    assert np.isclose(total / used.sum(), loss(), rtol=1e-4)
    for k, v in model.p.items():
        flat = np.argsort(-np.abs(g[k]).ravel())[:4]
        for f in flat:
            at = np.unravel_index(f, v.shape)
            old = v[at]
            v[at] = old + 1e-4
            up = loss()
            v[at] = old - 1e-4
            down = loss()
            v[at] = old
            assert np.isclose((up - down) / 2e-4, g[k][at], rtol=0.02, atol=1e-4), (k, at)


def test_words_of_a_context_add_up_to_one():
    model = GatedModel()
    h = np.random.default_rng(1).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    ids = np.arange(HEAD + lm.TAILS)
    assert np.isclose(np.exp(model.log_probs(np.repeat(h, len(ids), 0), ids)).sum(), 1, atol=1e-4)


def test_lanes_and_windows_do_not_matter():
    rng = np.random.default_rng(2)
    model = GatedModel()
    texts = [rng.integers(0, HEAD + lm.TAILS, n).astype(np.int32) for n in (1, 3, 200, 33, 32, 64, 1, 90)]
    one = [score_texts(model, [t])[0] for t in texts]
    assert np.allclose(score_texts(model, texts, lanes=3), one, rtol=1e-4)


def test_learning_lowers_the_loss_and_the_flat_form_is_whole():
    rng = np.random.default_rng(3)
    model = GatedModel()
    texts = [np.tile(rng.integers(0, 40, 5), n).astype(np.int32) for n in rng.integers(1, 60, 50)]
    past = model.fresh_past()
    losses = [model.learn(texts, past) for _ in range(12)]
    assert losses[-1] < 0.7 * losses[0]
    other = GatedModel(seed=9)
    kept = other.set_flat(model.flat(past))
    assert all((other.p[k] == v).all() and (kept[k] == past[k]).all() for k, v in model.p.items())


def test_score_against_one_step_after_another(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["w%d" % int(x) for x in rng.zipf(1.3, 9000) % 5000]
    rows = [(i, " ".join(words[i * 90 : i * 90 + int(rng.integers(0, 90))])) for i in range(100)] + [(200, "Never seen, w1 w2")]
    kept = []
    fit = lm.fit_model
    monkeypatch.setattr(lm, "fit_model", lambda *a: kept.append(fit(*a)) or kept[-1])
    got = {r.doc_id: r.score for r in score_language(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    vocabulary, model = kept[0]
    p = {k: v.astype(float) for k, v in model.p.items()}
    c = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 10 for w in [*words_of(t), END])
    head = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][:HEAD]
    place = {w: i for i, w in enumerate(head)}
    mass = Counter()
    for w, n in c.items():
        if w not in place:
            mass[lm.tail_class(w)] += n + 0.1
    n = lm.HIDDEN
    soft = lambda v: v - v.max() - math.log(np.exp(v - v.max()).sum())
    for d, t in rows[::9] + rows[-1:]:
        h, x, want = np.zeros(n), HEAD + lm.TAILS, 0.0
        for w in [*words_of(t), END]:
            a, u = p["inp"][x] + p["b"], h @ p["u"]
            z, r = (1 / (1 + np.exp(-(a + u)[: 2 * n]))).reshape(2, n)
            h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * u[2 * n :])
            x = place.get(w, HEAD + lm.tail_class(w))
            classes = soft(h @ p["cw"] + p["cb"])
            if x < HEAD:
                k = x // lm.PER_CLASS
                want += classes[k] + soft(h @ p["ow"][k] + p["ob"][k])[x % lm.PER_CLASS]
            else:
                k = x - HEAD
                want += classes[lm.CLASSES + k] + math.log((c[w] + 0.1) / (mass[k] + 0.1))
        assert math.isclose(got[d], want / math.log(10), rel_tol=1e-4), (d, got[d], want / math.log(10))


def test_scores(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = spark.createDataFrame([(70001, None, "x"), (70002, "", "x"), (70003, "zzqq never seen", "x")], "doc_id long, text string, source string")
    docs = docs.select("doc_id", "text", "source").union(extra).union(docs.select("doc_id", "text", "source").limit(1))
    got = score_language(docs).toPandas()
    rows = [(r.doc_id, [*words_of(r.text), END]) for r in docs.collect()]
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    c = Counter(w for d, ws in rows if not held[d] for w in ws)
    n = sum(c.values())
    want = sorted((d, held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in ws)) for d, ws in rows)
    got = got.sort_values(["doc_id", "n_tokens"]).reset_index(drop=True)
    assert list(got[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]].itertuples(index=False, name=None)) == [w[:5] for w in want]
    assert np.allclose(got["base_score"], [w[5] for w in want], rtol=1e-9)
    test = got[got["held_out"]]
    print("held-out log10 a token: base", test["base_score"].sum() / test["n_tokens"].sum(), "model", test["score"].sum() / test["n_tokens"].sum())
    assert test["score"].sum() > test["base_score"].sum() and np.isfinite(got["score"]).all()


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert score_language(none).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens) for r in score_language(only).collect()} == {(0, 0)}


def test_one_long_text_beside_many_short_ones_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 500, 300_000)] + [rng.integers(0, 500, 5) for _ in range(400)]
    tracemalloc.start()
    seen = np.zeros(len(texts), dtype=np.int64)
    for x, fresh, y, used, owner in lm.windows(texts, 64):
        assert x.shape == fresh.shape == y.shape == used.shape == owner.shape
        seen += np.bincount(owner[used], minlength=len(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen.tolist() == [len(t) for t in texts] and peak < 40e6


def test_clashing_columns(spark):
    rows = [(i, "the same words again and again " * 4, 1, 2, 3, "w", i) for i in range(12)]  # 24 words and the end
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, known int, score int, words string, row int")
    out = score_language(df).collect()
    assert sorted(r.doc_id for r in out) == list(range(12)) and all(r.n_tokens == 25 for r in out)
