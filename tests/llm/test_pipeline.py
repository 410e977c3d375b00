import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import sentencepiece

from shelfsight.llm.decontaminate import fitting_distance, normalised
from shelfsight.llm.simhash import drop_similar, shingles, words_of

from .test_line_dedup import brute as brute_lines
from .test_simhash import union

DIR = "/root/testdata/sf0.001"


def alike(a, b):
    a, b = words_of(a), words_of(b)
    s, t = set(shingles(a, 5)), set(shingles(b, 5))
    return a == b or bool(s | t) and len(s & t) >= 0.8 * len(s | t)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(3000)]
    base = [rng.choices(vocabulary, k=rng.choice([0, 1, 3, 20, 60, 200, 400])) for _ in range(60)]
    rows = []
    for d in range(420):
        w = list(base[0] if d % 3 == 0 else rng.choice(base))
        if d % 3 == 0 and len(base[0]) < 60:
            base[0] = rng.choices(vocabulary, k=300)
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((d * 11 % 1009, rng.choice([" ", "\n"]).join(w), "s"))
    rows += [(2000, None, "s"), (2001, "", "s"), (2002, "\n", "s")]
    df = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, fp string")
    got = {r.doc_id for r in drop_similar(df).collect()}
    root = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(rows[a][1], rows[b][1])])
    least = {}
    for (d, _, _), r in zip(rows, root, strict=True):
        least[r] = min(d, least.get(r, d))
    assert got == set(least.values())
    assert drop_similar(df.limit(0)).count() == 0
    assert drop_similar(spark.createDataFrame([(None, "a", "s"), (None, "a", "s"), (1, "a", "s")], df.schema)).count() == 3


def test_contiguous_edits_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(3000)]
    passage = rng.choices(vocabulary, k=12)
    words = []
    for _ in range(70):
        w = rng.choices(vocabulary, k=rng.choice([30, 90, 200, 300]))
        cut = int(len(w) * rng.uniform(0.03, 0.19))
        at = rng.randrange(len(w) - cut)
        new = rng.choices(vocabulary, k=cut)
        words += [w, w[:-cut], w[cut:], w + new, w[: -cut // 2] + new[: cut // 2], w[:at] + new[: cut // 2] + w[at + cut // 2 :]]
    # texts that share a passage only, and near copies of one text that a few edits chain together
    words += [rng.choices(vocabulary, k=25) + passage for _ in range(260)]
    w = rng.choices(vocabulary, k=100)
    for k in range(260):
        words.append([*w[: rng.randint(80, 100)], *rng.choices(vocabulary, k=rng.randint(0, 8))])
    order = rng.sample(range(5000), len(words))
    rows = [(d, " ".join(w)) for d, w in zip(order, words, strict=True)]
    got = {r.doc_id for r in drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(shingles(w, 5)) for w in words]
    root = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(d, least.get(r, d))
    assert got == set(least.values())


def test_repeated_passages_lose_no_link(spark):
    rng = random.Random(10)
    vocabulary = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(3000)]
    rows = []
    for k in range(100):
        passages = [" ".join(rng.choices(vocabulary, k=rng.choice([6, 20, 40]))) for _ in range(10)]
        times = rng.choice([5, 20, 60])
        rows += [(2 * k, "\n".join(passages)), (2 * k + 1, "\n".join([passages[0]] * times + passages[1:]))]
    sets = [set(shingles(words_of(t), 5)) for _, t in rows]
    alone = {d for d, _ in rows if d % 2 == 0 or len(sets[d - 1] & sets[d]) < 0.8 * len(sets[d - 1] | sets[d])}
    assert len(alone) < 140
    got = {r.doc_id for r in drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == alone


def test_near_duplicates_with_repeated_ids(spark):
    text = " ".join(map(str, range(100)))
    rows = [(1, "a b c"), (1, text), (1, "a b c"), (2, text + " more"), (2, "d e f"), (None, "a b c")]
    got = sorted(map(tuple, drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, "a b c"), (1, text), (2, "d e f"), (None, "a b c")], key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [normalised(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    labels = dict(spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "quality").collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, DIR)
        if name == "sentencepiece":
            got = {r.doc_id: r.n_tokens for r in out.collect()}
            assert got == {d: len(sp.encode(t)) for d, t in before.items()}
            break
        assert out.columns == docs.columns
        out = corpus_pipeline.materialise(out, "test-stage")
        after = {r.doc_id: r.text for r in out.collect()}
        assert out.count() == len(after)
        if name == "quality classifier":
            assert np.mean([(d in after) == labels[d] for d in before if d in labels]) > 0.97
            assert all(after[d] == before[d] for d in after)
        elif name == "line dedup":
            want = brute_lines(before.items())
            for d, t in before.items():
                gone = set(want[d][1].split(","))
                assert after[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if str(i) not in gone)
        elif name == "simhash near-dedup":
            ids = sorted(before)
            sets = {d: set(shingles(words_of(before[d]), 5)) for d in ids}
            where = {}
            for d in ids:
                for s in sets[d]:
                    where.setdefault(s, []).append(d)
            pairs = {(a, b) for ds in where.values() for a in ds for b in ds if a < b}
            n = {d: i for i, d in enumerate(ids)}
            root = union(len(ids), [(n[a], n[b]) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] + [(n[a], n[b]) for a, b in zip([d for d in ids if not sets[d]], [d for d in ids if not sets[d]][1:], strict=False)])
            assert set(after) == {ids[r] for r in root}
        else:
            for d, t in before.items():
                line = normalised(t)
                leak = any(i in line or fitting_distance(i, line, len(i) // 10) <= len(i) // 10 for i in items)
                assert (d not in after) == leak
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
