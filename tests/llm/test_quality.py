import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from shelfsight.llm import quality


from shelfsight.llm.quality import Ftrl, Hashes, features, score_quality

DIR = "/root/testdata/sf0.1"


def test_features_against_counts():
    hashes = Hashes()
    i, x = features("a a b, b B!! c", hashes)
    assert np.isclose((x * x).sum(), 1) and len(i) == len(set(i))
    assert [len(v) for v in features(None, hashes)] == [0, 0] == [len(v) for v in features(" \n", hashes)]


def test_ftrl_learns():
    rng = np.random.default_rng(0)
    model = Ftrl(8)
    for _ in range(400):
        y = int(rng.integers(2))
        model.learn(np.array([y, 2 + int(rng.integers(200))]), np.array([0.7, 0.7]), y, 1.0)
    w = model.weights(slice(None))
    assert w[1] > 0.5 > -0.5 > w[0] and (w == 0).mean() > 0.2


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = score_quality(docs, labels).join(labels.groupBy("doc_id").agg({"quality": "min"}).withColumnRenamed("min(quality)", "y"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]).all()
    test = got[got["held_out"]]
    rank = test["score"].rank()
    pos, neg = (test["y"] == 1).sum(), (test["y"] == 0).sum()
    auc = (rank[test["y"] == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
    right = [((test["score"] >= 0.5) == test["y"])[test["y"] == c].mean() for c in (0, 1)]
    print("auc", auc, "accuracy by class", right, len(test))
    assert auc > 0.97 and min(right) > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a", 1), (3, "a", 1), (None, "b", 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score_quality(docs, none).collect()] == [0.5] * 5
    one = spark.createDataFrame([(3, 1), (3, 0), (1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    assert score_quality(docs, one).count() == 5
    assert score_quality(docs.limit(0), one).count() == 0


def plain_features(text):
    mask = (1 << 64) - 1
    tokens = re.findall(r"\w+|[^\w\s]+", text.lower())
    hashes = [xxhash.xxh64_intdigest("\x00repeat" if i and t == tokens[i - 1] else t) for i, t in enumerate(tokens)]
    count = Counter(h >> 46 for h in hashes)
    for a, b in zip(hashes, hashes[1:], strict=False):
        pair = (a * 0x9E3779B97F4A7C15 & mask) ^ (b * 0xC2B2AE3D27D4EB4F & mask) ^ (b >> 29)
        count[(pair * 0x9E3779B97F4A7C15 & mask) >> 46] += 1
    value = {i: 1 + math.log(n) for i, n in count.items()}
    size = math.sqrt(sum(v * v for v in value.values()))
    return {i: v / size for i, v in value.items()}


def test_learning_and_scores_against_a_plain_form(spark):
    rng = random.Random(3)
    good, bad = ["the %s of word%d" % (x, i) for i in range(40) for x in "ab"], ["!! buy%d now now" % i for i in range(40)]
    rows = [(d, " ".join(rng.choices(good if d % 2 else bad, k=rng.randint(0, 12))) + rng.choice(["", " é中", " the the the"])) for d in range(120)]
    labels = [(d, d % 2) for d, _ in rows if d % 3]
    got = {r.doc_id: r.score for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    texts = dict(rows)
    known = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    z, n, bz, bn = {}, {}, 0.0, 0.0
    a, b, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)
    bias = lambda: -bz / ((b + math.sqrt(bn)) / a)
    order = np.random.default_rng(0)
    for _ in range(quality.EPOCHS):
        for r in order.permutation(len(known)):
            d, y = known[r]
            x = plain_features(texts[d])
            w = {i: weight(i) for i in x}
            at = bias()
            loss = 1 / (1 + math.exp(-(sum(w[i] * v for i, v in x.items()) + at))) - y
            for i, v in x.items():
                g = loss * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / a * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bz += loss - (math.sqrt(bn + loss * loss) - math.sqrt(bn)) / a * at
            bn += loss * loss
    for d, t in rows:
        want = 1 / (1 + math.exp(-(sum(weight(i) * v for i, v in plain_features(t).items()) + bias())))
        assert math.isclose(got[d], want, abs_tol=1e-5), (d, got[d], want)
