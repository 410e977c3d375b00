import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfsight.llm import runs as R


def brute(w):
    """Every maximal stretch of every period, kept if its period is its smallest."""
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            x = list(w[s : i + p])
            if len(x) >= max(6, 4 * p) and not any(x[d:] == x[:-d] for d in range(1, p)):
                out.append((s, len(x), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force(monkeypatch):
    rng = random.Random(1)
    for probes in (1 << 20, 8):
        monkeypatch.setattr(R, "PROBES", probes)
        for _ in range(1500):
            n, k = rng.randint(0, 130), rng.choice([1, 2, 2, 3, 5])
            w = [rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randint(0, 4)):
                if n > 8:
                    a, p = rng.randrange(n), rng.randint(1, n // 4)
                    for i in range(a + p, min(a + rng.randint(1, n), n)):
                        w[i] = w[i - p]
                    if rng.random() < 0.5:
                        w[rng.randrange(n)] = 9
            assert R.find_runs(np.array(w, np.int32)) == brute(w), w


def test_run_hidden_by_runs_of_another_period():
    w = R.word_numbers((["a", "a", "b"] * 4 + ["a"]) * 5)  # every grid point of period 13 lies in a run of period 3
    assert R.find_runs(w) == brute(w) and (0, 65, 13) in R.find_runs(w)


def test_long_texts():
    assert R.find_runs(np.zeros(300_000, np.int32)) == [(0, 300_000, 1)]
    w = np.random.default_rng(1).integers(0, 50, 400_000).astype(np.int32)
    w[100_000:300_000] = w[100_000 + np.arange(200_000) % 41_000]
    w[99_999], w[300_000] = 77, 78
    assert (100_000, 200_000, 41_000) in R.find_runs(w)


def plain(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *top, top[1] and 1000 * top[1] // top[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_report_against_the_contract(spark):
    rng = random.Random(2)
    rows = [(None, "b b b b b b"), (3, None), (4, ""), (5, " \n\t"), (6, "x\x1cy x y x\x1cy"), (7, "a b a b a b a b c c c c c c")]
    for i in range(100, 500):
        words = [rng.choice("abcdeé") for _ in range(rng.randint(0, 150))]
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\x0b"]) for w in words)))
    rows += rows[:9]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    planted = df.withColumn("text", R.planted_text(F.col("doc_id"), F.col("text")))
    out = R.run_report(R.periodic_runs(planted)).collect()
    order = lambda x: tuple((v is not None, v) for v in x)
    fields = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[f] for f in fields) for r in out), key=order) == sorted((plain(*r) for r in rows), key=order)
    assert R.run_report(R.periodic_runs(df.limit(0))).count() == 0


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "go  a b a b a b a b\nend")], "doc_id long, text string")
    row = R.periodic_runs(df).first()
    assert row.collapsed == "go a b end" and [tuple(r) for r in row.runs] == [(1, 8, 2)]
