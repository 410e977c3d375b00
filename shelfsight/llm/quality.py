"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text's tokens are runs of word characters and runs of punctuation, lower-cased; a token that
repeats the one before it counts as the token REPEAT. Unigrams and bigrams are hashed into a fixed
number of weights; a text is the sparse vector of 1 + ln(count), scaled to length one, and its
score is the logistic function of one sparse dot product.

Training takes at most ``per_class`` labelled rows of each class, those with the least hash of
their id, weighted back to the classes' shares; it runs in one task on that bounded sample. The
weights (a fixed size) go to every task; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

TOKEN = re.compile(r"\w+|[^\w\s]+")
REPEAT = "\x00repeat"
BITS = 18
#: Bound of the training sample, rows of each class.
PER_CLASS = 3000
#: Passes over the sample.
EPOCHS = 12
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
#: Distinct tokens whose hashes a task remembers.
REMEMBERED = 150_000


class Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[token] = out = xxhash.xxh64_intdigest(token)
        return out


def features(text: str | None, hashes: Hashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices in order, and values of a vector of length one; both empty for a text without tokens."""
    tokens = TOKEN.findall((text or "").lower())
    if not tokens:
        return np.empty(0, dtype=np.int64), np.empty(0)
    h = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    same = np.flatnonzero(h[1:] == h[:-1]) + 1
    if len(same):
        h[same] = hashes[REPEAT]
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] >> np.uint64(29))
    index, count = np.unique(np.concatenate([h, pairs * np.uint64(0x9E3779B97F4A7C15)]) >> np.uint64(64 - bits), return_counts=True)
    value = 1 + np.log(count)
    return index.astype(np.int64), value / np.sqrt((value * value).sum())


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias(self) -> float:
        return -self.bias_z / ((BETA + self.bias_n**0.5) / ALPHA)

    def learn(self, i: np.ndarray, x: np.ndarray, label: int, weight: float) -> None:
        w, b = self.weights(i), self.bias()
        loss = weight * (1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35))) - label)
        g = loss * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA * w
        self.n[i] += g * g
        self.bias_z += loss - ((self.bias_n + loss * loss) ** 0.5 - self.bias_n**0.5) / ALPHA * b
        self.bias_n += loss * loss


class QualityModel:
    """Scores texts by sparse dot products; without training rows every score is 0.5."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: Iterator[str | None], hashes: Hashes) -> np.ndarray:
        out = np.array([float(self.weights[i] @ x) for i, x in (features(t, hashes) for t in texts)], dtype=np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def training_sample(docs: DataFrame, labels: DataFrame, fit_on, key: str, text: str, label: str, per_class: int) -> DataFrame:
    """``key, text, label, weight``: at most ``per_class`` rows of each class among ids that meet ``fit_on``.

    Labels other than 0 and 1 and rows without an id are left out; of several labels of one id the
    least counts, and of several rows of one id the least text.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_label")).where(fit_on)
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    total = sum(counts.values())
    # a first cut by the hash leaves few more than are wanted, so that no task gathers rows of all others
    place = F.shiftrightunsigned(F.xxhash64(key), 1) / float(1 << 63)
    chosen = None
    for c, n in sorted(counts.items()):
        part = known.where(F.col("_label") == c).where(place < 2.0 * per_class / n).orderBy(place, key).limit(per_class).withColumn("_weight", F.lit(n / min(n, per_class) / total * sum(min(x, per_class) for x in counts.values())))
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        chosen = known.withColumn("_weight", F.lit(1.0))
    # at most 2 * per_class rows of three numbers
    return bounded_batches(docs).select(key, text).join(F.broadcast(chosen), key).groupBy(key, "_label", "_weight").agg(F.min(text).alias("_text"))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_on=None, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    sample = training_sample(docs, labels, F.lit(True) if fit_on is None else fit_on, key, text, label, per_class)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, model = Hashes(), Ftrl()
        pdf = pdf.sort_values(key)
        rows = [(*features(t, hashes), int(y), float(w)) for t, y, w in zip(pdf["_text"], pdf["_label"], pdf["_weight"], strict=True)]
        rng = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for r in rng.permutation(len(rows)):
                model.learn(*rows[r])
        w = model.weights(slice(None)).astype(np.float32)
        return pd.DataFrame({"weights": [w.tobytes()], "bias": [model.bias()]})

    got = sample.groupBy(F.lit(0).alias("_all")).applyInPandas(fit, "weights binary, bias double").first()
    return QualityModel(np.frombuffer(got["weights"], dtype=np.float32), got["bias"]) if got else QualityModel(np.zeros(1 << BITS, dtype=np.float32), 0.0)


def quality_score(model: QualityModel):
    """A column function of a text column: the score from 0 to 1."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = Hashes()
        for texts in parts:
            yield pd.Series(model.score(texts, hashes))

    return score


def held_out(key: str, folds: int, fold: int):
    """Whether the crc32 of the id's text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 3, fold: int = 1) -> DataFrame:
    """``key, held_out, score, predicted`` of every row.

    Labels of ids in the held-out fold aren't seen. A null or empty text has no features and gets
    the prior. Repeated rows each give a row; other columns are left out.
    """
    model = fit_quality(docs, labels, ~held_out(key, folds, fold), key, text)
    out = docs.select(F.col(key), held_out(key, folds, fold).alias("held_out"), quality_score(model)(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
