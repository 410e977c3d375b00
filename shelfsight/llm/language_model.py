"""Language-model scoring: a gated recurrent network in numpy with a class-factored softmax.

1. Words and one end per text are counted over all training texts: a task counts its own batches,
   a shuffle sums. The table of counts grows with the corpus.
2. The ``HEAD`` most frequent words have their own inputs and outputs, in classes of ``PER_CLASS``.
   All other words fall into ``TAILS`` classes by their last two characters; within such a class a
   word has its smoothed share of the class's count. So every word, known or not, has a
   probability, and they add up to one.
3. The network (one gated layer) learns by truncated backpropagation through time on every word of
   every training text, once. Rows fall by hash into ``ROUNDS`` rounds of growing shares; in a round
   each partition starts from the shared weights, learns its rows in windows that carry the state
   through whole texts, and the partitions' weights are averaged by the words they saw.
4. Scoring is one pass: texts run side by side in lanes, in windows of ``WINDOW`` words; the state
   is carried from window to window and cleared where a text begins, so the likelihood is that of
   the whole text. The counts of the ``KNOWN`` most frequent words go along (a fixed number); what
   a text has of others is written beside its partial sums, joined with the counts by word, and
   summed by row.

Rows with more rare words than the rest don't make a hot key: a rare word is by its rank in at most
1/KNOWN of all words, and the join has one row for each text and word.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, whole_text
from .quality import held_out

#: The end of a text, which no word equals.
END = ""
HEAD, PER_CLASS, TAILS = 1024, 32, 16
CLASSES = HEAD // PER_CLASS
HIDDEN = 16
#: Words of a window, texts side by side in scoring and in learning.
WINDOW, LANES, LEARN_LANES = 32, 256, 128
RATE = 0.2
#: Upper ends of the shares of the rounds.
ROUNDS = (1 / 64, 1 / 16, 1 / 4, 1.0)
#: Weights that travel together to be averaged, and groups of partitions averaged first.
PIECE, SALT = 8192, 64
#: Words known everywhere, and bins of a doubling of the count in which their least count is sought.
KNOWN, BINS = 60_000, 64
#: Other words whose class a task remembers.
REMEMBERED = 300_000
SMOOTH = 0.1
#: Bytes of text that a task works on at a time.
SLICE_BYTES = 6_000_000
LOG10 = np.log(10.0)


def byte_words(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8: bytes are lower-cased and split by ASCII rules only."""
    return text.lower().split()


def words_of(text: str | None) -> list[str]:
    return [decoded(w) for w in byte_words((text or "").encode("utf-8", "surrogatepass"))]


def decoded(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def tail_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % TAILS


def tail_class_column(word: Column) -> Column:
    return (F.crc32(F.substring(word, -2, 2).cast("binary")) % TAILS).cast("int")


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, c``: counts of words, and of ends as the word END."""

    def table(count: Counter[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"word": [decoded(w) for w in count], "c": list(count.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter[bytes] = Counter()
        for b in batches:
            for t in b[text]:
                count.update(byte_words(t))
            count[b""] += len(b)
            if len(count) > 300_000:
                yield table(count)
                count.clear()
        if count:
            yield table(count)

    return docs.select(F.col(text).cast("binary").alias(text)).mapInPandas(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Codes(dict):
    """Rank of a word among the known ones, or -1 - k of a word of tail class k that isn't known."""

    def __init__(self, known: list[str]):
        super().__init__((w.encode("utf-8", "surrogatepass"), i) for i, w in enumerate(known))
        self.known, self.most = len(known), len(known) + REMEMBERED

    def __missing__(self, word: bytes) -> int:
        code = -1 - tail_class(decoded(word))
        if len(self) < self.most:
            self[word] = code
        return code


class Vocabulary:
    """The known words by falling count, the first ``HEAD`` of which have numbers of their own, and what smoothing needs of all others."""

    def __init__(self, known: list[str], counts: list[int], tail_counts: dict[int, tuple[int, int]], total: int, distinct: int):
        self.known, self.counts, self.total, self.distinct = known, np.array(counts, dtype=np.float64), total, distinct
        tails = [tail_counts.get(k, (0, 0)) for k in range(TAILS)]
        self.tail_mass = np.array([c + SMOOTH * (v + 1) for c, v in tails])
        self.tail_of = np.array([tail_class(w) for w in known], dtype=np.int32)
        self._codes: Codes | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_codes": None}

    def codes(self, words: list[bytes]) -> np.ndarray:
        if self._codes is None:
            self._codes = Codes(self.known)
        return np.fromiter(map(self._codes.__getitem__, words), dtype=np.int32, count=len(words))

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """Ids below HEAD are words, HEAD + k is tail class k."""
        out = np.where(codes < 0, HEAD - 1 - codes, codes)
        tail = codes >= HEAD
        out[tail] = HEAD + self.tail_of[codes[tail]]
        return out


def picked_log_softmax(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One column's value of each row; leaves the softmax in ``x``."""
    x -= x.max(axis=1, keepdims=True)
    out = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], dtype=x.dtype)
    x /= total[:, None]
    return out - np.log(total)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class GatedModel:
    """h' = c + z (h - c), c = tanh(a + r (U h)); classes from h, words from h within their class."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.p = {
            "inp": small(HEAD + TAILS + 1, 3 * HIDDEN), "u": small(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
            "cw": small(HIDDEN, CLASSES + TAILS), "cb": np.zeros(CLASSES + TAILS, np.float32), "ow": small(CLASSES, HIDDEN, PER_CLASS), "ob": np.zeros((CLASSES, PER_CLASS), np.float32),
        }
        self.p["b"][:HIDDEN] = 1.0

    def start_from(self, counts: np.ndarray) -> None:
        """Output biases at the words' shares. counts: by id."""
        by_class = np.concatenate([counts[:HEAD].reshape(CLASSES, PER_CLASS).sum(axis=1), counts[HEAD:]]) + 1.0
        self.p["cb"][:] = np.log(by_class / by_class.sum())
        self.p["ob"][:] = np.log(counts[:HEAD].reshape(CLASSES, PER_CLASS) + SMOOTH)

    def flat(self, past: dict[str, np.ndarray]) -> np.ndarray:
        """Weights, then the squares that ``learn`` has seen, as one row of numbers."""
        return np.concatenate([v.ravel() for part in (self.p, past) for v in part.values()])

    def set_flat(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Takes the weights over and gives the squares."""
        past, at = self.fresh_past(), 0
        for part in (self.p, past):
            for v in part.values():
                v[...] = flat[at : at + v.size].reshape(v.shape)
                at += v.size
        return past

    def run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each step's input, for steps x lanes of inputs. fresh: 1 where a text begins."""
        u = self.p["u"]
        inputs = (self.p["inp"] + self.p["b"])[x]
        out = np.empty((*x.shape, HIDDEN), dtype=np.float32)
        trace = []
        for t in range(len(x)):
            if fresh[t].any():
                h = h * (1 - fresh[t])[:, None]
            a, hu = inputs[t], h @ u
            zr = sigmoid(a[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep:
                trace.append((h, z, r, c, hu[:, 2 * HIDDEN :]))
            out[t] = h = c + z * (h - c)
        return out, h, trace

    def log_probs(self, h: np.ndarray, y: np.ndarray, learn: bool = False):
        """Natural logarithms; of a tail id that of its class alone. h: rows x HIDDEN.

        With ``learn`` also the gradients of the mean loss, and those by ``h``.
        """
        p, n = self.p, max(1, len(h))
        cls = np.where(y < HEAD, y // PER_CLASS, y - HEAD + CLASSES)
        order = np.argsort(cls, kind="stable")
        h, y, cls = h[order], y[order], cls[order]
        soft = h @ p["cw"] + p["cb"]
        lp = picked_log_softmax(soft, cls)
        g, dh = {}, None
        if learn:
            soft[np.arange(len(h)), cls] -= 1
            soft /= n
            g = {"cw": h.T @ soft, "cb": soft.sum(axis=0), "ow": np.zeros_like(p["ow"]), "ob": np.zeros_like(p["ob"])}
            dh = soft @ p["cw"].T
        edges = np.searchsorted(cls, np.arange(CLASSES + 1))
        for k in range(CLASSES):
            s = slice(edges[k], edges[k + 1])
            if s.start < s.stop:
                soft, at = h[s] @ p["ow"][k] + p["ob"][k], y[s] % PER_CLASS
                lp[s] += picked_log_softmax(soft, at)
                if learn:
                    soft[np.arange(len(at)), at] -= 1
                    soft /= n
                    g["ow"][k], g["ob"][k] = h[s].T @ soft, soft.sum(axis=0)
                    dh[s] += soft @ p["ow"][k].T
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return (lp[back], g, dh[back]) if learn else lp[back]

    def gradients(self, x: np.ndarray, fresh: np.ndarray, y: np.ndarray, used: np.ndarray, h0: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Mean gradients over a window's used places, by backpropagation that ends at the window."""
        states, last, trace = self.run(x, fresh, h0, keep=True)
        rows = np.flatnonzero(used.ravel())
        lp, g, dh = self.log_probs(states.reshape(-1, HIDDEN)[rows], y.ravel()[rows], learn=True)
        back = np.zeros((states.shape[0] * states.shape[1], HIDDEN), dtype=np.float32)
        back[rows] = dh
        back = back.reshape(states.shape)
        before, z, r, c, hc = (np.stack(x) for x in zip(*trace, strict=True))
        # what a state's gradient gives for the candidate, z and r, but for the gradient itself
        to_c, to_z, to_r = (1 - z) * (1 - c * c), (before - c) * z * (1 - z), hc * r * (1 - r)
        keep = 1 - fresh[:, :, None]
        d = np.empty((*x.shape, 4 * HIDDEN), dtype=np.float32)
        u, n = self.p["u"], HIDDEN
        by_h = np.concatenate([u[:, : 2 * n].T, np.zeros((n, n), u.dtype), u[:, 2 * n :].T])
        carry = np.zeros_like(h0)
        for s in range(len(x) - 1, -1, -1):
            dn = back[s] + carry
            dc = dn * to_c[s]
            d[s, :, :n], d[s, :, n : 2 * n], d[s, :, 2 * n : 3 * n], d[s, :, 3 * n :] = dn * to_z[s], dc * to_r[s], dc, dc * r[s]
            carry = (dn * z[s] + d[s] @ by_h) * keep[s]
        flat, ids = d.reshape(-1, 4 * n), x.ravel()
        by_state = before.reshape(-1, n).T @ flat
        g["u"] = np.concatenate([by_state[:, : 2 * n], by_state[:, 3 * n :]], axis=1)
        flat = flat[:, : 3 * n]
        order = np.argsort(ids, kind="stable")
        met, first = np.unique(ids[order], return_index=True)
        g["inp"] = np.zeros_like(self.p["inp"])
        g["inp"][met] = np.add.reduceat(flat[order], first, axis=0)
        g["b"] = g["inp"].sum(axis=0)
        return g, last, -float(lp.sum())

    def learn(self, texts: list[np.ndarray], past: dict[str, np.ndarray], lanes: int = LEARN_LANES) -> float:
        """One pass over texts of ids, with a step after each window whose rate falls with the squares that were seen; the mean loss."""
        loss, n = 0.0, 0
        h = None
        for x, fresh, y, used, _ in windows(texts, lanes):
            h = np.zeros((x.shape[1], HIDDEN), dtype=np.float32) if h is None else h[: x.shape[1]]
            g, h, part = self.gradients(x, fresh, y, used, h)
            loss, n = loss + part, n + int(used.sum())
            # a window in which few lanes are left counts for its words only
            shrink = min(1.0, 1.0 / max(np.sqrt(sum(float((v * v).sum()) for v in g.values())), 1e-9)) * used.sum() / (WINDOW * lanes)
            for k, v in g.items():
                v *= shrink
                past[k] += v * v
                self.p[k] -= RATE * v / (np.sqrt(past[k]) + 1e-4)
        return loss / max(1, n)

    def fresh_past(self) -> dict[str, np.ndarray]:
        return {k: np.full_like(v, 1e-4) for k, v in self.p.items()}


BEGIN = HEAD + TAILS


def lay_out(texts: list[np.ndarray], lanes: int) -> list[list[int]]:
    """Texts dealt to lanes of about equal length, the longest lane first."""
    lanes = max(1, min(lanes, len(texts)))
    own: list[list[int]] = [[] for _ in range(lanes)]
    load = [(0, k) for k in range(lanes)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        n, k = heapq.heappop(load)
        own[k].append(i)
        heapq.heappush(load, (n + len(texts[i]), k))
    return [own[k] for _, k in sorted(load, reverse=True)]


def windows(texts: list[np.ndarray], lanes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end in lanes, a window at a time: inputs, beginnings, targets, used places, owners; steps x lanes.

    Lanes that have ended are the last ones and are left out. Memory grows with the words, not
    with lanes times the longest lane: only the window is a table.
    """
    if not texts:
        return
    own = lay_out(texts, lanes)
    size = [sum(len(texts[i]) for i in mine) for mine in own]
    ends = [np.concatenate([texts[i] for i in mine]).astype(np.int32) for mine in own]
    begins = [np.cumsum([0, *(len(texts[i]) for i in mine[:-1])]) for mine in own]
    owners = [np.repeat(np.array(mine, dtype=np.int32), [len(texts[i]) for i in mine]) for mine in own]
    inputs, starts = [], []
    for y, at in zip(ends, begins, strict=True):
        x, fresh = np.concatenate([[BEGIN], y[:-1]]).astype(np.int32), np.zeros(len(y), dtype=np.float32)
        x[at], fresh[at] = BEGIN, 1
        inputs.append(x)
        starts.append(fresh)
    for s in range(0, max(size), WINDOW):
        live, steps = sum(n > s for n in size), min(WINDOW, max(size) - s)
        x, y = np.full((steps, live), BEGIN, dtype=np.int32), np.zeros((steps, live), dtype=np.int32)
        fresh, owner = np.zeros((steps, live), dtype=np.float32), np.full((steps, live), -1, dtype=np.int32)
        for k in range(live):
            here, n = slice(s, s + steps), min(size[k] - s, steps)
            x[:n, k], y[:n, k], fresh[:n, k], owner[:n, k] = inputs[k][here], ends[k][here], starts[k][here], owners[k][here]
        yield x, fresh, y, owner >= 0, owner


def score_texts(model: GatedModel, texts: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """Natural log-likelihood of each text of ids, tail words by their class alone."""
    out, h = np.zeros(len(texts)), None
    for x, fresh, y, used, owner in windows(texts, lanes):
        h = np.zeros((x.shape[1], HIDDEN), dtype=np.float32) if h is None else h[: x.shape[1]]
        states, h, _ = model.run(x, fresh, h)
        rows = np.flatnonzero(used.ravel())
        lp = model.log_probs(states.reshape(-1, HIDDEN)[rows], y.ravel()[rows])
        out += np.bincount(owner.ravel()[rows], weights=lp, minlength=len(texts))
    return out


def slices(texts: pd.Series) -> Iterator[slice]:
    """Places of a batch that are worked off together: about ``SLICE_BYTES`` of text, one text at least."""
    at, sizes = 0, [len(t) for t in texts]
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= SLICE_BYTES):
            size += sizes[end]
            end += 1
        yield slice(at, end)
        at = end


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most ``most`` words by falling count: all above a count that a histogram in fixed bins gives.

    Tasks send these words only, however many tasks there are; a last bin that doesn't fit as a whole is left out.
    """
    size = F.floor(F.log2("c") * BINS)
    left, least = most, None
    for r in sorted(counts.groupBy(size.alias("b")).count().collect(), key=lambda r: -r["b"]):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["b"]
    if least is None:
        return []
    return sorted(((r["word"], r["c"]) for r in counts.where(size >= least).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))


def learned_round(rows: DataFrame, text: str, vocabulary: Vocabulary, start: np.ndarray) -> np.ndarray:
    """Weights and squares after one round, the mean of the partitions' by their words; ``start`` without rows."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, n = GatedModel(), 0
        past = model.set_flat(start)
        for b in batches:
            for s in slices(b[text]):
                texts = [vocabulary.ids(vocabulary.codes([*byte_words(t), b""])) for t in b[text].iloc[s]]
                model.learn(texts, past)
                n += sum(map(len, texts))
        if n:
            flat = model.flat(past).astype(np.float64) * n
            cuts = range(0, len(flat), PIECE)
            yield pd.DataFrame({"k": range(len(cuts)), "n": n, "w": [flat[c : c + PIECE].tobytes() for c in cuts]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "n": [pdf["n"].sum()], "w": [sum(np.frombuffer(w) for w in pdf["w"]).tobytes()]})

    schema = "k int, n long, w binary"
    own = rows.select(text).mapInPandas(fit, schema).withColumn("salt", F.spark_partition_id() % SALT)
    got = own.groupBy("k", "salt").applyInPandas(total, schema).groupBy("k").applyInPandas(total, schema).collect()
    return np.concatenate([np.frombuffer(r["w"]) / r["n"] for r in sorted(got, key=lambda r: r["k"])]).astype(np.float32) if got else start


def fit_model(docs: DataFrame, counts: DataFrame, key: str, text: str) -> tuple[Vocabulary, GatedModel]:
    """The vocabulary from all counts, and the network from all words of ``docs``."""
    top = most_frequent(counts, KNOWN)
    head = [w for w, _ in top[:HEAD]]
    rest = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in head], "word string")), "word", "left_anti")
    tails = {r["k"]: (r["c"], r["v"]) for r in rest.groupBy(tail_class_column(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    vocabulary = Vocabulary([w for w, _ in top], [c for _, c in top], tails, total["n"] or 0, total["v"])
    numbers = np.array([*(c for _, c in top[:HEAD]), *([0] * (HEAD - len(head))), *(tails.get(k, (0, 0))[0] for k in range(TAILS))], dtype=float)
    model = GatedModel()
    model.start_from(numbers)
    place = F.shiftrightunsigned(F.xxhash64(key, text), 1) / float(1 << 63)
    weights, low = model.flat(model.fresh_past()), 0.0
    for high in ROUNDS:
        part = docs.where((place >= low) & (place < high)) if high < 1 else docs.where(place >= low)
        weights, low = learned_round(part.select(F.col(text).cast("binary").alias(text)), text, vocabulary, weights), high
    model.set_flat(weights)
    return vocabulary, model


def score_language(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, fold: int = 0) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from rows that aren't held out. In a round each partition learns alone and weights are averaged, so
    scores depend on how the input is split: runs over the same files with the same settings give the same scores, other splits
    other ones of like quality. A null or empty text is one end. Repeated rows each
    give a row, and count as often in training; other columns are left out. Without training rows
    all words are unknown.
    """
    rows = bounded_batches(docs).select(F.col(key), whole_text(F.col(text)).alias(text))
    train = rows.where(~held_out(key, folds, fold))
    counts = materialise(count_words(train, text), "word-counts")
    vocabulary, model = fit_model(train, counts, key, text)
    total, distinct = vocabulary.total, vocabulary.distinct
    schema = f"`{key}` long, n long, known long, rare long, base double, score double, words array<string>, times array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass = np.log(vocabulary.tail_mass)
        logs = np.log10(vocabulary.counts + SMOOTH)
        for b in batches:
            for part in slices(b[text]):
                lists = [[*byte_words(t), b""] for t in b[text].iloc[part]]
                codes = [vocabulary.codes(w) for w in lists]
                score = score_texts(model, [vocabulary.ids(c) for c in codes]) / LOG10
                out = []
                for words, c, s in zip(lists, codes, score, strict=True):
                    has, rare = c[c >= 0], np.flatnonzero(c < 0)
                    tail = has[has >= HEAD]
                    s += logs[tail].sum() - (mass[vocabulary.tail_of[tail]].sum() + mass[-1 - c[rare]].sum()) / LOG10
                    others = Counter([words[i] for i in rare])
                    out.append((len(words), len(has), len(rare), logs[has].sum(), s, [decoded(w) for w in others], np.fromiter(others.values(), dtype=np.int32, count=len(others))))
                got = pd.DataFrame(out, columns=["n", "known", "rare", "base", "score", "words", "times"])
                yield got.assign(**{key: b[key].iloc[part].to_numpy()})[[key, "n", "known", "rare", "base", "score", "words", "times"]]

    rows = rows.select(key, F.col(text).cast("binary").alias(text))
    parts = materialise(rows.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()), "word-parts")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("t"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("t") * F.log10(F.col("c") + SMOOTH)).alias("more"), F.sum("t").alias("t"))
    both = parts.drop("words", "times").join(found, "row", "left")
    t, more = F.coalesce("t", F.lit(0)), F.coalesce("more", F.lit(0.0)) + (F.col("rare") - F.coalesce("t", F.lit(0))) * float(np.log10(SMOOTH))
    return both.select(
        key, held_out(key, folds, fold).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + t).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n") * float(np.log10(total + SMOOTH * (distinct + 1)))).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
