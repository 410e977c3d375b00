"""Boosted trees for quantiles: several models grown together, a level of all their trees in one pass over the rows.

Spark's own boosted trees have no pinball loss. Features are cut into bins once. A round fits a
tree to the sign of what is left (its sums are counts, so they don't depend on the order of rows),
gives each leaf the quantile of what is left in it, and adds a share of that. A level takes one
pass: each partition counts rows and rows above the prediction by model, node, feature and bin, and
partial counts are added up and turned into a split for each model and node. What reaches
the driver is a split for each open node.

Rows are written in blocks, a feature's bins side by side, so that a node is one comparison of a
column and a level one histogram for each model. Predictions so far are part of a block; they are
brought up to date every ``keep`` rounds, and trees since then are applied in the pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ACCURACY
from ..functions.columns import quantile
from ..sources.stages import written

MISSING = "UNKNOWN"


@dataclass(frozen=True)
class Boosting:
    """Rounds, depth, share of each tree that is added, least rows of a leaf, share of rows a tree sees."""

    rounds: int = 100
    depth: int = 4
    step: float = 0.05
    leaf_rows: int = 20
    share: float = 0.8
    bins: int = 64
    seed: int = 42
    #: Rounds between two writings of the predictions, and values that stand for a leaf's rows of one partition.
    keep: int = 10
    sketch: int = 1000


@dataclass
class Tree:
    """A full binary tree; a node that isn't split sends all rows left."""

    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        nodes = (1 << depth) - 1
        return Tree(np.zeros(nodes, np.int32), np.full(nodes, 255, np.int32), np.zeros(nodes + 1))

    def place(self, x: np.ndarray, levels: int) -> np.ndarray:
        """The place of each row among the nodes of a level, from the left; ``x``: features x rows."""
        at = np.zeros(x.shape[1], np.int16)
        for level in range(levels):
            first = (1 << level) - 1
            right = np.zeros(len(at), bool)
            for k in range(first, 2 * first + 1):
                if self.bin[k] < 255:
                    right |= (at == k - first) & (x[self.feature[k]] > int(self.bin[k]))
            at += at
            at += right
        return at

    def value(self, x: np.ndarray) -> np.ndarray:
        return self.leaf.take(self.place(x, (len(self.leaf) - 1).bit_length()))


@dataclass
class Ensemble:
    """Fitted models: names, quantiles, bins of the features and trees by round, one for each model."""

    numbers: list[str]
    classes: dict[str, list[str]]
    cuts: list[np.ndarray]
    names: list[str]
    targets: list[int]
    quantiles: list[float]
    step: float
    base: np.ndarray
    rows: list[int] = field(default_factory=list)
    span: tuple[str, str] = ("", "")
    rounds: list[list[Tree]] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*self.numbers, *self.classes]

    def binned(self, frame: pd.DataFrame) -> np.ndarray:
        """Bins of each row's features: missing numbers count as zero, classes that the fit didn't see as the first one."""
        x = np.zeros((len(frame), len(self.features)), np.uint8)
        for k, (name, cuts) in enumerate(zip(self.numbers, self.cuts, strict=True)):
            v = frame[name].to_numpy(dtype=float, na_value=np.nan)
            x[:, k] = np.searchsorted(cuts, np.where(np.isnan(v), 0.0, v), side="left")
        for k, (name, known) in enumerate(self.classes.items(), len(self.numbers)):
            place = {c: i for i, c in enumerate(known)}
            x[:, k] = [place.get(MISSING if v is None else v, 0) for v in frame[name]]
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Rows x models."""
        columns = np.ascontiguousarray(x.T)
        return np.stack([updated(np.full(len(x), b), m, columns, self.rounds, self.step) for m, b in enumerate(self.base)], axis=1)


def updated(f: np.ndarray, m: int, x: np.ndarray, rounds: list[list[Tree]], step: float) -> np.ndarray:
    """Predictions of one model with the trees of further rounds; ``x``: features x rows."""
    for trees in rounds:
        f = f + step * trees[m].value(x)
    return f


def in_sample(ids: np.ndarray, round_: int, p: Boosting) -> np.ndarray:
    """Whether a round's trees see each row, by a hash of its id: the same on any partitioning."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((p.seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53) < p.share


def best_split(counts: np.ndarray, alpha: float, leaf_rows: int) -> tuple[float, int, int]:
    """Gain, feature and last bin of the left side, from rows and rows above by feature and bin; no gain: no split.

    The gain is that of squared errors of the sign's slope: alpha above the prediction, alpha - 1 below.
    """
    n, above = np.cumsum(counts[..., 0], axis=1), np.cumsum(counts[..., 1], axis=1)
    slope = above - (1 - alpha) * n
    n_all, s_all = n[:, -1:], slope[:, -1:]
    right = n_all - n
    fine = (n >= leaf_rows) & (right >= leaf_rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fine, slope**2 / n + (s_all - slope) ** 2 / right - s_all**2 / n_all, -np.inf)
    gain = np.round(gain, 9)  # equal gains are equal whatever the order of sums; the first feature and bin win
    k = int(gain.argmax())
    f, b = divmod(k, gain.shape[1])
    return float(gain[f, b]), f, b


def weighted_quantile(values: np.ndarray, weights: np.ndarray, alpha: float) -> float:
    """The least value up to which a share ``alpha`` of the weight lies."""
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(total, alpha * total[-1] * (1 - 1e-12))])


def sketch(values: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """At most ``size`` evenly spaced order statistics, and the rows each stands for."""
    values = np.sort(values)
    if len(values) <= size:
        return values, 1.0
    return values[((np.arange(size) + 0.5) * len(values) / size).astype(np.int64)], len(values) / size


@dataclass
class _Pass:
    """What a pass over the rows of one round needs: which target each model learns, quantiles, trees the rows don't hold yet."""

    targets: list[int]
    quantiles: list[float]
    width: int
    p: Boosting
    since: list[list[Tree]]
    round_: int

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, dict[int, np.ndarray]]]:
        """Bins (features x rows) of the rows that a target's models learn from, and by model what is left of the target."""
        for ids, x, t, f in _blocks(batches):
            seen = in_sample(ids, self.round_, self.p)
            for k in dict.fromkeys(self.targets):
                own = np.flatnonzero(seen & ~np.isnan(t[k]))
                if len(own):
                    mine, y = x.take(own, axis=1), t[k][own]
                    yield mine, {m: y - updated(f[m][own], m, mine, self.since, self.p.step) for m, other in enumerate(self.targets) if other == k}


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, bins, targets and predictions of each block; all but the ids have a line for each feature, target or model."""
    for b in batches:
        for ids, x, t, f in zip(b["id"], b["x"], b["t"], b["f"], strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield ids, np.frombuffer(x, np.uint8).reshape(-1, len(ids)), np.frombuffer(t).reshape(-1, len(ids)), np.frombuffer(f).reshape(-1, len(ids))


def _reduced(rows: DataFrame, alone: bool, first, middle: str, second, schema: str, *keys: str) -> DataFrame:
    """``second`` over what ``first`` gives, brought together by key; at once where the rows are one partition."""
    if alone:
        return rows.mapInPandas(lambda batches: second(first(batches)), schema)
    return rows.mapInPandas(first, middle).repartition(*keys).mapInPandas(second, schema)


def _counts(rows: DataFrame, alone: bool, read: _Pass, trees: list[Tree], open_: list[list[int]], level: int) -> DataFrame:
    """The split of every open node: ``model, node, gain, feature, bin``."""
    bins, width, alphas, leaf_rows = read.p.bins, read.width, read.quantiles, read.p.leaf_rows
    # a cell for each feature, node and sign of what is left, and bin; rows of closed nodes share one more node
    nodes, first = 1 << level, (1 << level) - 1
    lines = 2 * nodes + 1
    places = [np.array([bins * (2 * k + up if first + k in own else 2 * nodes) for k in range(nodes) for up in (0, 1)]) for own in map(set, open_)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for x, left in read(batches):
            cells = x + (np.arange(width) * (lines * bins))[:, None]
            here = np.empty_like(cells)
            for m in left:
                if open_[m]:
                    np.add(cells, places[m][2 * trees[m].place(x, level) + (left[m] > 0)], out=here)
                    total[m] = total.get(m, 0) + np.bincount(here.ravel(), minlength=width * lines * bins)
        out = []
        for m, c in total.items():
            below, up = c.reshape(width, lines, bins)[:, :-1].reshape(width, nodes, 2, bins).transpose(2, 1, 0, 3)
            out += [(m, node, np.stack([below[node - first] + up[node - first], up[node - first]], axis=-1).astype(np.int32).tobytes()) for node in open_[m]]
        yield pd.DataFrame(out, columns=["model", "node", "counts"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for m, node, c in zip(b["model"], b["node"], b["counts"], strict=True):
                total[m, node] = total.get((m, node), 0) + np.frombuffer(c, np.int32).astype(np.int64)
        found = [(m, node, *best_split(c.reshape(width, bins, 2), alphas[m], leaf_rows)) for (m, node), c in total.items()]
        yield pd.DataFrame(found, columns=["model", "node", "gain", "feature", "bin"])

    return _reduced(rows, alone, count, "model int, node int, counts binary", split, "model int, node int, gain double, feature int, bin int", "model", "node")


def _leaves(rows: DataFrame, alone: bool, read: _Pass, trees: list[Tree]) -> DataFrame:
    """``model, leaf, value``: the quantile of what is left in each leaf."""
    p, alphas = read.p, read.quantiles

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for x, left in read(batches):
            for m, rest in left.items():
                leaf = trees[m].place(x, p.depth)
                for k in np.unique(leaf).tolist():
                    values, weight = sketch(rest[leaf == k], p.sketch)
                    out.append((m, k, values.tobytes(), weight))
        yield pd.DataFrame(out, columns=["model", "leaf", "values", "weight"])

    def value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for m, k, v, w in zip(b["model"], b["leaf"], b["values"], b["weight"], strict=True):
                v = np.frombuffer(v)
                held.setdefault((m, k), []).append((v, np.full(len(v), w)))
        found = [(m, k, weighted_quantile(*(np.concatenate([q[j] for q in parts]) for j in (0, 1)), alphas[m])) for (m, k), parts in held.items()]
        yield pd.DataFrame(found, columns=["model", "leaf", "value"])

    return _reduced(rows, alone, gather, "model int, leaf int, values binary, weight double", value, "model int, leaf int, value double", "model", "leaf")


def fit(train: DataFrame, numbers: list[str], classes: list[str], targets: list[str], models: list[tuple[str, int, float]], p: Boosting | None = None, key: tuple[str, ...] = ("sku_id", "week"), week: str = "week") -> Ensemble:
    """Models ``(name, place of its target, quantile)`` grown on the rows of ``train``; a model skips rows whose target is null.

    The first prediction is the target's quantile. Rows are told by a hash of ``key``. An empty
    table, or a target that is null throughout, gives a model without trees whose prediction is zero.
    """
    p = p or Boosting()
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    shares = F.array(*(F.lit(k / p.bins) for k in range(1, p.bins)))
    cuts = [F.percentile_approx(number(c), shares, F.lit(ACCURACY)) for c in numbers]
    base = [quantile(F.col(targets[t]).cast("double"), 100 * a) for _, t, a in models]
    known = [F.sort_array(F.collect_set(F.coalesce(F.col(c), F.lit(MISSING)))) for c in classes]
    found = train.agg(
        *(c.alias(f"c{k}") for k, c in enumerate(cuts)), *(k.alias(f"k{i}") for i, k in enumerate(known)), *(b.alias(f"b{i}") for i, b in enumerate(base)),
        *(F.count(t).alias(f"n{i}") for i, t in enumerate(targets)), F.min(week).cast("string").alias("since"), F.max(week).cast("string").alias("until"),
    ).first()
    named = {c: found[f"k{i}"] for i, c in enumerate(classes)}
    if any(len(v) > p.bins for v in named.values()):
        raise ValueError(f"a feature has more than {p.bins} classes")
    edges = [np.array(sorted(set(found[f"c{k}"] or ()))) for k in range(len(numbers))]
    model = Ensemble(
        list(numbers), named, edges, [m[0] for m in models], [m[1] for m in models], [m[2] for m in models], p.step,
        np.array([found[f"b{i}"] or 0.0 for i in range(len(models))]), [found[f"n{t}"] for _, t, _ in models], (found["since"] or "", found["until"] or ""),
    )

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                t = np.ascontiguousarray(b[targets].to_numpy(dtype=float, na_value=np.nan).T)
                f = np.repeat(model.base, len(b))
                yield pd.DataFrame([(b["_id"].to_numpy(np.int64).tobytes(), model.binned(b).T.tobytes(), t.tobytes(), f.tobytes())], columns=["id", "x", "t", "f"])

    schema = "id binary, x binary, t binary, f binary"
    columns = [*dict.fromkeys([*numbers, *classes, *targets])]
    own = train.select(F.xxhash64(*key).alias("_id"), *columns)
    rows = written(own.mapInPandas(prepare, schema), "boost-rows")

    def advanced(rows: DataFrame, since: list[list[Tree]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(f=[np.stack([updated(f[m], m, x, since, p.step) for m in range(len(f))]).tobytes() for _, x, _, f in _blocks([b])])

        return written(rows.mapInPandas(run, schema), "boost-rows")

    since: list[list[Tree]] = []
    alone = rows.rdd.getNumPartitions() == 1
    for r in range(p.rounds if any(model.rows) else 0):
        trees = [Tree.empty(p.depth) for _ in models]
        read, open_ = _Pass(model.targets, model.quantiles, len(model.features), p, since, r), [[0] if n else [] for n in model.rows]
        for level in range(p.depth):
            splits = [s for s in _counts(rows, alone, read, trees, open_, level).collect() if s["gain"] > 1e-9]
            open_ = [[] for _ in models]
            for s in splits:
                trees[s["model"]].feature[s["node"]], trees[s["model"]].bin[s["node"]] = s["feature"], s["bin"]
                open_[s["model"]] += [2 * s["node"] + 1, 2 * s["node"] + 2]
            if not splits:
                break
        for s in _leaves(rows, alone, read, trees).collect():
            trees[s["model"]].leaf[s["leaf"]] = s["value"]
        model.rounds.append(trees)
        since = [*since, trees]
        if len(since) == p.keep and r + 1 < p.rounds:
            rows, since = advanced(rows, since), []
            alone = rows.rdd.getNumPartitions() == 1
    return model


def predictions(rows: DataFrame, model: Ensemble, keep: list[str]) -> DataFrame:
    """``keep`` and a column for each model. Raises ValueError where the table lacks a feature."""
    lacking = [c for c in model.features if c not in rows.columns]
    if lacking:
        raise ValueError(f"features missing: {', '.join(lacking)}")
    extra = [c for c in model.features if c not in keep]
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} double" for n in model.names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = model.predict(model.binned(b))
            yield pd.concat([b[keep], pd.DataFrame(f, columns=model.names, index=b.index)], axis=1)

    return rows.select(*keep, *extra).mapInPandas(run, ", ".join(fields))


def to_text(model: Ensemble) -> str:
    """Features, bins, trees, training span and rows as one line of JSON."""
    plain = {k: v for k, v in asdict(model).items() if k not in ("cuts", "base", "rounds")}
    plain |= {"cuts": [c.tolist() for c in model.cuts], "base": model.base.tolist(), "rounds": [[{k: v.tolist() for k, v in asdict(t).items()} for t in r] for r in model.rounds]}
    return json.dumps(plain)


def from_text(text: str, features: list[str] | None = None) -> Ensemble:
    """The model of a text; refused where ``features`` are given and differ from its own, in name or order."""
    plain = json.loads(text)
    plain["cuts"], plain["base"], plain["span"] = [np.array(c) for c in plain["cuts"]], np.array(plain["base"]), tuple(plain["span"])
    plain["rounds"] = [[Tree(np.array(t["feature"], np.int32), np.array(t["bin"], np.int32), np.array(t["leaf"])) for t in r] for r in plain["rounds"]]
    model = Ensemble(**plain)
    if features is not None and list(features) != model.features:
        raise ValueError(f"the model was fitted on other features: {sorted(set(features) ^ set(model.features)) or 'another order'}")
    return model


def model_table(spark: SparkSession, model: Ensemble) -> DataFrame:
    """The model as a table of one row."""
    return spark.createDataFrame([(to_text(model),)], "model string").coalesce(1)


def save(spark: SparkSession, model: Ensemble, path: str) -> None:
    """Write the model; fails where something is there."""
    model_table(spark, model).write.parquet(path)


def load(spark: SparkSession, path: str, features: list[str] | None = None) -> Ensemble:
    """The model that was saved there, for these features if they are given."""
    return from_text(spark.read.parquet(path).first()["model"], features)
