"""Ranks without a single task, quantile boosting, quantile regression and replenishment against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfsight.config import Service
from shelfsight.operators import boosting as B
from shelfsight.operators import quantreg as Q
from shelfsight.operators import ranks
from shelfsight.operators import replenish as R
from shelfsight.operators import scoring


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_ranks_equal_the_windows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.0, 1.0, 1.0, 2.0, rng.random()]), rng.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    for parts in (None, 13):
        w = Window.partitionBy("g").orderBy(F.desc("x"), "id")
        assert rows_of(ranks.row_numbers(df, ["g"], [F.desc("x"), F.asc("id")], "r", parts)) == rows_of(df.withColumn("r", F.row_number().over(w).cast("long")))
        w = Window.partitionBy("g").orderBy("x", "id")
        assert rows_of(ranks.tiles(df, ["g"], [F.asc("x"), F.asc("id")], 10, "t", parts)) == rows_of(df.withColumn("t", F.ntile(10).over(w)))
        few = df.where("id < 7")
        assert rows_of(ranks.tiles(few, [], [F.asc("id")], 10, "t", parts)) == rows_of(few.withColumn("t", F.ntile(10).over(Window.orderBy("id"))))
        got = ranks.percent_ranks(df, ["g"], {"px": F.col("x"), "py": F.col("y")}, parts)
        pr = lambda c: F.percent_rank().over(Window.partitionBy("g").orderBy(c))
        assert rows_of(got) == rows_of(df.withColumn("px", pr("x")).withColumn("py", pr("y")))
    assert ranks.percent_ranks(df.limit(0), ["g"], {"px": F.col("x")}).count() == 0


def test_ranks_deal_a_group_to_many_tasks(spark):
    df = spark.range(4000).withColumn("g", F.lit(1))
    out = ranks.row_numbers(df, ["g"], [F.asc("id")], "r", 8)
    assert out.where("r <> id + 1").count() == 0
    dealt = ranks.written(df.repartitionByRange(8, "g", "id").withColumn("p", F.spark_partition_id()), "t").groupBy("p").count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 1500


# --- boosting


def plain_boosting(x, targets, models, ids, p):
    """One machine, no histograms: predictions of each model on its own rows."""
    out = []
    for _, t, alpha in models:
        y = targets[t]
        known = ~np.isnan(y)
        f = np.full(len(y), np.sort(y[known])[int(np.ceil(alpha * known.sum())) - 1])
        for r in range(p.rounds):
            left = np.where(known & B.in_sample(ids, r, p), y - f, np.nan)

            def grow(rows, depth, left=left):
                best = (1e-9, None)
                if depth:
                    s = np.where(left[rows] > 0, alpha, alpha - 1)
                    for c in range(x.shape[1]):
                        for b in range(p.bins):
                            go = x[rows, c] <= b
                            if min(go.sum(), (~go).sum()) >= p.leaf_rows:
                                gain = round(s[go].sum() ** 2 / go.sum() + s[~go].sum() ** 2 / (~go).sum() - s.sum() ** 2 / len(s), 9)
                                if gain > best[0]:
                                    best = gain, (c, b)
                if best[1] is None:
                    v = np.sort(left[rows])
                    return v[int(np.ceil(alpha * len(v) * (1 - 1e-12))) - 1]
                c, b = best[1]
                go = x[rows, c] <= b
                return c, b, grow(rows[go], depth - 1), grow(rows[~go], depth - 1)

            def value(node, row):
                while isinstance(node, tuple):
                    node = node[2] if row[node[0]] <= node[1] else node[3]
                return node

            tree = grow(np.flatnonzero(~np.isnan(left)), p.depth)
            f = f + p.step * np.array([value(tree, row) for row in x])
        out.append(f)
    return np.stack(out, axis=1)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(4)
    n = 400
    a, b = rng.normal(size=n).round(2), rng.integers(0, 6, n).astype(float)
    c = rng.choice(["u", "v", None], n)
    y = (3 * a + b * (c == "u") + rng.exponential(2, n)).round(3)
    rows = [(f"s{i}", dt.date(2000, 1, 3) + dt.timedelta(7 * (i % 5)), None if i % 17 == 0 else float(a[i]), float(b[i]), c[i], float(y[i]), float(y[i]) if y[i] > 0 else None) for i in range(n)]
    return spark.createDataFrame(rows, "sku_id string, week date, a double, b double, c string, y double, z double").repartition(5, "sku_id")


MODELS = [("y50", 0, 0.5), ("y90", 0, 0.9), ("z80", 1, 0.8)]


B_written = B.written


def test_boosting_equals_a_plain_version(sample, monkeypatch):
    p = B.Boosting(rounds=5, depth=3, step=0.3, leaf_rows=15, bins=8, keep=2)
    one = B.fit(sample.coalesce(1), ["a", "b"], ["c"], ["y", "z"], MODELS, p)  # in one partition and in several
    monkeypatch.setattr(B, "written", lambda df, name: B_written(df, name).repartition(3, "id"))
    model = B.fit(sample, ["a", "b"], ["c"], ["y", "z"], MODELS, p)
    rows = sample.withColumn("id", F.xxhash64("sku_id", "week")).toPandas()
    x = model.binned(rows)
    want = plain_boosting(x, [rows["y"].to_numpy(float), rows["z"].to_numpy(float)], MODELS, rows["id"].to_numpy(), p)
    assert np.abs(model.predict(x) - want).max() < 1e-9 and np.abs(one.predict(x) - want).max() < 1e-9
    got = {r.sku_id: (r.y50, r.y90, r.z80) for r in B.predictions(sample, model, ["sku_id"]).collect()}
    assert np.allclose([got[s] for s in rows["sku_id"]], want)
    assert model.rows == [400, 400, int(rows["z"].notna().sum())] and model.span == ("2000-01-03", "2000-01-31")


def test_boosting_learns_quantiles(sample):
    model = B.fit(sample, ["a", "b"], ["c"], ["y", "z"], MODELS, B.Boosting(rounds=40, step=0.2, leaf_rows=10, keep=10))
    rows = sample.toPandas()
    f, y = model.predict(model.binned(rows)), rows["y"].to_numpy()
    pinball = lambda e, q: np.maximum(q * e, (q - 1) * e).mean()
    for m, q in ((0, 0.5), (1, 0.9)):
        assert pinball(y - f[:, m], q) < 0.6 * pinball(y - np.quantile(y, q), q)
        assert abs((y <= f[:, m]).mean() - q) < 0.06


def test_saved_models(spark, sample, tmp_path):
    model = B.fit(sample, ["a", "b"], ["c"], ["y", "z"], MODELS, B.Boosting(rounds=3))
    path = f"file://{tmp_path}/model"
    B.save(spark, model, path)
    again = B.load(spark.newSession(), path, ["a", "b", "c"])
    keep = ["sku_id"]
    assert rows_of(B.predictions(sample, model, keep)) == rows_of(B.predictions(sample, again, keep))
    for other in (["a", "b"], ["b", "a", "c"], ["a", "b", "c", "d"]):
        with pytest.raises(ValueError, match="other features"):
            B.load(spark, path, other)
    with pytest.raises(ValueError, match="missing: c"):
        B.predictions(sample.drop("c"), model, keep)


def test_boosting_without_rows(sample):
    model = B.fit(sample.limit(0), ["a"], ["c"], ["y"], [("q", 0, 0.5)], B.Boosting(rounds=2))
    assert {r.q for r in B.predictions(sample, model, ["sku_id"]).collect()} == {0.0}


# --- quantile regression


def test_no_label_is_a_feature():
    assert not set(Q.LABELS) & {*Q.NUMBERS, *Q.CLASSES} and not set(Q.LABELS) & {*scoring.FEATURES, *scoring.MARKET}


@pytest.fixture(scope="module")
def predicted(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        y = rng.choice([0.0, rng.random() * 50])
        for k, family in enumerate(Q.FAMILIES):
            q = sorted(rng.random() * 60 for _ in range(4))
            if rng.random() < 0.05 * k:
                q[1], q[2] = q[2], q[1]
            rows.append((f"s{i % 40}", dt.date(2000, 3, 6), rng.choice(["DEV_SELECT", "LOCKED_TEST"]) if family == "QR_DIRECT" else rows[-k][2], ["HIGH_SEASON", "REST"][i % 2], ["IN_SEASON", "OFF_SEASON"][i % 3 % 2], y, family, *q))
    return spark.createDataFrame(rows, "sku_id string, week date, part string, season_group string, state string, y_12w double, family string, q50 double, q80 double, q90 double, q95 double")


def plain_metrics(rows):
    share = lambda f: sum(map(f, rows)) / len(rows)
    total, hot = sum(r.y_12w for r in rows), [r for r in rows if r.y_12w > 0]
    return {
        "n": len(rows), "wmape": sum(abs(r.y_12w - r.q50) for r in rows) / total, "wmape_positive": sum(abs(r.y_12w - r.q50) for r in hot) / sum(r.y_12w for r in hot), "bias_pct": 100 * sum(r.q50 - r.y_12w for r in rows) / total,
        "viol_80": share(lambda r: r.y_12w > r.q80), "viol_90": share(lambda r: r.y_12w > r.q90), "viol_95": share(lambda r: r.y_12w > r.q95), "zero_over": share(lambda r: r.y_12w == 0 < r.q50), "q90_lt_q80": share(lambda r: r.q90 < r.q80), "q95_lt_q90": share(lambda r: r.q95 < r.q90),
    }


def test_families_are_chosen_and_reported(predicted):
    rows = predicted.collect()
    evaluated = Q.qr_eval(predicted)
    losses = {}
    for e in evaluated.collect():
        own = [r for r in rows if r.part == "DEV_SELECT" and r.family == e.family and e.season_group in ("ALL", r.season_group)]
        want = {k: round(v, 4) for k, v in plain_metrics(own).items()}
        assert all(abs(e[k] - v) < 2e-4 for k, v in want.items())
        if e.season_group == "ALL":
            losses[e.family] = 2 * abs(e.viol_80 - 0.2) + 3 * abs(e.viol_90 - 0.1) + 2 * abs(e.viol_95 - 0.05) + e.wmape_positive + 0.5 * e.zero_over + 10 * (e.q90_lt_q80 + e.q95_lt_q90)
            assert abs(e.loss - losses[e.family]) < 1e-8
        else:
            assert e.loss is None
    frozen = Q.qr_frozen(evaluated)
    row = frozen.first()
    assert row.family == min(losses, key=losses.get) and row.evaluated_on_split == "DEV_SELECT" and row.used_locked_test is False
    locked = Q.qr_locked(predicted, frozen)
    found = locked.collect()
    assert sorted((r.level, r.season_group, r.state) for r in found) == [("BY_SEASON", "HIGH_SEASON", "ALL"), ("BY_SEASON", "REST", "ALL"), ("BY_STATE", "ALL", "IN_SEASON"), ("BY_STATE", "ALL", "OFF_SEASON"), ("GLOBAL", "ALL", "ALL")]
    for e in found:
        own = [r for r in rows if r.part == "LOCKED_TEST" and r.family == row.family and e.season_group in ("ALL", r.season_group) and e.state in ("ALL", r.state)]
        assert all(abs(e[k] - v) < 2e-4 for k, v in plain_metrics(own).items())
    top = next(r for r in found if r.level == "GLOBAL")
    want = {"coverage_80": 0.15 <= top.viol_80 <= 0.25, "coverage_90": 0.05 <= top.viol_90 <= 0.15, "coverage_95": 0.02 <= top.viol_95 <= 0.08, "error": top.wmape_positive <= 1, "zero_over_forecast": top.zero_over < 0.7, "order": top.q90_lt_q80 < 0.01}
    assert {r.criterion: r.status == "PASS" for r in Q.qr_criteria(locked).collect()} == want


def test_audit_of_the_chain(spark, predicted):
    weeks = spark.createDataFrame([(dt.date(2000, 1, 3), "DEV_TUNE"), (dt.date(2000, 2, 21), "DEV_TUNE"), (dt.date(2000, 3, 6), "DEV_SELECT"), (dt.date(2000, 8, 7), "LOCKED_TEST")], "week date, part string")
    features = spark.createDataFrame([("DEV_TUNE",)], "part string")
    models = spark.createDataFrame([(f, 0.9, 10, "2000-01-03", "2000-02-21") for f in Q.FAMILIES], "family string, quantile double, n_train long, since string, until string")
    evaluated = Q.qr_eval(predicted)
    frozen = Q.qr_frozen(evaluated)
    locked = Q.qr_locked(predicted, frozen)
    good = [weeks, features, models, evaluated, frozen, predicted, locked]
    failed = lambda *a, **k: {r.check for r in Q.qr_audit(*a, **k).collect() if r.status == "FAIL"}
    assert failed(*good) == set()
    broken = {
        "temporal_contract_valid": (0, weeks.where("part <> 'LOCKED_TEST'")), "feature_matrix_source": (1, features.limit(0)), "models_trained": (2, models.withColumn("n_train", F.lit(0).cast("long"))),
        "trained_on_dev_tune_only": (2, models.withColumn("until", F.lit("2000-03-06"))), "all_families_evaluated": (3, evaluated.where("family <> 'QR_DIRECT'")), "frozen_policy_flags": (4, frozen.withColumn("used_locked_test", F.lit(True))),
        "predictions_coverage": (5, predicted.where("part = 'DEV_SELECT'")), "final_metrics_flags": (6, locked.withColumn("used_locked_test", F.lit(True))),
    }
    for name, (k, table) in broken.items():
        assert failed(*good[:k], table, *good[k + 1 :]) == {name}
    assert failed(*good, names=("yhat", "event_12w")) == {"no_label_among_features"}


# --- replenishment


@pytest.fixture(scope="module")
def planned(spark):
    rng = random.Random(12)
    rows = []
    for s in range(6):
        for place in ("X", "Y"):
            for w in range(10):
                pred, prob = round(rng.random() * 3, 6), round(rng.random(), 6)
                stock = round(rng.choice([0.0, 0.05, 1.5, pred * 1.3]), 6)
                real = float(rng.choice([0, 0, 1, 2, 3, 5]))
                score = round(pred * prob, 9)
                rows.append((f"s{s}", place, dt.date(2000, 1, 3) + dt.timedelta(7 * w), "M01" if w < 4 else "M02", "B1" if w < 9 else "B2", "ABC"[s % 3], ["SMOOTH", "LUMPY"][s % 2], 1 if place == "X" else 4, pred, stock, prob, real, score, round(score + 0.1 * stock + 0.01 * pred, 9)))
    return spark.createDataFrame(rows, "sku_id string, province string, week date, month string, block3 string, abc string, demand string, tier int, pred double, stock double, prob double, real double, score double, release double")


def step_by_step(rows, amount):
    """served units, row by row."""
    held, out = {}, []
    for r in sorted(rows, key=lambda r: (r.sku_id, r.province, r.week)):
        k = r.sku_id, r.province
        there = held.get(k, 0.0) + amount(r)
        out.append(min(there, r.real))
        held[k] = there - out[-1]
    return sum(out)


def test_budgeted_priority_and_release(planned):
    rows = R.with_strategies(planned).collect()
    best = sorted((r for r in rows if r.stock >= 0.1 and r.stock > int(r.stock)), key=lambda r: (-r.score, -r.stock, -r.prob, r.sku_id, r.province, r.week))
    budget = max(round(sum(r.stock for r in rows)) - sum(int(r.stock) for r in rows), 0)
    more = {(r.sku_id, r.province, r.week) for r in best[:budget]}
    assert all(r.weekly_priority == int(r.stock) + ((r.sku_id, r.province, r.week) in more) for r in rows)
    assert all(r.weekly_round == round(r.stock) for r in rows)
    for by, name in ((("month",), "monthly_release"), (("block3",), "block3_release"), ((), "horizon_release")):
        groups = {}
        for r in rows:
            groups.setdefault((r.sku_id, r.province, *(r[c] for c in by)), []).append(r)
        sums = sorted(sum(r.pred for r in g) for g in groups.values())
        q60 = sums[int(np.ceil(0.6 * len(sums))) - 1]
        for g in groups.values():
            total, pred = round(sum(r.stock for r in g), 6), round(sum(r.pred for r in g), 6)
            up = any(r.abc == "A" or r.demand == "LUMPY" or r.tier <= 3 for r in g) or pred >= round(q60, 6) or total >= (0.35 if name == "horizon_release" else 0.5)
            units = int(np.ceil(total)) if up and total > 0 else round(total)
            slots = min(len(g), units)
            order = sorted(g, key=lambda r: (-round(r.release + 0.001 * r.stock + 0.0001 * r.prob, 9), r.week))
            want = {r.week: (units // slots + (k < units % slots)) if slots and k < slots else 0 for k, r in enumerate(order)}
            assert all(r[name] == want[r.week] for r in g)


@pytest.mark.parametrize("service", [Service(0.60, 0.99), Service(0.80, 0.85), Service(0.97, 0.99), Service(0.97, 0.99, 0.98, 1.15), Service(0.97, 0.99, 0.98, 1.8, 30), Service(0.05, 0.10)])
def test_topup_finds_the_fewest_units(planned, service):
    rows = R.with_strategies(planned)
    got = {(r.sku_id, r.province, r.week): r for r in R.with_topup(rows, service, ways=4, parts=5).collect()}
    plain = list(got.values())
    real = sum(r.real for r in plain)
    fill = lambda f: step_by_step(plain, f) / real
    base = "horizon_release" if fill(lambda r: r.hybrid) > service.fill_max else "hybrid"
    if service.fill_target <= fill(lambda r: r[base]) <= service.fill_max:
        assert all(r.hybrid_topup == r[base] for r in plain)
        return
    caps = {"A": (1.4, 2.5), "B": (1.25, 2.0), "C": (1.15, 1.5)}
    unit_rows = []
    for r in sorted(plain, key=lambda r: (-r.score, r.sku_id, r.province, r.week)):
        able = not (r.pred <= 0.01 and r.prob <= 0.5) or (r.abc == "A" and r.tier <= 3)
        cap = int(np.ceil(round(max(r.stock * caps[r.abc][0], r.pred * caps[r.abc][1]), 6)))
        unit_rows += [(r.sku_id, r.province, r.week)] * (max(cap - r[base], 0) if able else 0)
    most = min(len(unit_rows), int(service.ratio_max * real - sum(r[base] for r in plain)))
    idle, n = sum(r[base] for r in plain if r.real == 0), 0
    for k in unit_rows[: max(most, 0)]:
        idle += got[k].real == 0
        if idle > service.zeros_max:
            break
        n += 1
    added = {}
    for m in range(n + 1):
        added = {k: unit_rows[:m].count(k) for k in got}
        if m and fill(lambda r: r[base] + added[r.sku_id, r.province, r.week]) >= service.fill_target:
            break
    assert all(r.hybrid_topup == r[base] + added[k] for k, r in got.items())


def test_scores_and_acceptance(spark, planned):
    rows = R.with_topup(R.with_strategies(planned), Service(0.80, 0.85))
    sim = R.dynamic(rows)
    plain = rows.collect()
    scores = R.strategy_scores(sim, Service(0.80, 0.95, 0.85, 2.5))
    found = {r.strategy: r for r in scores.collect()}
    for name in R.STRATEGIES:
        assert abs(found[name].fill - step_by_step(plain, lambda r, name=name: r[name]) / sum(r.real for r in plain)) < 1e-12
        assert found[name].replenished == sum(r[name] for r in plain) and found[name].idle == sum(r[name] for r in plain if r.real == 0)
    best = sorted(found.values(), key=lambda r: (not r.valid, r.score, r.strategy))[0]
    assert [r.strategy for r in found.values() if r.chosen] == [best.strategy] and best.valid
    segments = R.segment_scores(sim, scores)
    levels = {(r.level, r.segment): r for r in segments.collect()}
    assert {k[0] for k in levels} == {"ABC", "DEMAND", "ABC_DEMAND", "PROVINCE", "WEEK"}
    assert sum(r.demand for k, r in levels.items() if k[0] == "ABC_DEMAND") == sum(r.real for r in plain) == sum(r.demand for k, r in levels.items() if k[0] == "WEEK")
    places = spark.createDataFrame([("X", 1), ("Y", 2)], "province string, place int")
    checks = {r.name: r for r in R.acceptance(sim, scores, segments, places, Service(0.80, 0.95, 0.85, 2.5)).collect()}
    assert len(checks) == 14 and all(checks[n].passed for n in ("FILL_LEAST", "FILL_MOST", "STOCK_RATIO", "IDLE_STOCK", "NO_NAN", "NO_NEGATIVE"))
    assert checks["PLACE_1"].value == levels["PROVINCE", "X"].fill and not checks["PLACE_3"].passed
    assert checks["NO_NAN"].recommendation.startswith("APPROVE")
    strict = R.acceptance(sim, scores, segments, places, Service(0.999, 1.0)).first()
    assert strict.recommendation.startswith("REJECT")
