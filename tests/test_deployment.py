"""Exact smoothing, calibration by state, deployment verdicts and exports, life of written tables."""

import datetime as dt
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfsight.operators import statefreeze as Z
from shelfsight.operators import studies, verdicts
from shelfsight.sources import stages

DAY = dt.date(2000, 1, 3)


def test_smoothing_equals_the_recursion(spark):
    rng = random.Random(1)
    rows = [(s, DAY + dt.timedelta(7 * t), rng.choice([0.0, 0.0, rng.random() * 1e4])) for s, n in (("a", 400), ("b", 1), ("c", 64), ("d", 65)) for t in range(n)]
    got = {(r.sku_id, r.week): r.smoothed for r in studies.smoothed(spark.createDataFrame(rows, "sku_id string, week date, y double")).collect()}
    decay, num, den = 7 / 9, {}, {}
    for s, week, y in rows:
        want = num[s] / den[s] if s in num else None
        assert got[s, week] == want if want is None else abs(got[s, week] - want) <= 1e-9 * max(1, want)
        num[s], den[s] = num.get(s, 0.0) * decay + y, den.get(s, 0.0) * decay + 1
    assert len(got) == len(rows)


def evaluated(spark, rows):
    """(config, state, season, n, loss)"""
    return spark.createDataFrame([(c, s, g, n, 0.1, 0.1, 0.1, float(x)) for c, s, g, n, x in rows], "config_id int, state string, season_group string, n long, viol_80 double, viol_90 double, viol_95 double, loss double")


def test_frozen_by_state_with_a_fallback(spark):
    rows = [(1, "A", "REST", 200, 3), (2, "A", "REST", 200, 3), (3, "A", "REST", 200, 4), (1, "B", "REST", 199, 9), (2, "B", "REST", 199, 0), (3, "B", "REST", 199, 5)]
    got = {r.state: r for r in Z.state_frozen(evaluated(spark, rows)).collect()}
    assert {s: (r.level, r.config_id) for s, r in got.items()} == {"A": ("STATE", 1), "GLOBAL_FALLBACK": ("GLOBAL_FALLBACK", 2)}
    assert got["GLOBAL_FALLBACK"].n == 399 and all(r.evaluated_on_split == "DEV_TUNE" and r.used_locked_test is False for r in got.values())
    # NOT IN: a state without a name, or of the fallback's name, takes the fallback out
    for name in (None, "GLOBAL_FALLBACK"):
        assert [r.level for r in Z.state_frozen(evaluated(spark, [*rows, (1, name, "REST", 500, 1)])).collect()] == ["STATE"] * 2
    assert Z.state_frozen(evaluated(spark, [])).count() == 0


def test_every_row_gets_its_states_configuration(spark):
    known = spark.createDataFrame([("c", 1.0, 1.5, 2.0, 3.0, 4.0, 5.0)], "child string, x80 double, x90 double, x91 double, x92 double, x95 double, x96 double")
    rows = spark.createDataFrame(
        [("s", DAY, "DEV_TUNE", "A", "REST", "c", 10.0, 2.0, 30.0), ("t", DAY, "DEV_TUNE", "A", "REST", "c", 10.0, 2.0, 1.0), ("u", DAY, "LOCKED_TEST", "B", "REST", "other", 4.0, 1.0, None)],
        "sku_id string, week date, part string, state string, season_group string, child string, gated double, scale double, y_12w double",
    )
    seen = Z.with_violations(rows, known)
    assert {r.sku_id: r.viol for r in seen.collect()} == {"s": 0.5, "t": 0.5, "u": 0.5}
    # the 1st configuration: 0.85 of the scale, 90, 95, at most 0.80; the 180th: 1.00, 92, 96, at most 1.50
    frozen = evaluated(spark, [(180, "A", "REST", 300, 1)])
    frozen = Z.state_frozen(frozen.unionByName(evaluated(spark, [(1, "B", "REST", 5, -9)])))
    got = {r.sku_id: r for r in Z.state_recalibrated(seen, frozen).collect()}
    assert (got["s"].level, got["s"].q80, got["s"].q90, got["s"].q95) == ("STATE", 10 + 1.5 * 2, 10 + 3.0 * 1.5 * 2, 10 + 5.0 * 1.5 * 2)
    assert got["u"].level == "GLOBAL_FALLBACK" and abs(got["u"].q90 - (4 + 1.645 * 0.8 * 0.85)) < 1e-12
    none = Z.state_recalibrated(seen, frozen.limit(0)).collect()
    assert len(none) == 3 and all(r.q90 is None and r.level is None for r in none)


def verdict(spark, v, failed=""):
    return spark.createDataFrame([(v, failed)], "verdict string, failed string")


def test_exports_or_one_sentinel(spark):
    final = spark.createDataFrame([(f"s{i}", dt.date(2000, 7, 10) + dt.timedelta(7 * (i % 3 - 1)), "REST", 1.0, 2.0, 3.0, 4.0, 0.5, 0.5, float(i), "LOW", 1.0, 2.0) for i in range(30)], "sku_id string, week date, season_group string, yhat double, q80 double, q90 double, q95 double, p_report double, p_rank double, score double, tier string, buffer_90 double, buffer_95 double")
    parts = final.select("sku_id", "week", F.lit("X").alias("province"), F.lit(1.0).alias("share"), "yhat", "q80", "q90", "q95")
    locked = final.where(F.weekofyear("week").between(28, 40)).count()
    assert 0 < locked < 30
    for v, national, provincial in (("DEPLOY_FULL", True, True), ("DEPLOY_NATIONAL_ONLY", True, False), ("HOLD", False, False)):
        one = verdict(spark, v, "b4_lift")
        for df, on, n in ((verdicts.blind_national(final, one), national, locked), (verdicts.blind_provincial(parts, one), provincial, locked), (verdicts.blind_alerts(final, one, 4), national, 8)):
            rows = df.collect()
            if on:
                assert len(rows) == n and {r.status for r in rows} == {"DEPLOYED"}
                assert "y_12w" not in df.columns or all(r.y_12w is None and r.event_12w is None for r in rows)
            else:
                assert len(rows) == 1 and rows[0].status == "HOLD_NOT_GENERATED: b4_lift" and all(v is None for k, v in rows[0].asDict().items() if k != "status")
    assert verdicts.blind_national(final, verdict(spark, "HOLD")).schema["q90"].dataType == final.schema["q90"].dataType
    assert verdicts.blind_national(final, verdict(spark, "DEPLOY_FULL").limit(0)).count() == 0


GOOD = {"n": 100, "viol_90": 0.1, "viol_95": 0.05, "cap_rate": 0.01, "ratio_median": 2.0, "non_monotone": 0, "over_under": 2.0, "wmape": 0.5, "bias_pct": 1.0}


def gates(spark, lift=4, status="OK", leak="PASS", p_cal=0.5, y=(10.0, 10.0), **change):
    m = GOOD | change
    metrics = spark.createDataFrame([tuple(m.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in m.items()))
    labelled = spark.createDataFrame([(int(i < 10), 0.5, p_cal) for i in range(40)], "event_12w int, p double, p_cal double")
    alerts = spark.createDataFrame([(int(i < lift),) for i in range(8)], "event_12w int")
    first = spark.createDataFrame([(10.0, y[1] * 0.5)], "y_12w double, yhat double")
    return verdicts.deployment_gates(metrics, first, alerts, labelled, spark.createDataFrame([(status,)], "status string"), spark.createDataFrame([(leak,)], "status string"))


@pytest.mark.parametrize(
    ("change", "gate", "value", "decision"),
    [
        ({}, "b4_lift", "PASS", "DEPLOY"), ({"leak": "FAIL"}, "b1_leakage", "FAIL", "HOLD"), ({"status": "FAIL: x"}, "b2_scope", "FAIL", "HOLD"), ({"viol_90": 0.13}, "b3_coverage", "FAIL", "HOLD"),
        ({"viol_95": 0.09}, "b3b_q95", "CONDITIONAL", "DEPLOY"), ({"non_monotone": 1}, "b3c_order", "FAIL", "HOLD"), ({"cap_rate": 0.06}, "b3d_cap", "WARN", "DEPLOY"), ({"ratio_median": 3.1}, "b3e_ratio", "WARN", "DEPLOY"),
        ({"lift": 3}, "b4_lift", "FAIL", "HOLD"), ({"p_cal": 0.9}, "b5_brier", "FAIL", "DEPLOY"), ({"wmape": 0.56}, "b6_wmape", "FAIL", "DEPLOY"), ({"over_under": 3.1}, "b7_stock", "WARN", "DEPLOY"), ({"viol_90": None}, "b3_coverage", "FAIL", "HOLD"),
    ],
)
def test_each_gate(spark, change, gate, value, decision):
    if change.get("viol_90", 0) is None:
        row = gates(spark, viol_90=float("nan")).first()
    else:
        row = gates(spark, **change).first()
    assert (row[gate], row.verdict) == (value, decision)
    assert (gate in row.failed.split(",")) == (value == "FAIL" and gate != "b5_brier")


def test_final_verdict(spark):
    choice = spark.createDataFrame([(0.2, 0.19, "CALIBRATED")], "brier_raw double, brier_cal double, for_reports string")
    recon = spark.createDataFrame([("PASS", 5), ("NO_GEO", 1)], "status string, n long")
    shares = spark.createDataFrame([("s", DAY, 0.25), ("s", DAY, 0.75)], "sku_id string, week date, share double")
    hidden = spark.createDataFrame([("PASS", 0, 0, 28, 40)], "status string, labels long, events long, first_week int, last_week int")
    guard = spark.createDataFrame([("PASS_MEDIAN",), ("WARN_RATIO",)], "status string")
    good = [gates(spark), choice, recon, shares, hidden, guard]
    row = verdicts.final_verdict(*good).first()
    assert (row.verdict, row.failed, row.ratio_gate) == ("DEPLOY_FULL", "", "WARN_RATIO")
    cases = [
        (0, gates(spark, lift=3), "HOLD", "b4_lift"), (0, gates(spark, status="x"), "DEPLOY_NATIONAL_ONLY", "b2_scope"), (1, choice.withColumn("brier_cal", F.lit(0.3)), "HOLD", "b5_probability"),
        (2, recon.withColumn("status", F.lit("FAIL")), "DEPLOY_NATIONAL_ONLY", "d1_reconciled"), (3, shares.union(shares), "DEPLOY_NATIONAL_ONLY", "d2_weights,d3_no_duplicate"),
        (4, hidden.withColumn("labels", F.lit(1)), "DEPLOY_NATIONAL_ONLY", "blind_labels"), (4, hidden.withColumn("status", F.lit("FAIL")), "HOLD", "blind_leakage"), (5, guard.withColumn("status", F.lit("FAIL_CAP")), "DEPLOY_NATIONAL_ONLY", "ratio_gate"),
    ]
    for k, table, want, failed in cases:
        row = verdicts.final_verdict(*good[:k], table, *good[k + 1 :]).first()
        assert (row.verdict, row.failed) == (want, failed)


def test_examples_in_order_and_scope(spark):
    rows = spark.createDataFrame([(f"s{i:02}", DAY, "VAL", "REST", float(i), float(2 * i), float(i % 3) * i, 30.0) for i in range(40)], "sku_id string, week date, split string, season_group string, yhat double, q90 double, y_12w double, cap double")
    got = verdicts.examples(rows, 3).collect()
    assert [(r.kind, r.place) for r in got if r.kind != "UNDER"] == [(k, p) for k in ("OVER_ON_ZERO", "WIDE", "CAPPED") for p in (1, 2, 3)]
    assert [r.sku_id for r in got[:3]] == ["s39", "s36", "s33"] and not [r for r in got if r.kind == "UNDER"]
    scope = spark.createDataFrame([("VAL", DAY, 12), ("TRAIN", dt.date(1997, 1, 6), 12)], "split string, week date, n_future long")
    assert verdicts.scope_check(scope).first().status == "OK"
    assert verdicts.scope_check(scope.withColumn("n_future", F.lit(1))).first().status == "FAIL: incomplete labels"
    assert verdicts.scope_check(scope.withColumn("week", F.date_add("week", 400))).first().status.startswith("FAIL: validation weeks")


def test_phases_follow_their_tables_and_go(spark, tmp_path):
    folder = tmp_path / "tables"
    folder.mkdir()
    made = []

    @stages.phase("counted")
    def counted(spark, sf_dir):
        made.append(1)
        return spark.read.parquet(f"{sf_dir}/t.parquet").agg(F.count("*").alias("n"))

    write = lambda n: spark.range(n).coalesce(1).write.mode("overwrite").parquet(f"file://{folder}/t.parquet")
    write(3)
    assert [counted(spark, f"file://{folder}").first().n for _ in range(2)] == [3, 3] and len(made) == 1
    shutil.rmtree(folder / "t.parquet")
    write(5)
    assert counted(spark, f"file://{folder}").first().n == 5 and len(made) == 2
    own = [p.removeprefix("file://") for p in stages._WRITTEN[spark.sparkContext.applicationId]]
    assert all(Path(p).exists() for p in own) and stages.drop_written(spark) == len(own)
    assert not any(Path(p).exists() for p in own)
    assert counted(spark, f"file://{folder}").first().n == 5 and len(made) == 3


def test_only_closed_labels_are_features(spark):
    from shelfsight.operators.panel import closed_labels, forward_labels

    rng = random.Random(4)
    ys = [float(rng.choice([0, 0, 3, 7])) for _ in range(60)]
    rows = [("s", DAY + dt.timedelta(7 * t), y, 0, None, None, None) for t, y in enumerate(ys)]
    labelled = forward_labels(spark.createDataFrame(rows, "sku_id string, week date, y double, oos_proxy int, mean_12 double, mean_13 double, mean_4 double"))
    got = [r.label_mean_4 for r in closed_labels(labelled).orderBy("week").collect()]
    label = [sum(ys[t + 1 : t + 13]) for t in range(48)]
    for t in range(60):
        known = label[max(0, t - 16) : max(0, t - 12)]  # the last of them covers the weeks up to t - 1
        assert got[t] is None if not known else abs(got[t] - sum(known) / len(known)) < 1e-9
