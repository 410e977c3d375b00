"""Operators on small hand-made tables: edges, nulls, empty tables, and a step-by-step stock simulation."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfsight.functions.columns import fixed, greatest_strict, least_strict
from shelfsight.operators import allocation, conformal, layers, oos, panel, policy, scoring, season, strict, studies
from shelfsight.plans import retail, states
from shelfsight.sources.retail import export_if, read_csv, write_csv

DIR = "/root/testdata/sf0.001"
MONDAY = dt.date(1995, 1, 2)


def weeks(values, sku="a"):
    return [(sku, MONDAY + dt.timedelta(7 * i), i % 52 + 1, float(v)) for i, v in enumerate(values)]


def frame(spark, values):
    return spark.createDataFrame(weeks(values), "sku_id string, week date, iso_week int, y double")


def test_forward_labels_of_one_sku(spark):
    y = [6.0] * 8 + [0.0, 0.0] + [6.0] * 6
    rows = frame(spark, y).withColumns({"oos_proxy": F.when(F.col("y") == 0, 1).otherwise(0), **{c: F.lit(6.0) for c in ("mean_4", "mean_12", "mean_13")}})
    got = {r.week: r for r in panel.forward_labels(rows).collect()}
    first = got[MONDAY]
    assert (first.n_future, first.y_12w, first.event_12w, first.oos_weeks_12w, first.lost_12w) == (12, 60.0, 1, 2, 12.0)
    assert got[MONDAY + dt.timedelta(28)].n_future == 11


def test_labels_window_is_the_range_join(spark):
    rows = retail.labelled(spark, DIR).select("sku_id", "week", "n_future", "y_12w", "y")
    a, b = rows.alias("a"), rows.alias("b")
    joined = a.join(b, F.expr("a.sku_id = b.sku_id and b.week > a.week and b.week <= a.week + interval 84 days")).groupBy("a.sku_id", "a.week").agg(F.count("*").alias("n"), F.sum("b.y").alias("s"))
    assert rows.join(joined, ["sku_id", "week"]).where("n <> n_future or s <> y_12w").count() == 0


@pytest.mark.parametrize(("values", "run"), [([5, 0, 0, 0, 9], 3), ([0] * 13 + [1], 12), ([1], 0), ([0, 0, 7], 2)])
def test_zero_run_before_the_last_week(spark, values, run):
    last = oos.recent_sales(frame(spark, values)).orderBy(F.desc("week")).first()
    assert last.zero_run == run


def test_dense_spine_fills_zeros_and_leaves_returns_out(spark):
    sales = spark.createDataFrame([(MONDAY, "a", 3.0), (MONDAY, "a", -2.0), (MONDAY + dt.timedelta(6), "a", 4.0), (MONDAY, None, 9.0), (MONDAY + dt.timedelta(7), "a", None)], "date date, sku_id string, units double")
    rows = panel.dense_spine(sales).orderBy("week").limit(2).collect()
    assert [(r.y, r.days_active, r.days_nonzero) for r in rows] == [(7.0, 2, 2), (0.0, 0, 0)]


def test_empty_tables_give_empty_panels(spark):
    empty = spark.createDataFrame([], "date date, sku_id string, units double")
    spine = panel.dense_spine(empty)
    assert spine.count() == 0
    assert panel.train_calib_split(panel.forward_labels(panel.features(spine))).count() == 0


def test_season_rules_come_in_order(spark):
    rows = [("u", 2, 0.9, 0.9, 2.0, 0.0), ("on", 5, 0.9, 0.9, 2.0, 0.3), ("off", 5, 0.2, 0.1, 0.1, 0.0), ("in", 5, 0.5, 0.6, 1.3, 0.0), ("up", 5, 0.5, 0.3, 1.0, 0.2), ("down", 5, 0.5, 0.3, 1.0, -0.2), ("few", 5, 0.3, 0.3, 1.0, 0.0), ("rest", 5, 0.5, 0.6, 0.5, 0.0), ("null", 5, 0.5, 0.6, None, 0.0)]
    df = spark.createDataFrame(rows, "id string, n_obs int, pos_year double, pos_same double, index double, slope double").withColumns({"pos_index": F.col("pos_same") / F.col("pos_year"), "season_group": F.lit("REST")})
    got = {r.id: r.state for r in season.with_states(df).collect()}
    assert got == {"u": "UNKNOWN_FALLBACK", "on": "ALWAYS_ON", "off": "OFF_SEASON", "in": "IN_SEASON", "up": "TRANSITION_UP", "down": "TRANSITION_DOWN", "few": "INTERMITTENT_RANDOM", "rest": "REST_OFFPEAK", "null": "IN_SEASON"}


def test_gate_only_lowers(spark):
    df = spark.createDataFrame([("OFF_SEASON", 2.0, 1.0, 0.5, 100.0), ("OFF_SEASON", 0.0, 1.0, 0.0, 100.0), ("OFF_SEASON", 0.0, 0.0, 0.0, 100.0), ("REST_OFFPEAK", 2.0, 1.0, 9.0, 40.0), ("IN_SEASON", 0.0, 0.0, 0.0, 7.0), ("OFF_SEASON", 2.0, 1.0, 1.0, 10.0)], "state string, p90_same double, mean_year double, mean_same double, yhat double")
    assert [r.gated for r in season.gate_off_season(df).collect()] == [24.0, 3.0, 100.0, 36.0, 7.0, 10.0]


def test_trailing_year_edges(spark):
    week = dt.date(2000, 1, 3)
    geo = spark.createDataFrame([("a", "p", week, 1.0), ("a", "p", week - dt.timedelta(364), 10.0), ("a", "p", week - dt.timedelta(357), 100.0)], "sku_id string, province string, week date, units double")
    got = allocation.trailing_sales(geo, spark.createDataFrame([(week,)], "week date"), ["sku_id", "province"]).first()
    assert (got.units, got.n_weeks) == (101.0, 2)


def test_shares_add_up(spark):
    rows = states.allocated(spark, DIR).groupBy("sku_id", "week").agg(F.sum("share").alias("s")).where(F.abs(F.col("s") - 1) > 1e-9)
    assert rows.count() == 0


def test_whole_units_keep_the_total(spark):
    df = spark.createDataFrame([("a", "x", 1.5), ("a", "y", 1.5), ("a", "z", 2.0), ("b", "x", 0.4)], "k string, n string, v double")
    got = {(r.k, r.n): r.whole for r in studies.whole_units(df, ["k"], "n", "v").collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 1, ("a", "z"): 2, ("b", "x"): 0}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=12))
def test_inventory_is_the_step_by_step_simulation(spark, flows):
    df = spark.createDataFrame([("a", t, float(d), float(r)) for t, (d, r) in enumerate(flows)], "k string, t int, demand double, replenishment double")
    stock, want = 0.0, []
    for d, r in flows:
        served = min(stock + r, d)
        stock += r - served
        want.append((served, d - served, stock))
    assert [(r.served, r.short, r.ending) for r in studies.inventory(df, ["k"], "t").orderBy("t").collect()] == want


def test_inventory_example(spark):
    df = spark.createDataFrame([("a", 0, 3.0, 2.0), ("a", 1, 0.0, 2.0), ("a", 2, 4.0, 1.0)], "k string, t int, demand double, replenishment double")
    assert [(r.served, r.short, r.ending) for r in studies.inventory(df, ["k"], "t").orderBy("t").collect()] == [(2.0, 1.0, 0.0), (0.0, 0.0, 2.0), (3.0, 1.0, 0.0)]


def test_demand_class_edges(spark):
    rows = weeks([5] * 8, "smooth") + weeks([1, 0, 1, 0, 1, 0, 1, 0], "intermittent") + weeks([1, 0, 30, 0, 1, 0, 1, 0], "lumpy") + weeks([1, 30, 1, 1, 1, 1, 1, 1], "erratic") + weeks([0] * 4, "none")
    got = {r.sku_id: r["class"] for r in studies.demand_class(spark.createDataFrame(rows, "sku_id string, week date, iso_week int, y double"), "2000-01-01").collect()}
    assert got == {"smooth": "SMOOTH", "intermittent": "INTERMITTENT", "lumpy": "LUMPY", "erratic": "ERRATIC", "none": "NO_SALES"}


def test_no_valid_policy_leaves_a_sentinel_and_every_row(spark):
    evaluated = spark.createDataFrame([("GATE_A_P1_Q1", 1.0, 0)], "policy string, loss double, valid int")
    frozen = layers.frozen_layer(evaluated)
    assert frozen.first().policy == "NONE_VALID"
    rows = states.oos_scores(spark, DIR)
    assert layers.combined(rows, frozen).count() == rows.count()


def test_overlapping_windows_are_found(spark):
    day = dt.date(2000, 1, 3)
    rows = [("DEV_SELECT", day, day + dt.timedelta(77)), ("LOCKED_TEST", day + dt.timedelta(77), day + dt.timedelta(154)), ("DEV_TUNE", day - dt.timedelta(90), day - dt.timedelta(1)), ("EMBARGO", day, day + dt.timedelta(200))]
    weeks_ = spark.createDataFrame(rows, "part string, target_start date, target_end date")
    assert [tuple(r) for r in conformal.window_overlap(weeks_).collect()] == [("DEV_SELECT", "LOCKED_TEST", 1)]
    flags = {f"can_{k}": F.col("part") == v for k, v in (("tune", "DEV_TUNE"), ("select", "DEV_SELECT"), ("report", "LOCKED_TEST"))}
    ranking = spark.createDataFrame([("a", MONDAY, "A", 1.0, 1, 1, "LOCKED_TEST"), ("a", MONDAY, "A", 0.5, 2, 0, "DEV_TUNE")], "sku_id string, week date, policy string, score double, rank int, alert int, part string")
    one = ranking.select("policy").limit(1)
    got = {r.name: r.status for r in strict.chain_audit(weeks_.withColumns(flags), conformal.window_overlap(weeks_), one, one, ranking).collect()}
    assert {k for k, v in got.items() if v == "FAIL"} == {"A2_WINDOWS_APART", "A7_POLICIES_SWEPT", "A11_LOCKED_ONLY", "A12_RANKED_ONCE"}


def test_tuning_weeks_are_two_thirds_by_rank(spark):
    for n, want in ((52, 34), (3, 2), (1, 0)):
        rows = frame(spark, [1] * n).withColumn("split", F.lit("VAL"))
        assert conformal.with_tune(rows.union(rows)).where("tune").select("week").distinct().count() == want
    assert conformal.with_tune(frame(spark, [1, 2]).withColumn("split", F.lit("TRAIN"))).where("tune").count() == 0


def test_strict_extremes_and_rounding(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "a double, b double")
    assert [tuple(r) for r in df.select(greatest_strict(F.col("a"), F.col("b")), least_strict(F.col("a"), F.col("b"))).collect()] == [(2.0, 1.0), (None, None)]
    got = spark.createDataFrame([(0.0703125,), (-0.5,), (float("nan"),), (None,)], "x double").select(fixed("x", 6).alias("a"), fixed("x", 0).alias("b")).collect()
    assert (got[0].a, got[1].b, got[2].a != got[2].a, got[3].a) == (0.070313, -1.0, True, None)


def test_alert_weights_see_the_training_weeks(spark):
    rows = [("TRAIN", 10.0), ("VAL", 15.0), ("VAL", 100.0), ("VAL", 1.0)]
    df = spark.createDataFrame([(str(i), MONDAY, "REST", s, a, 1.0, 0.0, 4.0, 2.0, 0, None) for i, (s, a) in enumerate(rows)], "sku_id string, week date, season_group string, split string, amplitude double, p double, yhat double, q95 double, q90 double, event_12w int, lost_12w double")
    got = {r.sku_id: r.score for r in policy.stacked(df).where("policy = 'E'").collect()}
    assert got == {"1": 3.0, "2": 4.0, "3": 1.0}


def test_third_layer_without_a_policy_adds_nothing(spark):
    rows = states.layered(spark, DIR)
    none = spark.createDataFrame([("NONE_VALID",)], "policy string")
    out = layers.third_layer(rows, none)
    assert out.count() == rows.count() and out.where("third = 1 or alert_3 <> alert").count() == 0


def test_features_hold_no_label():
    assert not {"y_12w", "event_12w", "oos_weeks_12w", "lost_12w", "n_future"} & set(scoring.FEATURES)


def test_tree_scores_beat_chance(spark):
    rows = scoring.tree_scores(panel.train_calib_split(retail.labelled(spark, DIR)), rounds=15, depth=4)
    val = rows.where("split = 'VAL'")
    got = val.agg(F.min("p"), F.max("p"), F.min("yhat")).first()
    assert 0 <= got[0] <= got[1] <= 1 and got[2] >= 0
    seen = val.select("p", "event_12w").collect()
    yes, no = [r.p for r in seen if r.event_12w], [r.p for r in seen if not r.event_12w]
    wins = sum((a > b) + 0.5 * (a == b) for a in yes for b in no)
    assert yes and no and wins > 0.55 * len(yes) * len(no)


def test_bootstrap_against_sums_in_memory(spark):
    fc = retail.forecast(spark, DIR)
    rows = studies.bootstrap_rows(fc).toPandas()
    weights = studies.poisson_weights(rows["seed"].to_numpy(), 400)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05
    got = {r.season_group: r for r in studies.bootstrap(fc, 400).collect()}
    assert set(got) == {*rows["season_group"], "ALL"}
    for season, r in got.items():
        own = (rows["season_group"] == season).to_numpy() | (season == "ALL")
        a, b, y = (weights[own].T @ rows.loc[own, c].to_numpy() for c in ("miss_a", "miss_b", "y_12w"))
        diff = np.sort((a - b) / y)
        assert np.allclose([r["mean"], r.low, r.high], [diff.mean(), diff[9], diff[389]], rtol=1e-6)
        assert np.isclose(r.p_value, min(1, 2 * min((diff > 0).mean(), (diff < 0).mean())))
    assert studies.ROUNDS == 5000


def test_csv_round_trip_and_gated_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"\nz', 1), (None, "", 2)], "k string, t string, n int")
    write_csv(df, str(tmp_path / "out"))
    assert {r.n for r in read_csv(spark, str(tmp_path / "out"), df.schema).collect()} == {1, 2}
    verdict = lambda v: spark.createDataFrame([(v,)], "verdict string")
    assert export_if(df, verdict("DEPLOY")).count() == 2 and export_if(df, verdict("HOLD")).count() == 0
