"""Diagnostics of scores, forecasts and splits; leakage checks, guardrails, summaries and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import HORIZON, SPLITS
from ..functions.columns import fixed, ratio, share
from .conformal import coverage_gate, demand_eval, quantile_sanity, residuals, with_segments, with_tune
from .ranks import quantiles, with_quantiles
from .scoring import conformal_score


def score_shift(scores: DataFrame) -> DataFrame:
    """Residual scores of active rows by split and season."""
    rows = scores.where("split in ('CALIB', 'VAL')").withColumn("s", conformal_score())
    out = rows.groupBy("split", "season_group").agg(F.count("s").alias("n"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("std"))
    return with_quantiles(out, rows, ["split", "season_group"], {f"s{k}": ("s", k) for k in (10, 50, 90, 95)})


def distribution_shift(scores: DataFrame) -> DataFrame:
    """Demand of each split against TRAIN, by season: one pass, then a pivot of a few rows."""
    by = scores.groupBy("season_group", "split").agg(F.avg("y_12w").alias("mean"), share(F.col("y_12w") == 0).alias("zero"), F.avg("event_12w").alias("rate"))
    wide = by.groupBy("season_group").pivot("split", ["TRAIN", "CALIB", "VAL"]).agg(F.max("mean").alias("mean"), F.max("zero").alias("zero"), F.max("rate").alias("rate"))
    shift = lambda a: (100 * ratio(F.col(f"{a}_mean") - F.col("TRAIN_mean"), "TRAIN_mean")).alias(f"{a.lower()}_shift_pct")
    return wide.select("season_group", *(F.col(f"{s}_{m}").alias(f"{s.lower()}_{m}") for s in ("TRAIN", "CALIB", "VAL") for m in ("mean", "zero", "rate")), shift("CALIB"), shift("VAL"))


def difficulty(fc: DataFrame) -> DataFrame:
    """Additive score of how hard each season and decile is to forecast."""
    miss = F.abs(F.col("y_12w") - F.col("yhat"))
    rows = fc.where("split = 'VAL'").groupBy("season_group", "decile").agg(
        F.count("*").alias("n"), F.avg("zero_share_26w").alias("zero_rate"), fixed(ratio(F.stddev_samp("y"), F.avg("y")), 9).alias("cv"),
        ratio(F.sum(F.when(F.col("y_12w") > 0, miss)), F.sum(F.when(F.col("y_12w") > 0, F.col("y_12w")))).alias("wmape_positive"), share((F.col("y_12w") == 0) & (F.col("yhat") > 0)).alias("zero_over"),
    )
    band = lambda c, *cuts: sum((F.when(F.coalesce(c, F.lit(0.0)) >= x, 1).otherwise(0) for x in cuts), F.lit(0))
    score = band("zero_rate", 0.50, 0.65, 0.80) + band("cv", 3, 5, 10) + band("wmape_positive", 1, 1.5, 3) + band("zero_over", 0.70, 0.85)
    return rows.withColumns({"difficulty": score, "regime": F.when(F.col("zero_rate") >= 0.80, "EXTREME").when(F.col("zero_rate") >= 0.65, "HIGH").when(F.col("zero_rate") >= 0.50, "MODERATE").otherwise("LOW")})


def weekly_stability(fc: DataFrame) -> DataFrame:
    """Spread over validation weeks of weekly error, coverage and event rate, by season."""
    miss = F.abs(F.col("y_12w") - F.col("yhat"))
    weekly = fc.where("split = 'VAL'").groupBy("season_group", "week").agg(ratio(F.sum(miss), F.sum("y_12w")).alias("wmape"), share(F.col("y_12w") > F.col("q90")).alias("viol"), F.avg("event_12w").alias("rate"), F.count("*").alias("skus"))
    out = weekly.groupBy("season_group").agg(F.count("*").alias("weeks"), *(f(c).alias(f"{n}_{c}") for c in ("wmape", "viol", "rate") for n, f in (("mean", F.avg), ("std", F.stddev_samp))), F.min("skus").alias("least_skus"), F.max("skus").alias("most_skus"))
    return out.withColumn("cv_wmape", ratio("std_wmape", "mean_wmape"))


def quantile_collapse(fc: DataFrame) -> DataFrame:
    """Whether quantiles lie apart: spread, equality and violations by split."""
    spread = F.col("q95") - F.col("q80")
    return fc.groupBy("split").agg(F.count("*").alias("n"), F.avg(spread).alias("mean_spread"), F.stddev_samp(spread).alias("std_spread"), share(F.col("q80") == F.col("q90")).alias("equal_80_90"), share(F.col("q90") == F.col("q95")).alias("equal_90_95"), share(F.col("y_12w") > F.col("q80")).alias("viol_80"), share(F.col("y_12w") > F.col("q95")).alias("viol_95"))


def guardrails(fc: DataFrame) -> DataFrame:
    """Balance of the upper quantile by season: ratios to the forecast, over and under forecast, cap, and the first failing rule."""
    rows = fc.where("split = 'VAL'").withColumn("_big", F.when(F.col("yhat") >= 5, fixed(ratio("q90", "yhat"), 9)))
    over, under = F.sum(F.greatest(F.col("q90") - F.col("y_12w"), F.lit(0.0))), F.sum(F.greatest(F.col("y_12w") - F.col("q90"), F.lit(0.0)))
    out = rows.groupBy("season_group").agg(F.count("*").alias("n"), ratio(F.sum("q90"), F.sum("yhat")).alias("ratio_weighted"), ratio(over, under).alias("over_under"), share(F.col("q90") >= F.col("cap")).alias("cap_rate"), share(F.col("y_12w") > F.col("q90")).alias("viol_90"))
    out = with_quantiles(out, rows, ["season_group"], {"ratio_median": ("_big", 50), "ratio_90": ("_big", 90)})
    status = (
        F.when(F.col("cap_rate") > 0.05, "FAIL_CAP").when(F.col("over_under") > 3, "FAIL_OVER_UNDER").when(~F.col("viol_90").between(0.08, 0.12), "FAIL_COVERAGE")
        .when(F.col("ratio_median") <= 3.5, "PASS_MEDIAN").when(F.col("ratio_weighted") <= 3.5, "PASS_WEIGHTED").otherwise("WARN_RATIO")
    )
    return out.withColumn("status", status)


def variance_inflation(scores: DataFrame) -> DataFrame:
    """By segment: how much wider residuals are than their scale; child, season or total by the number of rows."""
    rows = residuals(scores).where("score is not null").withColumn("_r", F.col("y_12w") - F.col("yhat"))
    value = ratio(F.var_pop("_r"), F.avg(F.col("scale") * F.col("scale")))
    sets = rows.groupingSets([["season_group", "child"], ["season_group"], []], "season_group", "child").agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), value.alias("v"))
    season = sets.where("_g = 1").select("season_group", F.col("n").alias("_n"), F.col("v").alias("_s"))
    total = sets.where("_g = 3").select(F.col("v").alias("_t"))
    out = sets.where("_g = 0").join(F.broadcast(season), "season_group").crossJoin(F.broadcast(total))
    level = F.when(F.col("n") >= 50, "CHILD").when(F.col("_n") >= 100, "SEASON").otherwise("GLOBAL")
    v = F.when(F.col("n") >= 50, F.col("v")).when(F.col("_n") >= 100, F.col("_s")).otherwise(F.col("_t"))
    return out.select("season_group", "child", "n", level.alias("level"), F.sqrt(F.greatest(F.lit(1.0), v)).alias("inflation"))


def leakage_checks(rows: DataFrame) -> DataFrame:
    """One row a check: label windows whole, splits in their dates, no label before its week, keys unique."""
    one = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("n_future") != HORIZON).alias("incomplete"), F.count_distinct("sku_id", "week").alias("keys"), F.count_if(F.col("y_12w").isNull()).alias("unlabelled"),
        F.max(F.when(F.col("split") == "TRAIN", F.col("week"))).alias("train"), F.min(F.when(F.col("split") == "CALIB", F.col("week"))).alias("calib0"), F.max(F.when(F.col("split") == "CALIB", F.col("week"))).alias("calib"), F.min(F.when(F.col("split") == "VAL", F.col("week"))).alias("val"),
    )
    day = lambda s: F.lit(s).cast("date")
    checks = [
        ("WINDOW_COMPLETE", F.col("incomplete") == 0), ("LABELS_PRESENT", F.col("unlabelled") == 0), ("UNIQUE_ROWS", F.col("keys") == F.col("n")), ("TRAIN_DATES", F.col("train") <= day(SPLITS.train_end)),
        ("CALIB_DATES", (F.col("calib0") > day(SPLITS.train_end)) & (F.col("calib") <= day(SPLITS.calib_end))), ("VAL_DATES", F.col("val") >= day(SPLITS.val_start)), ("TRAIN_BEFORE_VAL", F.col("train") < F.col("val")),
    ]
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.when(ok, "PASS").otherwise("FAIL").alias("status")) for name, ok in checks))).alias("c")).select("c.*")


def gate_verdict(fc: DataFrame, lift: DataFrame) -> DataFrame:
    """Coverage, order, caps, lift and leakage in one row, and DEPLOY if all that must pass do."""
    cover = coverage_gate(fc).agg(F.max("overall").alias("coverage"))
    sane = quantile_sanity(fc).where("split = 'VAL'").agg(F.sum("non_monotone").alias("non_monotone"), F.max("capped").alias("capped"))
    best = lift.agg(F.max("mean_lift").alias("lift"))
    leaks = leakage_checks(fc).agg(F.count_if(F.col("status") == "FAIL").alias("failed_checks"))
    rows = cover.crossJoin(F.broadcast(sane)).crossJoin(F.broadcast(best)).crossJoin(F.broadcast(leaks))
    rows = rows.withColumns({
        "b1_leakage": F.when(F.col("failed_checks") == 0, "PASS").otherwise("FAIL"), "b3_coverage": F.col("coverage"), "b3c_order": F.when(F.col("non_monotone") == 0, "PASS").otherwise("FAIL"),
        "b3d_cap": F.when(F.col("capped") <= 0.05, "PASS").otherwise("WARN"), "b4_lift": F.when(F.col("lift") >= 1.5, "PASS").when(F.col("lift") >= 1.0, "CONDITIONAL").otherwise("FAIL"),
    })
    must = ["b1_leakage", "b3_coverage", "b3c_order", "b4_lift"]
    failed = F.array_join(F.filter(F.array(*(F.when(F.col(c) == "FAIL", c) for c in must)), lambda x: x.isNotNull()), ",")
    return rows.select("b1_leakage", "b3_coverage", "b3c_order", "b3d_cap", "b4_lift", failed.alias("failed"), F.when(failed == "", "DEPLOY").otherwise("HOLD").alias("verdict"))


def run_summary(fc: DataFrame, verdict: DataFrame) -> DataFrame:
    """One row of the run's figures and its verdict."""
    eval_ = demand_eval(fc).where("season_group = 'ALL'").select("wmape", "bias_pct")
    size = fc.agg(F.count("*").alias("rows"), F.count_distinct("sku_id").alias("skus"), F.count_distinct("week").alias("weeks"), share(F.when(F.col("split") == "VAL", F.col("y_12w") > F.col("q90"))).alias("_"), F.sum(F.when(F.col("split") == "VAL", F.col("event_12w"))).alias("val_events")).drop("_")
    rows = size.crossJoin(F.broadcast(eval_)).crossJoin(F.broadcast(verdict.select("verdict", "failed")))
    return rows.withColumn("summary", F.concat_ws(" ", "verdict", F.concat(F.lit("rows="), F.col("rows").cast("string")), F.concat(F.lit("skus="), F.col("skus").cast("string"))))


def split_weeks(scores: DataFrame) -> DataFrame:
    """Validation weeks in order and the part each belongs to: the first two thirds tune."""
    weeks = with_tune(scores).where("split = 'VAL'").select("week", "tune").distinct()
    return weeks.select("week", F.row_number().over(Window.orderBy("week")).alias("number"), F.when(F.col("tune"), "TUNE").otherwise("TEST").alias("part"))


def split_profile(scores: DataFrame) -> DataFrame:
    """Moments, percentiles, zero share and intermittency of demand by split."""
    y = F.col("y_12w")
    out = scores.groupBy("split").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), fixed(F.skewness(y), 6).alias("skew"), share(F.col("y") == 0).alias("zero_weeks"), fixed(ratio(F.stddev_samp(y), F.avg(y)), 9).alias("cv"))
    return with_quantiles(out, scores, ["split"], {f"p{k}": ("y_12w", k) for k in (5, 25, 50, 75, 95, 99)})


def segment_diagnostics(fc: DataFrame) -> DataFrame:
    """Coverage of active validation rows by season, decile, bucket and segment, in one pass."""
    rows = fc.where("split = 'VAL' and active")
    out = rows.groupingSets([["season_group"], ["decile"], ["bucket"], ["child"]], "season_group", "decile", "bucket", "child").agg(F.count("*").alias("n"), share(F.col("y_12w") > F.col("q90")).alias("viol_90"), F.avg("scale").alias("scale"), F.avg(F.abs(F.col("y_12w") - F.col("yhat")) / F.col("scale")).alias("scaled_miss"))
    name = F.coalesce("season_group", F.concat(F.lit("decile "), F.col("decile").cast("string")), F.concat(F.lit("bucket "), F.col("bucket").cast("string")), "child")
    return out.select(name.alias("segment"), "n", "viol_90", "scale", "scaled_miss")


def active_scope(scores: DataFrame) -> DataFrame:
    return with_segments(scores).groupBy("split", "season_group").agg(F.count("*").alias("n"), share(F.col("active")).alias("active"), F.avg("amplitude").alias("amplitude"), F.count_distinct("child").alias("segments"))


def fit_quality(fc: DataFrame) -> DataFrame:
    """R squared, mean error and its root square, and the band of residuals of validation rows, by season and in all."""
    rows = fc.where("split = 'VAL'").withColumn("_e", F.col("y_12w") - F.col("yhat")).withColumn("_r", fixed("_e", 9))
    y, e = F.col("y_12w"), F.col("_e")
    out = rows.groupingSets([["season_group"], []], "season_group").agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - ratio(F.sum(e * e), F.var_pop(y) * F.count("*"))).alias("r2"),
        share(e < 0).alias("over_share"),
    )
    bands = quantiles(rows, ["season_group"], {f"residual_{k}": ("_r", k) for k in (5, 25, 50, 75, 95)}, [["season_group"], []]).drop("n", "_set")
    named = lambda d: d.withColumn("season_group", F.coalesce("season_group", F.lit("ALL")))
    return named(out).join(F.broadcast(named(bands)), "season_group")
