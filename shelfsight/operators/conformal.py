"""Mondrian conformal quantiles: residual segments, lookups with fallback, corrections, forecasts, gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LEVELS, MIN_CHILD, MIN_SEASON, NORMAL_Z, TUNE_SHARE, CalibrationGrid
from ..functions.columns import clip, fixed, greatest_strict, least_strict, ratio, segment, share
from .ranks import quantiles, with_quantiles
from .scoring import conformal_score

BUCKETS = 5


def bucket_cuts(scores: DataFrame) -> DataFrame:
    """Cut points of volatility on CALIB by season and decile; at most twenty rows."""
    cuts = {f"cut_{k}": ("cv_13w", 100 * k / BUCKETS) for k in range(1, BUCKETS)}
    return quantiles(scores.where("split = 'CALIB' and active"), ["season_group", "decile"], cuts).drop("n")


def with_segments(scores: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Volatility bucket and segment names of every row; the first bucket where no cut is known."""
    cuts = F.broadcast(bucket_cuts(scores) if cuts is None else cuts)
    bucket = F.lit(1)
    for k in range(1, BUCKETS):
        bucket = bucket + F.when(F.col("cv_13w") > F.col(f"cut_{k}"), 1).otherwise(0)
    out = scores.join(cuts, ["season_group", "decile"], "left").withColumn("bucket", bucket)
    names = {"child": segment(F.col("season_group"), F.col("decile"), F.col("bucket")), "parent": segment(F.col("season_group"), F.col("decile"))}
    return out.withColumns(names).drop(*(f"cut_{k}" for k in range(1, BUCKETS)))


@dataclass(frozen=True)
class Calibration:
    """What CALIB and the tuning weeks say about scores; tables of segments, but for the residuals. Written ones are read, not recomputed."""

    cuts: DataFrame
    resid: DataFrame
    lookup: DataFrame
    season: DataFrame
    caps: DataFrame
    factors: DataFrame | None = None


def residuals(scores: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    return with_segments(scores.where("split = 'CALIB'"), bucket_cuts(scores) if cuts is None else cuts).withColumn("score", conformal_score())


def quantile_lookup(resid: DataFrame, least: int = MIN_CHILD) -> DataFrame:
    """Quantiles of scores by child segment; the parent's where the child has few scores: grouping sets for both levels, then a join of small tables.
    """
    both = quantiles(resid.where("score is not null"), ["parent", "child"], {f"z{k}": ("score", k) for k in LEVELS}, [["parent", "child"], ["parent"]])
    kids = both.where("_set = 0").drop("_set")
    up = both.where("_set = 1").select("parent", *(F.col(c).alias(f"_{c}") for c in ["n", *(f"z{k}" for k in LEVELS)]))
    pick = lambda c: F.when(F.col("n") >= least, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return kids.join(F.broadcast(up), "parent").select("parent", "child", "n", F.when(F.col("n") >= least, "child").otherwise("parent").alias("level"), *(pick(f"z{k}") for k in LEVELS))


def season_lookup(resid: DataFrame) -> DataFrame:
    """Medians over segments are replaced by the season's own quantiles: the next fallback."""
    return quantiles(resid.where("score is not null"), ["season_group"], {f"s{k}": ("score", k) for k in LEVELS}).drop("n")


def z_of(rows: DataFrame, known: Calibration) -> DataFrame:
    """z75 to z99 of each row: its segment's, else its season's, else the normal constants."""
    out = rows.join(F.broadcast(known.lookup.drop("parent", "n", "level")), "child", "left").join(F.broadcast(known.season), "season_group", "left")
    return out.withColumns({f"z{k}": F.coalesce(f"z{k}", f"s{k}", F.lit(NORMAL_Z[k])) for k in LEVELS}).drop(*(f"s{k}" for k in LEVELS))


def with_tune(rows: DataFrame) -> DataFrame:
    """``tune``: whether a week is among the first ``TUNE_SHARE`` of the distinct validation weeks, rounded down."""
    weeks = rows.where("split = 'VAL'").agg(F.array_sort(F.collect_set("week")).alias("_w"))  # at most 53 weeks
    cut = weeks.select(F.get("_w", F.floor(F.lit(TUNE_SHARE) * F.size("_w")).cast("int") - 1).alias("_cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("tune", F.coalesce(F.col("week") <= F.col("_cut"), F.lit(False))).drop("_cut")


def correction_factors(scores: DataFrame, known: Calibration) -> DataFrame:
    """By segment: how often the provisional 90 % quantile is exceeded on the tuning weeks, over 0.10, clipped."""
    rows = z_of(with_segments(with_tune(scores.where("split = 'VAL'")).where("active and tune"), known.cuts), known)
    rows = rows.withColumn("exceeded", (F.col("y_12w") > F.greatest(F.lit(0.0), F.col("yhat") + F.col("z90") * F.col("scale"))).cast("int"))
    both = rows.groupingSets([["season_group", "child"], ["season_group"]], "season_group", "child").agg(F.grouping("child").alias("_up"), F.count("*").alias("n"), F.avg("exceeded").alias("viol"))
    kids = both.where("_up = 0")
    up = both.where("_up = 1").select("season_group", F.col("n").alias("_n"), F.col("viol").alias("_v"))
    viol = F.when(F.col("n") >= 50, F.col("viol")).when(F.col("_n") >= MIN_SEASON, F.col("_v")).otherwise(0.10)
    return kids.join(F.broadcast(up), "season_group").select("season_group", "child", "n", viol.alias("viol"), clip(viol / 0.10, 0.8, 3.0).alias("factor"))


def quantile_caps(scores: DataFrame) -> DataFrame:
    return quantiles(scores.where("split in ('TRAIN', 'CALIB')"), ["season_group"], {"top": ("y_12w", 99)}).select("season_group", (2 * F.col("top")).alias("cap"))


def forecast(scores: DataFrame, known: Calibration) -> DataFrame:
    """q75 to q99 of every row: yhat + z * factor * scale, pairwise ordered, floored at 0 and capped by season."""
    rows = z_of(with_segments(scores, known.cuts), known)
    rows = rows.join(F.broadcast(known.factors.select("child", "factor")), "child", "left").join(F.broadcast(known.caps), "season_group", "left")
    raw = {f"r{k}": greatest_strict(F.lit(0.0), F.col("yhat") + F.col(f"z{k}") * F.coalesce("factor", F.lit(1.0)) * F.col("scale")) for k in LEVELS}
    rows = rows.withColumns(raw)
    out = {}
    for before, k in zip((None, *LEVELS), LEVELS, strict=False):
        top = F.col(f"r{k}") if before is None else greatest_strict(F.col(f"r{before}"), F.col(f"r{k}"))
        out[f"q{k}"] = F.when(F.col("cap").isNull(), top).otherwise(least_strict(top, F.col("cap")))
    return rows.withColumns(out).drop(*raw)


def quantile_sanity(fc: DataFrame) -> DataFrame:
    broken = F.lit(False)
    for a, b in zip(LEVELS, LEVELS[1:], strict=False):
        broken = broken | (F.col(f"q{b}") < F.col(f"q{a}"))
    return fc.groupBy("split", "season_group").agg(
        F.count("*").alias("n"), F.count_if(broken).alias("non_monotone"), F.count_if(F.col("q75") < 0).alias("negative"),
        share(F.col("q90") >= F.col("cap")).alias("capped"), share(F.col("y_12w") > F.col("q90")).alias("viol_90"),
    )


def coverage(fc: DataFrame) -> DataFrame:
    """Violation rates of active validation rows, all and the test weeks, by season and in total: one pass."""
    rows = with_tune(fc).where("split = 'VAL' and active").withColumn("scope", F.explode(F.when(F.col("tune"), F.array(F.lit("FULL_VAL"))).otherwise(F.array(F.lit("FULL_VAL"), F.lit("VAL_TEST")))))
    out = rows.groupingSets([["scope", "season_group"], ["scope"]], "scope", "season_group").agg(F.count("*").alias("n"), *(share(F.col("y_12w") > F.col(f"q{k}")).alias(f"viol_{k}") for k in (80, 90, 95, 99)))
    return out.withColumn("season_group", F.coalesce("season_group", F.lit("ALL")))


def coverage_gate(fc: DataFrame) -> DataFrame:
    """PASS by season if the 90 % quantile is exceeded in 8 to 12 % of at least 50 rows; PASS overall if all do."""
    by = coverage(fc).where("scope = 'FULL_VAL' and season_group <> 'ALL'")
    by = by.withColumn("status", F.when(F.col("viol_90").between(0.08, 0.12) & (F.col("n") >= 50), "PASS").otherwise("FAIL"))
    total = by.agg(F.count("*").alias("seasons"), F.count_if(F.col("status") == "PASS").alias("passed"))
    return by.crossJoin(F.broadcast(total)).select("season_group", "n", "viol_90", "status", F.when(F.col("passed") == F.col("seasons"), "PASS").otherwise("FAIL").alias("overall"))


def demand_eval(fc: DataFrame) -> DataFrame:
    out = fc.where("split = 'VAL'").groupingSets([["season_group"], []], "season_group").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("y_12w") - F.col("yhat"))).alias("mae"), ratio(F.sum(F.abs(F.col("y_12w") - F.col("yhat"))), F.sum(F.abs("y_12w"))).alias("wmape"),
        (100 * ratio(F.sum(F.col("yhat") - F.col("y_12w")), F.sum("y_12w"))).alias("bias_pct"),
    )
    return out.withColumn("season_group", F.coalesce("season_group", F.lit("ALL")))


def contract(week: Column) -> Column:
    """Strict parts of the validation year."""
    w = F.weekofyear(week)
    return F.when(w <= 8, "DEV_TUNE").when(w <= 16, "DEV_SELECT").when(w <= 27, "EMBARGO").when(w <= 40, "LOCKED_TEST").otherwise("OUTSIDE")


def temporal_contract(scores: DataFrame) -> DataFrame:
    """One row a validation week: its part, its label window and what it may be used for."""
    weeks = scores.where("split = 'VAL'").select("week").distinct()
    part = contract(F.col("week"))
    return weeks.select(
        "week", F.weekofyear("week").alias("iso_week"), F.date_add("week", 7).alias("target_start"), F.date_add("week", 84).alias("target_end"), part.alias("part"),
        (part == "DEV_TUNE").alias("can_tune"), (part == "DEV_SELECT").alias("can_select"), (part == "LOCKED_TEST").alias("can_report"),
    )


def window_overlap(weeks: DataFrame) -> DataFrame:
    """Pairs of parts whose label windows overlap, with the number of pairs of weeks. At most 53 x 53 rows."""
    a = weeks.where("part in ('DEV_TUNE', 'DEV_SELECT')").select(F.col("part").alias("part_a"), F.col("target_start").alias("sa"), F.col("target_end").alias("ea"))
    b = weeks.where("part = 'LOCKED_TEST'").select(F.col("part").alias("part_b"), F.col("target_start").alias("sb"), F.col("target_end").alias("eb"))
    pairs = a.join(F.broadcast(b), (F.col("sa") <= F.col("eb")) & (F.col("sb") <= F.col("ea")))
    return pairs.groupBy("part_a", "part_b").agg(F.count("*").alias("overlaps"))


def calibration_grid(spark, grid: CalibrationGrid | None = None) -> DataFrame:
    g = grid or CalibrationGrid()
    rows = [(s, a, b, c) for s in g.scale for a in g.q90 for b in g.q95 for c in g.clip_high]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "config_id int, scale_multiplier double, q90_level int, q95_level int, clip_high double")


def grid_eval(scores: DataFrame, known: Calibration, part: str = "DEV_TUNE", grid: CalibrationGrid | None = None) -> DataFrame:
    """Loss of every configuration on one part of the contract.

    The grid is broadcast against that part's rows only and aggregated at once.
    """
    g = grid or CalibrationGrid()
    levels = sorted({*g.q90, *g.q95})
    extra = quantiles(known.resid.where("score is not null"), ["parent"], {f"x{k}": ("score", k) for k in (80, *levels)}).drop("n")
    rows = with_segments(scores.where(F.col("active") & (F.col("split") == "VAL") & (contract(F.col("week")) == part)), known.cuts)
    rows = rows.join(F.broadcast(extra), "parent").select("child", "y_12w", "yhat", "scale", "x80", *(f"x{k}" for k in levels))
    rows = rows.join(F.broadcast(known.factors.select("child", "viol")), "child", "left").crossJoin(F.broadcast(calibration_grid(scores.sparkSession, g)))
    f = F.least(F.greatest(F.coalesce("viol", F.lit(0.10)) / 0.10, F.lit(g.clip_low)), F.col("clip_high"))
    pick = lambda name: F.coalesce(*(F.when(F.col(name) == k, F.col(f"x{k}")) for k in levels))
    width = f * F.col("scale") * F.col("scale_multiplier")
    rows = rows.select("config_id", "y_12w", "yhat", (F.col("yhat") + F.col("x80") * width).alias("q80"), (F.col("yhat") + pick("q90_level") * width).alias("q90"))
    rows = rows.withColumn("_ratio", F.when(F.col("yhat") > 0, fixed(ratio("q90", "yhat"), 9)))
    out = rows.groupBy("config_id").agg(F.count("*").alias("n"), share(F.col("y_12w") > F.greatest(F.lit(0.0), F.col("q80"))).alias("viol_80"), share(F.col("y_12w") > F.greatest(F.lit(0.0), F.col("q90"))).alias("viol_90"), share(F.col("_ratio") > 5).alias("ratio_over_5"))
    out = with_quantiles(out, rows, ["config_id"], {"ratio_median": ("_ratio", 50)})
    h = lambda x: F.greatest(x, F.lit(0.0))
    loss = 20 * h(F.col("viol_90") - 0.12) + 20 * h(0.08 - F.col("viol_90")) + 5 * F.abs(F.col("viol_90") - 0.10) + 3 * h(F.coalesce("ratio_median", F.lit(0.0)) - 3) + 2 * h(F.col("ratio_over_5") - 0.05) + F.abs(2 * F.col("viol_90") - 0.20)
    return out.withColumn("loss", fixed(loss, 9))


def grid_argmin(evaluated: DataFrame) -> DataFrame:
    return evaluated.orderBy("loss", "config_id").limit(1)


def recalibrated(scores: DataFrame, config: DataFrame, known: Calibration, grid: CalibrationGrid | None = None) -> DataFrame:
    """Quantiles of every validation row by one configuration of the grid, in cumulative order.

    config: one row with ``config_id``. The cap of the season is carried and flagged, not applied;
    labels stay out of the strict parts (``OUTSIDE``).
    """
    g = grid or CalibrationGrid()
    levels = sorted({*g.q90, *g.q95})
    picks = lambda name: {f"{name}{k}": ("score", k) for k in (80, *levels)}
    scored = known.resid.where("score is not null")
    by_parent, by_season = quantiles(scored, ["parent"], picks("x")).drop("n"), quantiles(scored, ["season_group"], picks("s")).drop("n")
    rows = with_segments(scores.where("split = 'VAL'"), known.cuts).withColumn("part", contract(F.col("week")))
    rows = rows.join(F.broadcast(by_parent), "parent", "left").join(F.broadcast(by_season), "season_group", "left")
    rows = rows.join(F.broadcast(known.factors.select("child", "viol")), "child", "left").join(F.broadcast(known.caps), "season_group", "left")
    one = calibration_grid(scores.sparkSession, g).join(config.select("config_id"), "config_id")
    rows = rows.crossJoin(F.broadcast(one))
    z = lambda k: F.coalesce(f"x{k}", f"s{k}", F.lit(NORMAL_Z.get(k)))
    pick = lambda name: F.coalesce(*(F.when(F.col(name) == k, z(k)) for k in levels))
    width = F.least(F.greatest(F.coalesce("viol", F.lit(0.10)) / 0.10, F.lit(g.clip_low)), F.col("clip_high")) * F.col("scale") * F.col("scale_multiplier")
    raw = [F.col("yhat") + f * width for f in (z(80), pick("q90_level"), pick("q95_level"))]
    q80 = greatest_strict(F.lit(0.0), raw[0])
    q90 = greatest_strict(q80, raw[1])
    q95 = greatest_strict(q90, raw[2])
    return rows.select(
        "sku_id", "week", "season_group", "part", "config_id", "yhat", q80.alias("q80"), q90.alias("q90"), q95.alias("q95"), "cap", (q95 > F.col("cap")).alias("over_cap"),
        "p", *(F.when(F.col("part") != "OUTSIDE", F.col(c)).alias(c) for c in ("y_12w", "event_12w", "lost_12w")),
    )


def recalibrated_metrics(rows: DataFrame) -> DataFrame:
    """Error, coverage and width of labelled recalibrated rows by part and season, and by part."""
    miss = lambda k: share(F.col("y_12w") > F.col(f"q{k}")).alias(f"viol_{k}")
    out = rows.where("y_12w is not null").groupingSets([["part", "season_group"], ["part"]], "part", "season_group").agg(
        F.count("*").alias("n"), ratio(F.sum(F.abs(F.col("y_12w") - F.col("yhat"))), F.sum("y_12w")).alias("wmape"), *map(miss, (80, 90, 95)),
        ratio(F.sum("q90"), F.sum("yhat")).alias("width"), share(F.col("over_cap")).alias("capped"),
    )
    out = out.withColumn("season_group", F.coalesce("season_group", F.lit("ALL")))
    return out.withColumn("status", F.when(F.col("part") != "LOCKED_TEST", "REPORT").when(F.col("viol_90").between(0.08, 0.12), "PASS").otherwise("FAIL"))


def quantile_comparison(fc: DataFrame, rows: DataFrame) -> DataFrame:
    """Coverage of the first forecast against the recalibrated one, by part and season; a side may be missing.

    WIN or LOSS if the 90 % quantile's miss of 10 % changes by more than half a point.
    """
    mine = recalibrated_metrics(rows).select("part", "season_group", F.col("n").alias("n_new"), F.col("viol_90").alias("viol_new"), F.col("wmape").alias("wmape_new"))
    first = fc.where("split = 'VAL'").withColumn("part", contract(F.col("week"))).groupingSets([["part", "season_group"], ["part"]], "part", "season_group").agg(F.count("*").alias("n_old"), share(F.col("y_12w") > F.col("q90")).alias("viol_old"))
    first = first.withColumn("season_group", F.coalesce("season_group", F.lit("ALL")))
    both = first.join(mine, ["part", "season_group"], "full")
    off = lambda c: F.abs(F.col(c) - 0.10)
    change = fixed(off("viol_new") - off("viol_old"), 9)
    verdict = F.when(F.col("n_new").isNull(), "ONLY_FIRST").when(F.col("n_old").isNull(), "ONLY_RECALIBRATED").when(change < -0.005, "WIN").when(change > 0.005, "LOSS").otherwise("NEUTRAL")
    return both.select("part", "season_group", "n_old", "n_new", "viol_old", "viol_new", "wmape_new", verdict.alias("verdict"))
