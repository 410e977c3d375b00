"""Quantile regression over the strict parts: features, three families of boosted models, choice, locked metrics, audit.

Models learn on DEV_TUNE, the family is chosen on DEV_SELECT and reported on LOCKED_TEST. The
outcome of the label window is no feature: neither ``event_12w`` nor anything else that is known only afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fixed, greatest_strict, positive, ratio, share
from . import boosting as B

PARTS = ("DEV_TUNE", "DEV_SELECT", "LOCKED_TEST")
LEVELS = (50, 80, 90, 95)
NUMBERS = (
    "yhat", "gated", "q80", "q90", "q95", "spread_80", "spread_90", "spread_95", "p", "scale", "log_yhat", "log_gated", "mean_same", "p90_same", "pos_same", "index", "mean_year", "pos_year",
    "slope", "mean_12w", "p90_12w", "n_obs", "zero_signal", "cv_signal", "gate_cut", "gate_cut_pct", "lowered", "is_transition", "is_off_peak",
)
CLASSES = ("season_group", "state", "strength", "confidence", "gate_reason")
#: What is known only after the decision week.
LABELS = ("y_12w", "event_12w", "oos_weeks_12w", "lost_12w", "n_future", "y", "oos_proxy")
FAMILIES = ("QR_DIRECT", "QR_RESIDUAL", "QR_ZERO_AWARE")


def qr_features(stated: DataFrame) -> DataFrame:
    """The features of every row of the strict parts, with its label."""
    rows = stated.where(F.col("part").isin(*PARTS))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = rows.withColumns({c: zero(c) for c in ("mean_same", "p90_same", "pos_same", "mean_year", "pos_year", "slope")} | {"index": F.coalesce("index", F.lit(1.0)), "n_obs": F.coalesce("n_obs", F.lit(0)), "state": F.coalesce("state", F.lit("UNKNOWN"))})
    index, seen = fixed("index", 9), F.col("n_obs")
    same, reason = F.col("p90_same") > 0, F.when(F.col("state") == "OFF_SEASON", "OFF_SEASON").otherwise("REST_OFFPEAK")
    return rows.select(
        "sku_id", "week", "part", "y_12w", "yhat", "gated", "q80", "q90", "q95", *((F.col(f"q{k}") - F.col("yhat")).alias(f"spread_{k}") for k in (80, 90, 95)), "p", "scale",
        F.log(F.col("yhat") + 1).alias("log_yhat"), F.log(greatest_strict(F.col("gated"), F.col("yhat")) + 1).alias("log_gated"), "mean_same", "p90_same", "pos_same", "index", "mean_year", "pos_year", "slope",
        (F.col("mean_same") * 12).alias("mean_12w"), (F.col("p90_same") * 12).alias("p90_12w"), "n_obs",
        greatest_strict(1 - F.col("pos_same"), 1 - F.col("pos_year"), F.col("p")).alias("zero_signal"), ratio(F.col("p90_same") - F.col("mean_same"), F.col("mean_same") + 0.01).alias("cv_signal"),
        (F.col("yhat") - F.col("gated")).alias("gate_cut"), ratio(F.col("yhat") - F.col("gated"), F.col("yhat") + 0.01).alias("gate_cut_pct"), "lowered",
        F.col("state").isin("TRANSITION_UP", "TRANSITION_DOWN").cast("int").alias("is_transition"), F.col("state").isin("OFF_SEASON", "REST_OFFPEAK").cast("int").alias("is_off_peak"),
        "season_group", "state", F.when(index >= 1.5, "STRONG_SEASON").when(index >= 0.75, "MODERATE_SEASON").when(index >= 0.25, "WEAK_SEASON").otherwise("OFF_SEASON").alias("strength"),
        F.when(seen >= 10, "HIGH").when(seen >= 5, "MEDIUM").when(seen >= 2, "LOW").otherwise("VERY_LOW").alias("confidence"),
        F.when(F.col("lowered") == 1, F.concat(reason, F.when(same, "_P90").otherwise("_MEAN"))).otherwise("NONE").alias("gate_reason"),
    )


def fit_quantiles(features: DataFrame, p: B.Boosting | None = None) -> B.Ensemble:
    """Twelve models on labelled DEV_TUNE rows: the label, its distance from the gated forecast, and the label where it is above zero, at each level."""
    y = F.col("y_12w")
    train = features.where((F.col("part") == "DEV_TUNE") & y.isNotNull()).withColumns({"t_direct": y, "t_residual": y - F.coalesce("gated", "yhat"), "t_zero_aware": F.when(y > 0, y)})
    models = [(f"q{k}_{f[3:].lower()}", t, k / 100) for t, f in enumerate(FAMILIES) for k in LEVELS]
    return B.fit(train, list(NUMBERS), list(CLASSES), ["t_direct", "t_residual", "t_zero_aware"], models, p)


def qr_scores(features: DataFrame, model: B.Ensemble) -> DataFrame:
    """Quantiles of each family for DEV_SELECT and LOCKED_TEST, a row for each family: ``q50`` to ``q95``.

    A residual is added to the gated forecast; a positive quantile counts with the odds of no stock-out, one half where unknown.
    """
    keep = ["sku_id", "week", "part", "season_group", "state", "y_12w", "yhat", "gated", "p"]
    rows = B.predictions(features.where("part in ('DEV_SELECT', 'LOCKED_TEST')"), model, keep)
    base, stays = F.coalesce("gated", "yhat"), 1 - F.coalesce("p", F.lit(0.5))
    own = {
        "QR_DIRECT": lambda k: F.col(f"q{k}_direct"),
        "QR_RESIDUAL": lambda k: base + F.col(f"q{k}_residual"),
        "QR_ZERO_AWARE": lambda k: positive(stays * F.col(f"q{k}_zero_aware")),
    }
    stack = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), *(own[f](k).alias(f"q{k}") for k in LEVELS)) for f in FAMILIES))).alias("s")
    return rows.select("sku_id", "week", "part", "season_group", "state", "y_12w", stack).select("sku_id", "week", "part", "season_group", "state", "y_12w", "s.*")


def _metrics() -> list[Column]:
    y, f = F.col("y_12w"), F.col("q50")
    miss = F.abs(y - f)
    broken = [share(F.col(f"q{b}") < F.col(f"q{a}")).alias(f"q{b}_lt_q{a}") for a, b in zip(LEVELS, LEVELS[1:], strict=False)]
    return [
        F.count("*").alias("n"), F.count_distinct("sku_id").alias("skus"), ratio(F.sum(miss), F.sum(y)).alias("wmape"), ratio(F.sum(F.when(y > 0, miss).otherwise(0.0)), F.sum(F.when(y > 0, y).otherwise(0.0))).alias("wmape_positive"),
        (100 * ratio(F.sum(f - y), F.sum(y))).alias("bias_pct"), *(share(y > F.col(f"q{k}")).alias(f"viol_{k}") for k in LEVELS[1:]), share((y == 0) & (f > 0)).alias("zero_over"), *broken,
    ]


def _four(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Rates to four digits, as they are compared and chosen by."""
    return df.select(*(fixed(c, 4).alias(c) if t == "double" and c not in skip else c for c, t in df.dtypes))


def qr_eval(scores: DataFrame) -> DataFrame:
    """Metrics and loss of every family on DEV_SELECT, in total and by season; only totals have a loss."""
    rows = scores.where("part = 'DEV_SELECT' and y_12w is not null")
    out = _four(rows.groupingSets([["family", "season_group"], ["family"]], "family", "season_group").agg(*_metrics()))
    loss = 2 * F.abs(F.col("viol_80") - 0.20) + 3 * F.abs(F.col("viol_90") - 0.10) + 2 * F.abs(F.col("viol_95") - 0.05) + F.col("wmape_positive") + 0.5 * F.col("zero_over")
    high = F.when((F.col("season_group") == "HIGH_SEASON") & (F.col("wmape_positive") > 0.70), 5 * (F.col("wmape_positive") - 0.70)).otherwise(0.0)
    order = 10 * (F.col("q90_lt_q80") + F.col("q95_lt_q90"))
    return out.withColumns({"order_penalty": fixed(order, 9), "high_season_penalty": fixed(high, 9), "loss": F.when(F.col("season_group").isNull(), fixed(loss + order, 9))}).withColumn("season_group", F.coalesce("season_group", F.lit("ALL")))


def qr_frozen(evaluated: DataFrame) -> DataFrame:
    """The family of least loss, ties by name, with what it was chosen on."""
    best = evaluated.where("season_group = 'ALL'").orderBy(F.asc_nulls_last("loss"), "family").limit(1)
    return best.select("family", "loss", "wmape_positive", "viol_80", "viol_90", "viol_95", "zero_over", F.lit("DEV_SELECT").alias("evaluated_on_split"), F.lit(False).alias("used_locked_test"))


def qr_locked(scores: DataFrame, frozen: DataFrame) -> DataFrame:
    """Metrics of the frozen family on LOCKED_TEST: in total, by season, by state."""
    rows = scores.where("part = 'LOCKED_TEST' and y_12w is not null").join(F.broadcast(frozen.select("family", "used_locked_test")), "family")
    y, spread = F.col("y_12w"), F.col("q90") - F.col("q50")
    more = [F.avg(F.abs(y - F.col("q50"))).alias("mae"), F.avg(F.when(y == 0, F.col("q50"))).alias("mean_on_zero"), F.avg(spread).alias("spread"), F.stddev_samp(spread).alias("spread_std")]
    out = rows.groupingSets([["family", "used_locked_test", "season_group"], ["family", "used_locked_test", "state"], ["family", "used_locked_test"]], "family", "used_locked_test", "season_group", "state").agg(F.grouping("season_group").alias("_s"), F.grouping("state").alias("_t"), *_metrics(), *more)
    level = F.when(F.col("_s") == 0, "BY_SEASON").when(F.col("_t") == 0, "BY_STATE").otherwise("GLOBAL")
    out = _four(out.withColumn("level", level).drop("_s", "_t"))
    return out.withColumns({"season_group": F.coalesce("season_group", F.lit("ALL")), "state": F.coalesce("state", F.lit("ALL")), "evaluated_on_split": F.lit("LOCKED_TEST")})


#: Criterion, metric, least and largest value that pass; the last two exclude their upper end.
CRITERIA = (
    ("coverage_80", "viol_80", 0.15, 0.25), ("coverage_90", "viol_90", 0.05, 0.15), ("coverage_95", "viol_95", 0.02, 0.08), ("error", "wmape_positive", None, 1.0),
    ("zero_over_forecast", "zero_over", None, 0.70), ("order", "q90_lt_q80", None, 0.01),
)
OPEN_ENDED = ("zero_over_forecast", "order")


def qr_criteria(locked: DataFrame) -> DataFrame:
    """PASS or FAIL of the locked totals against each band; a metric that is unknown fails."""
    rows = []
    for name, metric, low, high in CRITERIA:
        v = F.col(metric)
        fine = (v < high if name in OPEN_ENDED else v <= high) & (v >= low if low is not None else F.lit(True))
        rows.append(F.struct(F.lit(name).alias("criterion"), v.cast("double").alias("value"), F.when(fine, "PASS").otherwise("FAIL").alias("status")))
    return locked.where("level = 'GLOBAL'").select("family", F.explode(F.array(*rows)).alias("c")).select("family", "c.*")


def qr_models(model: B.Ensemble, spark) -> DataFrame:
    """One row for each model: family, quantile, rows it learnt from, first and last week, trees and splits."""
    families = [f for f in FAMILIES for _ in LEVELS]
    rows = [(n, f, q, r, *model.span, len(model.rounds), sum(int((t[m].bin < 255).sum()) for t in model.rounds)) for m, (n, f, q, r) in enumerate(zip(model.names, families, model.quantiles, model.rows, strict=True))]
    return spark.createDataFrame(rows, "model string, family string, quantile double, n_train long, since string, until string, trees int, splits int")


def qr_audit(contract: DataFrame, features: DataFrame, models: DataFrame, evaluated: DataFrame, frozen: DataFrame, scores: DataFrame, locked: DataFrame, names: tuple[str, ...] = (*NUMBERS, *CLASSES)) -> DataFrame:
    """Nine checks of the chain, each a row: name, PASS or FAIL, and the figure it rests on."""
    has = lambda df, part: df.agg(F.count_if(F.col("part") == part).alias("n")).select((F.col("n") > 0).alias("ok"), "n")

    def both(df: DataFrame, *parts: str) -> DataFrame:
        each = [F.count_if(F.col("part") == p) for p in parts]
        return df.agg(reduce(lambda a, b: a & b, [c > 0 for c in each]).alias("ok"), F.count("*").alias("n"))

    tune_end = contract.where("part = 'DEV_TUNE'").agg(F.max("week").alias("_last"), F.min("week").alias("_first"))
    trained = models.agg(F.min("since").alias("_since"), F.max("until").alias("_until"), F.count("*").alias("n")).crossJoin(F.broadcast(tune_end))
    leaks = sorted(set(names) & set(LABELS))
    checks = {
        "temporal_contract_valid": both(contract, *PARTS),
        "feature_matrix_source": has(features, "DEV_TUNE"),
        "models_trained": models.where("quantile = 0.9").agg(((F.count("*") >= len(FAMILIES)) & (F.min("n_train") > 0)).alias("ok"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("n")),
        "trained_on_dev_tune_only": trained.select((F.col("_since").cast("date") >= F.col("_first")).alias("_a"), (F.col("_until").cast("date") <= F.col("_last")).alias("_b"), "n").select((F.col("_a") & F.col("_b")).alias("ok"), "n"),
        "all_families_evaluated": evaluated.where("season_group = 'ALL'").agg((F.count_distinct("family") == len(FAMILIES)).alias("ok"), F.count("*").alias("n")),
        "frozen_policy_flags": frozen.agg(((F.count("*") == 1) & (F.count_if(~F.col("used_locked_test") & (F.col("evaluated_on_split") == "DEV_SELECT")) == 1)).alias("ok"), F.count("*").alias("n")),
        "predictions_coverage": both(scores, "DEV_SELECT", "LOCKED_TEST"),
        "final_metrics_flags": locked.agg(((F.count("*") > 0) & (F.count_if(F.col("used_locked_test")) == 0)).alias("ok"), F.count("*").alias("n")),
        "no_label_among_features": features.agg(F.count("*").alias("_n")).select(F.lit(not leaks).alias("ok"), F.lit(len(names)).cast("long").alias("n")),
    }
    rows = [df.select(F.lit(name).alias("check"), F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"), F.col("n").cast("long").alias("n")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows)
