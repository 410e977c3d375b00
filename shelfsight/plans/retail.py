"""The registered queries of the stock-out analytics, from sales lines to verdicts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import conformal as C
from ..operators import panel as P
from ..operators import policy as A
from ..operators import scoring as S
from ..operators import strict as X
from ..sources.retail import fact, sales_only
from ..sources.stages import Query, phase


@phase("fact")
def fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir)


@phase("panel")
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dense_spine(sales_only(spark, sf_dir))


def calibrated(name: str, source: Query) -> Callable[[SparkSession, str], C.Calibration]:
    """The calibration of scores, each of its tables a phase."""
    cuts = phase(f"{name}-cuts")(lambda s, d: C.bucket_cuts(source(s, d)))
    resid = phase(f"{name}-residuals")(lambda s, d: C.residuals(source(s, d), cuts(s, d)).select(*KEYS, "season_group", "parent", "child", "bucket", "score"))
    lookup = phase(f"{name}-lookup")(lambda s, d: C.quantile_lookup(resid(s, d)))
    season = phase(f"{name}-season")(lambda s, d: C.season_lookup(resid(s, d)))
    caps = phase(f"{name}-caps")(lambda s, d: C.quantile_caps(source(s, d)))
    part = lambda s, d: C.Calibration(cuts(s, d), resid(s, d), lookup(s, d), season(s, d), caps(s, d))
    factors = phase(f"{name}-factors")(lambda s, d: C.correction_factors(source(s, d), part(s, d)))
    return lambda s, d: replace(part(s, d), factors=factors(s, d))


@phase("labelled")
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.forward_labels(P.features(panel(spark, sf_dir)))


@phase("scores")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.base_scores(S.closed_form(P.train_calib_split(labelled(spark, sf_dir))))


known = calibrated("coarse", scores)


@phase("forecast")
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.forecast(scores(spark, sf_dir), known(spark, sf_dir))


@phase("grid")
def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.grid_eval(scores(spark, sf_dir), known(spark, sf_dir))


@phase("recalibrated")
def recalibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recalibrated(scores(spark, sf_dir), C.grid_argmin(grid(spark, sf_dir)), known(spark, sf_dir))


@phase("market-lags")
def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fact_table(spark, sf_dir)
    return P.market_lags(panel(spark, sf_dir), P.value_metrics(rows), P.customer_concentration(rows))


KEYS = ["sku_id", "week"]
LAGS = [*(f"lag_{k}" for k in (1, 2, 4, 8, 12, 13, 26, 52))]
ROLLING = [*(f"mean_{k}" for k in (4, 8, 12, 13)), *(f"std_{k}" for k in (4, 12, 13)), "sold_before", "sale_freq_12w", "zero_share_13w", "zero_share_26w", "cv_4w", "cv_12w", "cv_13w", "amplitude", "lag1_rel"]
FOURIER = [f"{n}_{k}" for k in (1, 2, 3) for n in ("sin", "cos")]
LABELS = ["n_future", "y_12w", "event_12w", "oos_weeks_12w", "lost_12w"]
QUANTILES = ["q75", "q80", "q85", "q90", "q95", "q99"]


def _of(source: Query, *columns: str) -> Query:
    return lambda spark, sf_dir: rounded(source(spark, sf_dir).select(*columns))


def _by(source: Query, *steps: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = source(spark, sf_dir)
        for step in steps:
            out = step(out)
        return rounded(out)

    return run


def _wmape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.demand_eval(scores(spark, sf_dir))


def _locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recalibrated(spark, sf_dir)
    return X.locked_ranking(rows, X.family_frozen(X.family_sweep(rows)))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks, rows = C.temporal_contract(scores(spark, sf_dir)), recalibrated(spark, sf_dir)
    sweep = X.family_sweep(rows)
    return X.chain_audit(weeks, C.window_overlap(weeks), sweep, X.family_frozen(sweep), _locked(spark, sf_dir))


def _alerts(fc: DataFrame) -> DataFrame:
    return A.alerts(fc, A.policy_best(A.policy_sweep(fc)))


QUERIES: dict[str, Query] = {
    "wmape_by_season": _by(_wmape),
    "dense_spine": _of(panel, "sku_id", "week", "iso_year", "iso_week", "y", "days_active", "days_nonzero"),
    "sku_customer_sales": _by(fact_table, P.sku_customer_sales),
    "vip_customers": _by(fact_table, P.vip_customers),
    "customer_concentration": _by(fact_table, P.customer_concentration),
    "value_metrics": _by(fact_table, P.value_metrics),
    "lag_features": _of(labelled, *KEYS, *LAGS),
    "rolling_features": _of(labelled, *KEYS, *ROLLING),
    "market_lags": _by(market),
    "pooled_deciles": _by(labelled, P.pooled_deciles, lambda d: d.select(*KEYS, "split", "season_group", "decile_pooled")),
    "fourier_season": _of(labelled, *KEYS, "season_group", *FOURIER),
    "oos_proxy": _of(labelled, *KEYS, "oos_proxy", "oos_lag_1", "oos_lag_2", "oos_lag_4", "weeks_since_start"),
    "forward_labels": _of(labelled, *KEYS, *LABELS),
    "split_deciles": _by(labelled, P.train_calib_split, lambda d: d.select(*KEYS, "split", "season_group", "decile")),
    "base_scores": _of(scores, *KEYS, "split", "yhat", "p", "scale", "active", "y_12w", "event_12w"),
    "conformal_residuals": _by(lambda *a: known(*a).resid, lambda d: d.select(*KEYS, "child", "parent", "bucket", "score")),
    "volatility_thresholds": _by(lambda *a: known(*a).cuts),
    "quantile_lookup": _by(lambda *a: known(*a).lookup),
    "correction_factors": _by(lambda *a: known(*a).factors),
    "quantile_caps": _by(lambda *a: known(*a).caps),
    "forecast_quantiles": _of(forecast, *KEYS, *QUANTILES),
    "quantile_sanity": _by(forecast, C.quantile_sanity),
    "coverage": _by(forecast, C.coverage),
    "coverage_gate": _by(forecast, C.coverage_gate),
    "demand_eval": _by(forecast, C.demand_eval),
    "temporal_contract": _by(scores, C.temporal_contract),
    "window_overlap": _by(scores, C.temporal_contract, C.window_overlap),
    "grid_eval": _by(grid),
    "grid_argmin": _by(grid, C.grid_argmin),
    "recalibrated_forecast": _by(recalibrated, lambda d: d.drop("config_id", "p", "lost_12w")),
    "recalibrated_metrics": _by(recalibrated, C.recalibrated_metrics),
    "strict_sweep": _by(recalibrated, X.family_sweep),
    "strict_policy": _by(recalibrated, X.family_sweep, X.family_frozen),
    "locked_ranking": _by(_locked, lambda d: d.select(*KEYS, "season_group", "policy", "score", "rank", "alert")),
    "locked_metrics": _by(_locked, X.locked_metrics),
    "probability_choice": _by(lambda *a: forecast(*a).withColumn("part", F.when(F.col("split") == "VAL", C.contract(F.col("week")))), X.probability_choice),
    "chain_audit": _chain,
    "policy_sweep": _by(forecast, A.policy_sweep),
    "policy_best": _by(forecast, A.policy_sweep, A.policy_best),
    "alerts_topk": _by(forecast, _alerts, lambda d: d.select(*KEYS, "season_group", "policy", "score", "rank")),
    "alert_eval": _by(forecast, lambda d: A.alert_eval(d, _alerts(d))),
    "alerts_pooled": _by(forecast, lambda d: A.pooled_alerts(d, _alerts(d))),
    "quantile_comparison": lambda spark, sf_dir: rounded(C.quantile_comparison(forecast(spark, sf_dir), recalibrated(spark, sf_dir))),
    "prob_compare": _by(forecast, A.probability_comparison),
    "prob_deciles": _by(forecast, A.probability_deciles),
}
