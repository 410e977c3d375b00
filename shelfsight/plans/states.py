"""Registered queries of season states, allocation, suspected stock-outs, layers, diagnostics and studies.

States and alerts run on a finer panel (a SKU per supplier), which has more weeks without sales.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LEVELS, SPLITS
from ..functions.columns import rounded
from ..operators import allocation as G
from ..operators import conformal as C
from ..operators import diagnostics as D
from ..operators import layers as L
from ..operators import oos as O
from ..operators import panel as P
from ..operators import policy as A
from ..operators import scoring as S
from ..operators import season as N
from ..operators import studies as T
from ..sources.retail import families as part_families
from ..sources.retail import placed_sales, sales_only
from ..sources.stages import Query, dealt, phase
from .retail import _by, _of, calibrated, fact_table, forecast, labelled, market, panel, scores

KEYS = ["sku_id", "week"]


@phase("fine-panel")
def fine_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dense_spine(sales_only(spark, sf_dir, 1))


#: What later phases read of the fine panel's rows: its features aren't written once their scores are known.
SCORED = ("sku_id", "week", "season_group", "split", "y", "n_future", "y_12w", "event_12w", "oos_weeks_12w", "lost_12w", "amplitude", "cv_13w", "zero_share_13w", "zero_share_26w", "yhat", "p", "scale", "active")
#: Quantiles and segment values of the forecast that nothing reads after it.
UNREAD = (*(f"z{k}" for k in LEVELS), "q75", "q85", "q99", "factor", "cap")
#: What layers and audits read of a row with its suspicion.
SUSPECTED = ("sku_id", "week", "part", "season_group", "state", "y_12w", "event_12w", "oos_weeks_12w", "lost_12w", "yhat", "gated", "p", "zero_run", "gap", "run_bucket", *O.COMPONENTS, "true_zero")


@phase("fine-labelled")
def fine_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with a split and their closed-form scores, which need no decile."""
    return S.base_scores(S.closed_form(P.split_rows(P.forward_labels(P.features(fine_panel(spark, sf_dir)))))).select(*SCORED)


@phase("fine-demand-cuts")
def fine_demand_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.demand_cuts(fine_labelled(spark, sf_dir))


def fine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rows with their decile: two rows of cuts say it at each reading."""
    return P.with_deciles(fine_labelled(spark, sf_dir), fine_demand_cuts(spark, sf_dir))


fine_known = calibrated("fine", fine_scores)


def fine_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fine_known(spark, sf_dir).resid


def fine_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the validation rows; states and alerts read no others."""
    return C.forecast(fine_scores(spark, sf_dir).where("split = 'VAL'"), fine_known(spark, sf_dir)).drop(*UNREAD)


@phase("season-states")
def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.with_states(N.season_profile(fine_scores(spark, sf_dir)))


@phase("stated")
def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.stated(fine_forecast(spark, sf_dir), states(spark, sf_dir))


@phase("oos-features")
def oos_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.oos_features(stated(spark, sf_dir), O.recent_sales(fine_panel(spark, sf_dir))).select(*SUSPECTED)


@phase("oos-policies")
def oos_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.policy_eval(oos_features(spark, sf_dir))


@phase("oos-scores")
def oos_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_layers(O.final_scores(oos_features(spark, sf_dir), O.frozen_policy(oos_policies(spark, sf_dir))))


@phase("layer-policies")
def layer_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.layer_eval(oos_scores(spark, sf_dir))


@phase("layered")
def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.combined(oos_scores(spark, sf_dir), L.frozen_layer(layer_policies(spark, sf_dir)))


@phase("recall-policies")
def recall_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recall_eval(layered(spark, sf_dir))


def third(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.third_layer(layered(spark, sf_dir), L.frozen_layer(recall_policies(spark, sf_dir)), scores=False)


def third_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third layer of the policy of least loss, also where none is valid."""
    return L.third_layer(layered(spark, sf_dir), L.least_loss(recall_policies(spark, sf_dir)))


@phase("placed-sales")
def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_sales(spark, sf_dir)


@phase("geo", "sku_id")
def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = placed(spark, sf_dir)
    return G.weekly_geo(dealt(lines.select("date", "sku_id", (F.col("units") * F.col("copies")).alias("units"), "province"), "sku_id"))


@phase("sku-family")
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of each SKU that sold anything."""
    return G.sku_family(placed(spark, sf_dir).select("sku_id", "units", "part").join(part_families(spark, sf_dir), "part", "left"))


@phase("sku-metadata")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sku_metadata(fact_table(spark, sf_dir))


def national(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast(spark, sf_dir).where("split = 'VAL'")


@phase("province-shares")
def province_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dirichlet_shares(geo(spark, sf_dir), families(spark, sf_dir), national(spark, sf_dir))


def allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.allocated(province_shares(spark, sf_dir), national(spark, sf_dir))


def lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.policy_best(A.policy_sweep(forecast(spark, sf_dir)))


def _two(f, *sources: Query) -> Query:
    return lambda spark, sf_dir: rounded(f(*(s(spark, sf_dir) for s in sources)))


def _hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.blind(scores_parts(spark, sf_dir))


def scores_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return national(spark, sf_dir).withColumn("part", C.contract(F.col("week")))


def _verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.gate_verdict(forecast(spark, sf_dir), lift(spark, sf_dir))


def _recall_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.frozen_layer(recall_policies(spark, sf_dir))


def _spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.residual_spreads(stated(spark, sf_dir))


@phase("overlays")
def _overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stated(spark, sf_dir)
    return T.overlay_eval(rows, T.overlay_spreads(rows))


QUERIES: dict[str, Query] = {
    "season_profile": _by(states, lambda d: d.drop("state")),
    "season_state": _of(states, *KEYS, "season_group", "state"),
    "state_summary": _by(states, N.state_summary),
    "offseason_gate": _of(stated, *KEYS, "state", "part", "yhat", "gate_cap", "gated", "lowered"),
    "breakdown_metrics": _by(stated, N.breakdown),
    "state_calibration": _by(stated, N.state_calibration),
    "recent_sales": _by(fine_panel, O.recent_sales),
    "oos_features": _of(oos_features, *KEYS, "part", "run_bucket", *O.COMPONENTS, "gap", "true_zero"),
    "oos_policy_eval": _by(oos_policies),
    "oos_frozen": _by(oos_policies, O.frozen_policy),
    "oos_scores": _of(oos_scores, *KEYS, "part", "suspected", "expected_lost", "priority", "flag", "difficult"),
    "flag_metrics": _by(oos_scores, O.flag_metrics),
    "topk_curve": _by(oos_scores, O.top_k_curve),
    "weekly_topk": _by(oos_scores, O.weekly_top_k),
    "difficult_scores": _by(oos_scores, L.difficult_scores, lambda d: d.select(*KEYS, "season_group", *(f"pr_{c}" for c in L.RANKED[:5]), "score", "rank", "gate_A", "gate_B", "gate_C")),
    "layer_eval": _by(layer_policies),
    "layer_frozen": _by(layer_policies, L.frozen_layer),
    "combined_alerts": _of(layered, *KEYS, "season_group", "source", "alert"),
    "layer_metrics": _by(layered, L.layer_metrics),
    "uplift_verdict": _by(layered, L.layer_metrics, L.uplift_verdict),
    "recall_candidates": _by(layered, L.recall_scores, lambda d: d.select(*KEYS, "type", "segment", "score_F1", "score_F2", "score_F3", "gate_C", "gate_D", "gate_E")),
    "recall_eval": _by(recall_policies),
    "recall_verdict": _two(L.recall_verdict, _recall_frozen, recall_policies),
    "three_layer_alerts": _by(third, lambda d: d.select(*KEYS, "season_group", "source_3", "alert_3")),
    "three_layer_metrics": _by(third, L.third_metrics),
    "third_layer_what_if": _by(third_what_if, lambda d: d.select(*KEYS, "candidate", "third_score", "third", "source_3")),
    "third_layer_what_if_metrics": _by(third_what_if, L.third_metrics),
    "alert_lists": _by(third, L.alert_lists),
    "version_comparison": _by(third, L.version_comparison),
    "missed_events": _by(layered, L.missed_events),
    "layer_audit": _two(L.audit, layered, layer_policies, lambda s, d: L.frozen_layer(layer_policies(s, d))),
    "sku_metadata": _by(metadata),
    "weekly_geo": _by(geo),
    "dirichlet_base": _by(province_shares),
    "dirichlet_alloc": _by(allocated),
    "dirichlet_fixed": _two(G.fixed_shares, province_shares, national),
    "reconciliation": _two(G.reconciliation, allocated, national),
    "historic_shares": _by(geo, G.historic_shares),
    "national_export": _two(G.national_export, forecast, metadata),
    "blind_masking": _by(_hidden),
    "blind_check": _by(_hidden, G.blind_check),
    "whole_units": _by(allocated, lambda d: T.whole_units(d, KEYS, "province", "q90").select(*KEYS, "province", "whole")),
    "score_shift": _by(scores, D.score_shift),
    "distribution_shift": _by(scores, D.distribution_shift),
    "difficulty_score": _by(forecast, D.difficulty),
    "weekly_stability": _by(forecast, D.weekly_stability),
    "quantile_collapse": _by(forecast, D.quantile_collapse),
    "guardrails": _by(forecast, D.guardrails),
    "variance_inflation": _by(scores, D.variance_inflation),
    "leakage_checks": _by(scores, D.leakage_checks),
    "gate_verdict": _by(_verdict),
    "run_summary": _two(D.run_summary, forecast, _verdict),
    "split_weeks": _by(scores, D.split_weeks),
    "split_profile": _by(scores, D.split_profile),
    "diag_segments": _by(forecast, D.segment_diagnostics),
    "active_scope": _by(scores, D.active_scope),
    "demand_class": _by(panel, lambda d: T.demand_class(d, SPLITS.train_end)),
    "target_encoding": _by(scores, T.target_encoding),
    "walk_forward": _by(forecast, T.walk_forward),
    "point_eval": _by(stated, T.point_eval),
    "residual_spreads": _by(_spreads),
    "overlay_spreads": _by(stated, T.overlay_spreads),
    "overlay_eval": _by(_overlays),
    "overlay_forecast": lambda spark, sf_dir: rounded(T.overlay_forecast(stated(spark, sf_dir), T.overlay_spreads(stated(spark, sf_dir)), _overlays(spark, sf_dir))),
    "composite_loss": _by(forecast, T.composite_loss),
    "newsvendor": _by(forecast, T.newsvendor),
    "inventory": _by(panel, T.replenished, T.inventory_summary),
    "smoothed_demand": _by(panel, T.smoothed),
    "bootstrap_wmape": _by(forecast, T.bootstrap),
    "tree_scores": lambda spark, sf_dir: rounded(S.tree_scores(P.train_calib_split(labelled(spark, sf_dir)).join(market(spark, sf_dir), KEYS, "left"), features=(*S.FEATURES, *S.MARKET))),
}
