"""Registered queries of quantile regression, replenishment, calibration by state, deployment and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SPLITS
from ..functions.columns import rounded
from ..operators import boosting as B
from ..operators import candidates as J
from ..operators import allocation as G
from ..operators import audits as U
from ..operators import conformal as C
from ..operators import diagnostics as D
from ..operators import layers as L
from ..operators import panel as P
from ..operators import policy as A
from ..operators import quantreg as Q
from ..operators import replenish as R
from ..operators import scoring as S
from ..operators import statefreeze as Z
from ..operators import strict as X
from ..operators import studies as T
from ..operators import tweedie as W
from ..operators import verdicts as V
from ..sources.stages import Query, dealt, phase
from .retail import _by, _of, forecast, labelled, panel, recalibrated, scores
from .states import _overlays, families, fine_residuals, fine_scores, geo, layered, national, oos_scores, province_shares, recall_policies, scores_parts, stated, states, third

KEYS = ["sku_id", "week"]
SIX = R.STRATEGIES[:-1]
#: What a plan's rows are written with; all else follows from a row.
PLANNED = ("sku_id", "province", "week", "abc", "demand", "tier", "pred", "stock", "prob", "real")


@phase("qr-features")
def qr_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.qr_features(stated(spark, sf_dir))


@phase("qr-model")
def qr_model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.model_table(spark, Q.fit_quantiles(qr_features(spark, sf_dir)))


def qr_model(spark: SparkSession, sf_dir: str) -> B.Ensemble:
    return B.from_text(qr_model_table(spark, sf_dir).first()["model"], [*Q.NUMBERS, *Q.CLASSES])


@phase("qr-scores")
def qr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.qr_scores(qr_features(spark, sf_dir), qr_model(spark, sf_dir))


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.qr_frozen(Q.qr_eval(qr_scores(spark, sf_dir)))


def qr_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.qr_locked(qr_scores(spark, sf_dir), _frozen(spark, sf_dir))


def qr_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qr_scores(spark, sf_dir)
    return Q.qr_audit(
        C.temporal_contract(scores(spark, sf_dir)), qr_features(spark, sf_dir), Q.qr_models(qr_model(spark, sf_dir), spark), Q.qr_eval(found), _frozen(spark, sf_dir), found, qr_locked(spark, sf_dir),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tiers(geo(spark, sf_dir), SPLITS.train_end)


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.allocated(province_shares(spark, sf_dir), national(spark, sf_dir))


@phase("replenishment-national")
def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast, probability and scale of the validation rows: all that a plan reads of them, so no quantile is calibrated for it."""
    rows = S.base_scores(S.closed_form(P.split_rows(P.forward_labels(P.features(panel(spark, sf_dir))))))
    return rows.where("split = 'VAL'").select(*KEYS, "yhat", "p", "scale")


@phase("replenishment-skus")
def skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = panel(spark, sf_dir)
    return R.abc_classes(own, SPLITS.train_end).join(T.demand_class(own, SPLITS.train_end).select("sku_id", F.col("class").alias("demand")), "sku_id", "full")


@phase("replenishment-plan", "sku_id")
def plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expected(spark, sf_dir)
    shares = G.normalized(G.dirichlet_shares(geo(spark, sf_dir), families(spark, sf_dir), rows, sold=True))
    return R.plan(shares, dealt(rows, "sku_id"), skus(spark, sf_dir), places(spark, sf_dir))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_scores(plan_rows(spark, sf_dir))


@phase("replenishment-units", "sku_id")
def units_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_strategies(plan(spark, sf_dir)).select(*PLANNED, *SIX)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_scores(units_rows(spark, sf_dir))


@phase("replenishment-six")
def six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the simulated rows of six strategies; the rows themselves are never written."""
    return R.cells(units(spark, sf_dir), SIX)


@phase("replenishment")
def replenishment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of all seven strategies. The top-up is what it starts from where no unit is added, so nothing is simulated again."""
    known, rows = six(spark, sf_dir), units(spark, sf_dir)
    fills = {r["strategy"]: r["fill"] for r in R.strategy_scores(known).collect()}
    base, more = R.topped_up(rows, fills=fills)
    if more is None:
        top = known.where(F.col("strategy") == base).withColumn("strategy", F.lit("hybrid_topup"))
    else:
        top = R.cells(rows.withColumn("hybrid_topup", (F.col(base) + more).cast("long")), ("hybrid_topup",))
    return known.unionByName(top)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = replenishment(spark, sf_dir)
    return R.segment_scores(sim, R.strategy_scores(sim))


def _acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = replenishment(spark, sf_dir)
    return R.acceptance(sim, R.strategy_scores(sim), _segments(spark, sf_dir), places(spark, sf_dir))


@phase("state-rows")
def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.with_violations(stated(spark, sf_dir), Z.segment_scores(fine_residuals(spark, sf_dir)))


@phase("state-grid")
def state_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.state_grid_eval(state_rows(spark, sf_dir))


@phase("state-recalibrated")
def state_recalibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.state_recalibrated(state_rows(spark, sf_dir), Z.state_frozen(state_grid(spark, sf_dir)))


@phase("probabilities")
def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast with its calibrated probability."""
    return X.banded(forecast(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = probabilities(spark, sf_dir)
    return own.withColumn("part", F.when(F.col("split") == "VAL", C.contract(F.col("week"))))


@phase("deployment-gates")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = C.with_tune(scores(spark, sf_dir)).where("split = 'VAL'").select("week", "tune").distinct()
    fc, own = forecast(spark, sf_dir), probabilities(spark, sf_dir).where("split = 'VAL'")
    found = A.alerts(fc, A.policy_best(A.policy_sweep(fc)))
    late = lambda d: V.gate_part(d, weeks)
    return V.deployment_gates(V.gate_metrics(late(recalibrated(spark, sf_dir))), late(own), late(found), late(own), V.scope_check(scores(spark, sf_dir)), D.leakage_checks(scores(spark, sf_dir)))


def _choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.probability_choice(_parts(spark, sf_dir).drop("band", "p_cal"))


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ranking_comparison(_parts(spark, sf_dir).where("part = 'DEV_SELECT'"))


@phase("final-forecast")
def final_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.final_forecast(probabilities(spark, sf_dir), _choice(spark, sf_dir), _ranking(spark, sf_dir))


@phase("final-verdict")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = _shares(spark, sf_dir)
    return V.final_verdict(
        gates(spark, sf_dir), _choice(spark, sf_dir), G.reconciliation(shares, national(spark, sf_dir)), shares, G.blind_check(G.blind(scores_parts(spark, sf_dir))), D.guardrails(forecast(spark, sf_dir)),
    )


def _part_of(rows: DataFrame, part: str) -> DataFrame:
    return rows.where(F.col("part") == part).select("part")


def season_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, rows = recalibrated(spark, sf_dir), state_recalibrated(spark, sf_dir)
    select = _part_of(own, "DEV_SELECT")
    tables = U.season_tables(
        fine_scores(spark, sf_dir), states(spark, sf_dir), stated(spark, sf_dir), Z.state_frozen(state_grid(spark, sf_dir)), U.lineage(_choice(spark, sf_dir), select),
        U.lineage(X.family_frozen(X.family_sweep(own)), select), rows, Z.state_recalibrated_metrics(rows), C.contract(F.col("week")),
    )
    return U.run_checks(tables, U.season_checks())


def recall_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, rows = layered(spark, sf_dir), phase("third-layer")(third)(spark, sf_dir)
    select, evaluated = _part_of(base, "DEV_SELECT"), recall_policies(spark, sf_dir)
    frozen = L.frozen_layer(evaluated)
    tables = U.recall_tables(
        oos_scores(spark, sf_dir), L.recall_scores(base), rows, U.lineage(evaluated, select), U.lineage(frozen, select), U.lineage(L.third_metrics(rows), _part_of(rows, "LOCKED_TEST")), U.lineage(L.recall_verdict(frozen, evaluated), select),
    )
    return U.run_checks(tables, U.recall_checks())


@phase("overlay-forecast")
def overlay_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stated(spark, sf_dir)
    return T.overlay_forecast(rows, T.overlay_spreads(rows), _overlays(spark, sf_dir))


def overlay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.overlay_metrics(overlay_forecast(spark, sf_dir), stated(spark, sf_dir))


def overlay_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, evaluated = stated(spark, sf_dir), _overlays(spark, sf_dir)
    select = _part_of(rows, "DEV_SELECT")
    frozen = evaluated.orderBy("loss", "candidate").limit(1).select("candidate", "loss")
    tables = U.overlay_tables(
        rows, fine_scores(spark, sf_dir), U.lineage(T.overlay_spreads(rows), _part_of(rows, "DEV_TUNE")), U.lineage(evaluated, select), U.lineage(frozen, select), overlay_forecast(spark, sf_dir), overlay_metrics(spark, sf_dir),
    )
    return U.run_checks(tables, U.overlay_checks())


@phase("tweedie")
def tweedie(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = T.demand_class(panel(spark, sf_dir), SPLITS.train_end)
    keep = ["sku_id", "week", "split", "season_group", "y_12w", "yhat", "class", "candidate", "mu"]
    return W.tweedie_forecast(scores(spark, sf_dir), classes)[1].select(*keep)


@phase("point-rows")
def point_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stated(spark, sf_dir)
    return J.with_points(rows, J.shrink_grid(rows))


@phase("joint-rows")
def joint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = point_rows(spark, sf_dir)
    return J.with_methods(rows.where("part in ('DEV_SELECT', 'LOCKED_TEST')"), J.spreads(rows))


def _joint_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joint_rows(spark, sf_dir)
    return J.joint_locked(rows, J.joint_frozen(J.joint_eval(rows)))


QUERIES: dict[str, Query] = {
    "qr_features": _by(qr_features),
    "qr_scores": _by(qr_scores),
    "qr_eval": _by(qr_scores, Q.qr_eval),
    "qr_frozen": lambda spark, sf_dir: rounded(_frozen(spark, sf_dir)),
    "qr_locked_metrics": lambda spark, sf_dir: rounded(qr_locked(spark, sf_dir)),
    "qr_criteria": lambda spark, sf_dir: rounded(Q.qr_criteria(qr_locked(spark, sf_dir))),
    "qr_audit": qr_audit,
    "qr_models": lambda spark, sf_dir: Q.qr_models(qr_model(spark, sf_dir), spark),
    "replenishment_plan": _of(plan, "sku_id", "province", "week", "month", "block3", "abc", "demand", "tier", "pred", "stock", "prob", "real", "score", "release"),
    "replenishment_units": _of(units, "sku_id", "province", "week", *SIX),
    "replenishment_fill": _by(six, R.strategy_scores),
    "replenishment_scores": _by(replenishment, R.strategy_scores),
    "replenishment_segments": lambda spark, sf_dir: rounded(_segments(spark, sf_dir)),
    "replenishment_acceptance": lambda spark, sf_dir: rounded(_acceptance(spark, sf_dir)),
    "state_grid_eval": _by(state_grid),
    "state_frozen": _by(state_grid, Z.state_frozen),
    "state_recalibrated": _by(state_recalibrated),
    "state_recalibrated_metrics": _by(state_recalibrated, Z.state_recalibrated_metrics),
    "scope_check": lambda spark, sf_dir: V.scope_check(scores(spark, sf_dir)),
    "deployment_gates": _by(gates),
    "ranking_comparison": lambda spark, sf_dir: rounded(_ranking(spark, sf_dir)),
    "final_forecast": _by(final_forecast),
    "examples": _by(forecast, V.examples),
    "final_verdict": verdict,
    "blind_national": lambda spark, sf_dir: rounded(V.blind_national(final_forecast(spark, sf_dir), verdict(spark, sf_dir))),
    "blind_provincial": lambda spark, sf_dir: rounded(V.blind_provincial(_shares(spark, sf_dir), verdict(spark, sf_dir))),
    "blind_alerts": lambda spark, sf_dir: rounded(V.blind_alerts(final_forecast(spark, sf_dir), verdict(spark, sf_dir))),
    "season_audit": season_audit,
    "recall_audit": recall_audit,
    "overlay_metrics": lambda spark, sf_dir: rounded(overlay_metrics(spark, sf_dir)),
    "overlay_audit": overlay_audit,
    "audit_verdicts": lambda spark, sf_dir: U.audit_verdict(season_audit(spark, sf_dir).unionByName(recall_audit(spark, sf_dir)).unionByName(overlay_audit(spark, sf_dir))),
    "tweedie_forecast": _by(tweedie),
    "tweedie_eval": _by(tweedie, W.tweedie_eval),
    "shrink_grid": _by(stated, J.shrink_grid),
    "joint_spreads": _by(point_rows, J.spreads),
    "joint_eval": _by(joint_rows, J.joint_eval),
    "joint_frozen": _by(joint_rows, J.joint_eval, J.joint_frozen),
    "joint_locked_metrics": lambda spark, sf_dir: rounded(_joint_locked(spark, sf_dir)),
    "closed_labels": _by(labelled, P.closed_labels),
    "fit_quality": _by(forecast, D.fit_quality),
    "replenishment_comparison": lambda spark, sf_dir: rounded(R.stock_comparison(plan(spark, sf_dir), R.strategy_scores(replenishment(spark, sf_dir)))),
}

