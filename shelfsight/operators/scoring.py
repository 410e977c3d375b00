"""Closed-form and boosted-tree scores, and the hub table of base scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ACTIVE_AMPLITUDE
from ..functions.columns import clip, fixed

FEATURES = ("lag_1", "lag_2", "lag_4", "lag_8", "lag_12", "lag_13", "lag_26", "lag_52", "mean_4", "mean_8", "mean_12", "mean_13", "std_4", "std_12", "std_13", "sale_freq_12w", "zero_share_13w", "zero_share_26w", "sin_1", "cos_1", "sin_2", "cos_2", "cv_4w", "cv_12w", "cv_13w", "amplitude", "lag1_rel", "oos_lag_1", "oos_lag_2", "oos_lag_4", "weeks_since_start")

#: Lags of value, price and customers, and the age of the span; they come from ``market_lags``.
MARKET = (
    "base_lag_1", "base_lag_4", "base_lag_12", "base_lag_13", "price_lag_1", "price_lag_4", "price_lag_12", "price_lag_13", "customers_lag_1", "customers_lag_4", "top_share_base_lag_1", "top_share_base_lag_4",
    "hhi_lag_1", "hhi_lag_4", "has_vip_lag_1", "has_vip_lag_4", "price_change_1w", "life",
)


def closed_form(rows: DataFrame) -> DataFrame:
    """A deterministic forecast and stock-out probability from the recent past."""
    p = 0.5 * F.col("zero_share_13w") + 0.5 * (1 - F.col("sale_freq_12w"))
    return rows.withColumns({"yhat": 12 * F.coalesce("mean_13", F.lit(0.0)), "p": clip(p, 0.0, 1.0)})


def base_scores(rows: DataFrame) -> DataFrame:
    """Rows with ``yhat`` and ``p`` get the scale of their residuals and the active flag."""
    scale = F.greatest(F.lit(1.0), F.coalesce("std_13", F.lit(0.0)) * F.sqrt(F.lit(12.0)), F.sqrt(F.coalesce("mean_13", F.lit(0.0)) * 12 + 1))
    return rows.withColumns({"scale": fixed(scale, 9), "active": F.col("amplitude") >= ACTIVE_AMPLITUDE})


def conformal_score() -> Column:
    return F.when(F.col("active"), fixed((F.col("y_12w") - F.col("yhat")) / F.col("scale"), 9))


def fit_trees(train: DataFrame, label: str, classify: bool, rounds: int, depth: int, features: tuple[str, ...] = FEATURES, step: float = 0.1):
    """A pipeline of median imputation, assembly and boosted trees, with class weights for a classifier."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = [f"{c}_in" for c in features]
    rows = train.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(label).cast("double").alias("label"))
    shared = {"featuresCol": "features", "labelCol": "label", "maxIter": rounds, "maxDepth": depth, "stepSize": step, "subsamplingRate": 0.8, "seed": 7}
    if classify:
        rate = rows.agg(F.avg("label")).first()[0] or 0.5
        rows = rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(rate, 1e-6)).otherwise(0.5 / max(1 - rate, 1e-6)))
        trees = GBTClassifier(weightCol="weight", **shared)
    else:
        trees = GBTRegressor(**shared)
    imputer = Imputer(inputCols=list(features), outputCols=names, strategy="median", relativeError=0.01)
    return Pipeline(stages=[imputer, VectorAssembler(inputCols=names, outputCol="features"), trees]).fit(rows)


def tree_scores(rows: DataFrame, split: str = "TRAIN", rounds: int = 50, depth: int = 6, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """``p`` from a classifier, Platt-scaled on CALIB with the better of both polarities, and ``yhat`` from a regressor that knows ``p``.

    A feature that is null throughout TRAIN is left out, as it has no median.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    wide = rows.select("sku_id", "week", "split", *(F.col(c).cast("double").alias(c) for c in features), "event_12w", "y_12w")
    train = wide.where(F.col("split") == split)
    seen = train.agg(*(F.count(c).alias(c) for c in features)).first()
    features = tuple(c for c in features if seen[c])
    classifier = fit_trees(train, "event_12w", True, rounds, depth, features)
    scored = classifier.transform(wide).withColumn("p_raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", *(f"{c}_in" for c in features))
    sign = scored.where("split = 'CALIB'").agg(F.corr("p_raw", "event_12w")).first()[0]
    scored = scored.withColumn("p_raw", 1 - F.col("p_raw")) if (sign or 0) < 0 else scored
    one = VectorAssembler(inputCols=["p_raw"], outputCol="v")
    platt = LogisticRegression(featuresCol="v", labelCol="event_12w", regParam=0.001, probabilityCol="pv").fit(one.transform(scored.where("split = 'CALIB'")))
    scored = platt.transform(one.transform(scored)).withColumn("p", vector_to_array("pv")[1]).drop("v", "pv", "rawPrediction", "prediction")
    demand = fit_trees(scored.where(F.col("split") == split), "y_12w", False, rounds, depth, (*features, "p"))
    scored = demand.transform(scored).withColumn("yhat", F.greatest(F.col("prediction"), F.lit(0.0)))
    return scored.select("sku_id", "week", "split", "event_12w", "y_12w", "p_raw", "p", "yhat")
