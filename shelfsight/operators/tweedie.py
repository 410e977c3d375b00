"""Power-variance (Tweedie) regression of demand: a seeded random search over year folds, a choice for each class of demand.

Demand is zero with positive probability and spread out above, which a variance of mean^p with 1 < p < 2 describes. Candidates
are drawn from a seed; each is fitted on the years before a fold's and judged on that year. A class of
demand takes the candidate of least deviance there, small classes the best of all. Deviance is
taken at one fixed power, so that candidates of different powers compare.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fixed, ratio

#: Non-negative features enter by log(1 + x), the others as they are; missing ones count as zero.
LOGS = ("lag_1", "lag_2", "lag_4", "lag_8", "lag_12", "lag_13", "lag_26", "lag_52", "mean_4", "mean_8", "mean_12", "mean_13", "std_4", "std_12", "std_13")
PLAIN = ("sale_freq_12w", "zero_share_13w", "zero_share_26w", "cv_12w", "sin_1", "cos_1", "sin_2", "cos_2", "oos_lag_1")
POWER = 1.5
#: Least forecast, so that the deviance of a positive demand is finite.
FLOOR = 0.1
LEAST_ROWS = 200


@dataclass(frozen=True)
class Candidate:
    """Variance power, regularisation and what the design holds: recent weeks, the year before, the season."""

    name: str
    power: float
    penalty: float
    recent: bool
    year: bool
    season: bool

    @property
    def features(self) -> list[str]:
        late = {"lag_26", "lag_52", "zero_share_26w"}
        season = {"sin_1", "cos_1", "sin_2", "cos_2"}
        recent = {"lag_1", "lag_2", "lag_4", "lag_8"}
        left = lambda c: (self.year or c not in late) and (self.season or c not in season) and (self.recent or c not in recent)
        return [c for c in (*LOGS, *PLAIN) if left(c)]


def draw(n: int, seed: int = 42) -> list[Candidate]:
    """``n`` candidates, the same for a seed; the first always has all features."""
    rng = random.Random(seed)
    out = [Candidate("T01", POWER, 0.01, True, True, True)]
    while len(out) < n:
        out.append(Candidate(f"T{len(out) + 1:02}", round(rng.uniform(1.1, 1.9), 2), 10 ** round(rng.uniform(-4, 0), 1), rng.random() < 0.7, rng.random() < 0.7, rng.random() < 0.7))
    return out


def deviance(y: Column, mu: Column, power: float = POWER) -> Column:
    """Deviance of one row; mu is floored."""
    m, a, b = F.greatest(mu, F.lit(FLOOR)), 1 - power, 2 - power
    return 2 * (F.pow(y, F.lit(b)) / (a * b) - y * F.pow(m, F.lit(a)) / a + F.pow(m, F.lit(b)) / b)


def prepared(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with the design's columns ``x_<feature>`` and the class of their SKU, NONE where unknown."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out = rows.join(classes.select("sku_id", F.col("class")), "sku_id", "left").withColumn("class", F.coalesce("class", F.lit("NONE")))
    return out.withColumns({f"x_{c}": F.log(zero(c) + 1) for c in LOGS} | {f"x_{c}": zero(c) for c in PLAIN})


def fit_candidate(train: DataFrame, c: Candidate):
    """A fitted pipeline; its prediction is the mean demand."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    glm = GeneralizedLinearRegression(family="tweedie", variancePower=c.power, linkPower=0.0, regParam=c.penalty, maxIter=25, featuresCol="_x", labelCol="y_12w", predictionCol=f"mu_{c.name}")
    return Pipeline(stages=[VectorAssembler(inputCols=[f"x_{f}" for f in c.features], outputCol="_x"), glm]).fit(train)


def with_means(rows: DataFrame, models: dict) -> DataFrame:
    """Rows with ``mu_<candidate>`` of every fitted model."""
    for name, model in models.items():
        rows = model.transform(rows).drop("_x").withColumn(f"mu_{name}", F.greatest(F.col(f"mu_{name}"), F.lit(FLOOR)))
    return rows


def search(rows: DataFrame, years: tuple[int, ...], candidates: list[Candidate]) -> DataFrame:
    """``candidate, class, n, deviance`` over all folds: each year is judged by models of the years before it.

    rows: ``prepared``, labelled. Label windows that reach into the fold's year are left out of its training. Also a row for ALL classes.
    """
    year = F.extract(F.lit("YEAROFWEEK"), F.col("week"))
    ends = F.extract(F.lit("YEAROFWEEK"), F.date_add("week", 84))
    judged = None
    for fold in years:
        models = {c.name: fit_candidate(rows.where(ends < fold), c) for c in candidates}
        scored = with_means(rows.where(year == fold), models)
        one = scored.select("class", "y_12w", F.explode(F.array(*(F.struct(F.lit(c.name).alias("candidate"), F.col(f"mu_{c.name}").alias("mu")) for c in candidates))).alias("s")).select("class", "y_12w", "s.*")
        judged = one if judged is None else judged.unionByName(one)
    out = judged.groupingSets([["candidate", "class"], ["candidate"]], "candidate", "class").agg(F.count("*").alias("n"), fixed(F.avg(deviance(F.col("y_12w"), F.col("mu"))), 6).alias("deviance"))
    return out.withColumn("class", F.coalesce("class", F.lit("ALL")))


def chosen(found: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """``class, candidate``: the least deviance of each class with ``least`` rows, ties by name, and of ALL for the others."""
    best = found.where((F.col("n") >= least) | (F.col("class") == "ALL")).groupBy("class").agg(F.min_by(F.struct("candidate", "n", "deviance"), F.struct("deviance", "candidate")).alias("b"))
    return best.select("class", "b.*")


def forecast(rows: DataFrame, choice: DataFrame, models: dict) -> DataFrame:
    """Rows with ``mu`` of their class's candidate, else of ALL's, and which one that was."""
    own = choice.where("class <> 'ALL'").select("class", F.col("candidate").alias("_own"))
    rest = choice.where("class = 'ALL'").select(F.col("candidate").alias("_all"))
    out = with_means(rows, models).join(F.broadcast(own), "class", "left").crossJoin(F.broadcast(rest)).withColumn("candidate", F.coalesce("_own", "_all"))
    pick = F.coalesce(*(F.when(F.col("candidate") == n, F.col(f"mu_{n}")) for n in models))
    return out.withColumn("mu", pick).drop("_own", "_all", *(f"mu_{n}" for n in models))


def tweedie_forecast(rows: DataFrame, classes: DataFrame, years: tuple[int, ...] = (1997, 1998), n: int = 6, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The search's table, and validation rows with the mean of the chosen candidates fitted on TRAIN.

    rows: features, ``split``, ``y_12w``, and what else the result shall hold.
    """
    from ..sources.stages import written

    design = written(prepared(rows.where("split in ('TRAIN', 'VAL')"), classes), "tweedie-design")
    train = design.where("split = 'TRAIN' and y_12w is not null and lag_52 is not null")
    candidates = draw(n, seed)
    found = written(search(train, years, candidates), "tweedie-search")
    choice = chosen(found)
    names = {r["candidate"] for r in choice.select("candidate").distinct().collect()}  # at most one a class
    models = {c.name: fit_candidate(train, c) for c in candidates if c.name in names}
    return found, forecast(design.where("split = 'VAL'"), choice, models)


def tweedie_eval(scored: DataFrame) -> DataFrame:
    """Deviance and error of the model and of the closed form on validation rows, by class and in all."""
    y = F.col("y_12w")
    miss = lambda f: ratio(F.sum(F.abs(y - F.col(f))), F.sum(y))
    out = scored.where("y_12w is not null").groupingSets([["class"], []], "class").agg(
        F.count("*").alias("n"), F.max("candidate").alias("_c"), F.avg(deviance(y, F.col("mu"))).alias("deviance"), F.avg(deviance(y, F.col("yhat"))).alias("deviance_closed"), miss("mu").alias("wmape"), miss("yhat").alias("wmape_closed"),
        ratio(F.sum("mu"), F.sum(y)).alias("ratio"),
    )
    return out.withColumns({"class": F.coalesce("class", F.lit("ALL")), "candidate": F.when(F.col("class").isNotNull(), F.col("_c"))}).drop("_c")
