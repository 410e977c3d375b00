"""Power-variance regression: repeatable search, choices by class, better than the closed form."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shelfsight.operators import tweedie as W
from shelfsight.plans import planning, retail

DIR = "/root/testdata/sf0.001"


def test_candidates_repeat():
    assert W.draw(6) == W.draw(6) and W.draw(6)[:3] == W.draw(3) and W.draw(6, 1) != W.draw(6)
    assert all(1 < c.power < 2 for c in W.draw(50)) and len({c.name for c in W.draw(50)}) == 50


def test_deviance_is_least_at_the_mean(spark):
    rng = random.Random(1)
    ys = [rng.choice([0.0, 0.0, rng.random() * 100]) for _ in range(200)]
    mean = sum(ys) / len(ys)
    df = spark.createDataFrame([(y,) for y in ys], "y double")
    at = lambda m: df.agg(F.avg(W.deviance(F.col("y"), F.lit(m)))).first()[0]
    plain = lambda y, m: 2 * (y**0.5 / (-0.5 * 0.5) - y * m**-0.5 / -0.5 + m**0.5 / 0.5)
    assert math.isclose(at(mean), sum(plain(y, mean) for y in ys) / len(ys), rel_tol=1e-9)
    assert at(mean) < min(at(mean * 0.9), at(mean * 1.1)) and at(0.0) == at(W.FLOOR)


def test_choice_by_class(spark):
    rows = [("T01", "SMOOTH", 300, 2.0), ("T02", "SMOOTH", 300, 2.0), ("T03", "SMOOTH", 300, 3.0), ("T01", "LUMPY", 199, 1.0), ("T01", "ALL", 499, 2.0), ("T03", "ALL", 499, 1.5)]
    got = {r["class"]: r.candidate for r in W.chosen(spark.createDataFrame(rows, "candidate string, class string, n long, deviance double")).collect()}
    assert got == {"SMOOTH": "T01", "ALL": "T03"}


def test_better_than_the_closed_form(spark):
    scored = planning.tweedie(spark, DIR)
    assert scored.count() == retail.scores(spark, DIR).where("split = 'VAL'").count() and scored.where("mu is null or mu < 0").count() == 0
    total = {r["class"]: r for r in W.tweedie_eval(scored).collect()}["ALL"]
    assert total.deviance < total.deviance_closed


@pytest.mark.parametrize("n", [2])
def test_search_repeats(spark, n):
    rows = retail.scores(spark, DIR)
    classes = rows.select("sku_id").distinct().withColumn("class", F.lit("SMOOTH"))
    one, two = (sorted(map(tuple, W.search(W.prepared(rows, classes).where("split = 'TRAIN' and lag_52 is not null"), (1998,), W.draw(n)).collect())) for _ in range(2))
    assert one == two and len(one) == 2 * n
