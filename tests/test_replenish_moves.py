"""A replenishment plan is dealt by SKU once: later steps move no rows, and no simulated row is written."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfsight.config import Service
from shelfsight.operators import allocation as G
from shelfsight.operators import ranks
from shelfsight.operators import replenish as R
from shelfsight.plans import planning as P
from shelfsight.plans import states as S
from shelfsight.sources import stages
from shelfsight.sources.retail import fact

DIR = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strategies_move_no_rows_of_a_plan(spark):
    assert "Exchange" not in executed(R.with_strategies(P.plan(spark, DIR)).drop("weekly_priority"))
    assert "Exchange" not in executed(R.dynamic(P.units(spark, DIR), P.SIX))
    # one order of the rows serves all releases
    assert executed(R.with_releases(P.plan(spark, DIR))).count("Sort [") == 1


def test_shares_and_plan_are_dealt_by_sku_alone(spark):
    rows = P.expected(spark, DIR)
    assert set(rows.columns) == {"sku_id", "week", "yhat", "p", "scale"}
    shares = G.normalized(G.dirichlet_shares(S.geo(spark, DIR), S.families(spark, DIR), rows, sold=True))
    plan = executed(R.plan(shares, stages.dealt(rows, "sku_id"), P.skus(spark, DIR), P.places(spark, DIR)))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(sku_id" in line]
    assert all("hashpartitioning(sku_id#" in line and ", week#" not in line and "province" not in line.split("hashpartitioning")[1].split(")")[0] for line in moved), moved


def test_cells_stand_for_the_simulated_rows(spark):
    found, sim = P.replenishment(spark, DIR), R.dynamic(R.with_topup(P.units(spark, DIR)))
    assert "sku_id" not in found.columns
    scores = R.strategy_scores(sim)
    assert found.count() == sim.select("strategy", "abc", "class", "province", "week").distinct().count()
    key = lambda d: sorted(d.collect(), key=str)
    assert key(R.strategy_scores(found)) == key(scores)
    assert key(R.segment_scores(found, scores)) == key(R.segment_scores(sim, scores))


def test_nothing_is_ranked_where_no_unit_may_be_added(spark):
    rows = P.units(spark, DIR)
    before = len(stages._WRITTEN[spark.sparkContext.applicationId])
    got = R.with_topup(rows, Service(0.9999, 1.0, zeros_max=0))
    assert len(stages._WRITTEN[spark.sparkContext.applicationId]) == before
    assert got.where("hybrid_topup <> hybrid").count() == 0


@pytest.mark.parametrize("few", [1, 7, 1000])
def test_reached_is_the_running_sum(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "RANGES", 4)
    rng = random.Random(few)
    rows = [(rng.choice([0.0, 0.5, 0.5000001, rng.random() * 1e-6, rng.random() * 1e6]), f"s{k % 5}", k, rng.choice([0, 1, 1, 4])) for k in range(200)]
    df = spark.createDataFrame(rows, "score double, sku_id string, k int, amount int")
    order = {"score": True, "sku_id": False, "k": False}
    places = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    total = sum(r[3] for r in rows)
    assert ranks.reached(df, order, F.col("amount"), 0) is None and ranks.reached(df, order, F.col("amount"), total + 1) is None
    for at in (1, 2, total // 3, total // 2, total - 1, total):
        upto = 0
        for n, r in enumerate(places):
            upto += r[3]
            if upto >= at:
                break
        got = ranks.reached(df, order, F.col("amount"), at, 3)
        assert (got["score"], got["sku_id"], got["k"], got["_upto"]) == (*r[:3], upto)
        assert df.where(ranks.is_before(got, order)).count() == n and df.where(ranks.is_same(got, order)).count() == 1


def test_reached_takes_rows_without_a_number_last(spark):
    df = spark.createDataFrame([(None, 1), (2.0, 2), (1.0, 3)], "score double, k int")
    assert [ranks.reached(df, {"score": True, "k": False}, F.lit(1), n)["k"] for n in (1, 2, 3)] == [2, 3, 1]


def test_geography_counts_a_line_for_each_row_of_its_part(spark, tmp_path):
    for name in ("lineitem", "orders", "customer", "nation"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{DIR}/{name}.parquet")
    part = spark.read.parquet(f"{DIR}/part.parquet")
    part.union(part.where("p_partkey % 3 = 0").withColumn("p_type", F.lit("A TYPE"))).write.parquet(str(tmp_path / "part.parquet"))
    lines = fact(spark, str(tmp_path))
    key = lambda d: sorted(d.collect())
    assert key(S.geo(spark, str(tmp_path)).select("sku_id", "province", "week", "units")) == key(G.weekly_geo(lines).select("sku_id", "province", "week", "units"))
    assert key(S.families(spark, str(tmp_path)).select("sku_id", "family")) == key(G.sku_family(lines.where("units > 0")).select("sku_id", "family"))


def test_tables_in_buckets_go_with_the_others(spark):
    rows = spark.range(20).select(F.col("id").cast("string").alias("sku_id"), F.lit(dt.date(2000, 1, 3)).alias("week"))
    table = stages.written_buckets(stages.dealt(rows, "sku_id"), "trial", "sku_id")
    assert sorted(table.collect()) == sorted(rows.collect())
    assert "Exchange" not in executed(table.groupBy("sku_id", "week").count())
    name = stages._TABLES[spark.sparkContext.applicationId][-1]
    assert spark.catalog.tableExists(name)
    stages.drop_written(spark)
    assert not spark.catalog.tableExists(name)
