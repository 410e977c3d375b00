"""Exact quantiles of large groups against their definition."""

from pyspark.sql import functions as F

from shelfsight.operators.ranks import quantiles, with_quantiles


def at(values, percent):
    values = sorted(values)
    return float(values[max(-(-len(values) * round(percent * 1000) // 100_000), 1) - 1]) if values else None


def test_large_groups_are_exact(spark):
    n = 600_000
    own = [(i * 7919) % n for i in range(n)]
    rows = spark.range(0, n, 1, 13).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    picks = {f"x{k}": ("v", k) for k in (1, 7, 29, 50, 55, 57, 90, 99.5)}
    got = {r["g"]: r for r in quantiles(rows, ["g"], picks).collect()}
    for g in (0, 1):
        mine = own[g::2]
        assert got[g]["n"] == len(mine)
        assert {k: got[g][k] for k in picks} == {k: at(mine, p) for k, (_, p) in picks.items()}


def test_ranks_don_t_depend_on_binary_fractions(spark):
    # 0.55 x 100 is 55.00000000000001 in doubles
    assert quantiles(spark.range(1, 101).select(F.col("id").alias("v")), [], {"x": ("v", 55)}).first()["x"] == 55.0


def test_sets_nulls_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", "p", 1.0), ("a", "p", 1.0), ("a", "q", 5.0), (None, "q", None), ("b", "q", None)], "g string, h string, v double")
    got = {(r["_set"], r["g"], r["h"]): (r["n"], r["x"]) for r in quantiles(rows, ["g", "h"], {"x": ("v", 50)}, [["g", "h"], ["g"], []]).collect()}
    assert got == {
        (0, "a", "p"): (2, 1.0), (0, "a", "q"): (1, 5.0), (0, None, "q"): (1, None), (0, "b", "q"): (1, None),
        (1, "a", None): (3, 1.0), (1, None, None): (1, None), (1, "b", None): (1, None), (2, None, None): (5, 1.0),
    }
    assert [tuple(r) for r in quantiles(rows.limit(0), [], {"x": ("v", 50)}).collect()] == [(0, None)]
    assert quantiles(rows.limit(0), ["g"], {"x": ("v", 50)}).count() == 0
    both = with_quantiles(rows.groupBy("g").agg(F.count("*").alias("rows")), rows, ["g"], {"x": ("v", 90)})
    assert {r["g"]: (r["rows"], r["x"]) for r in both.collect()} == {"a": (3, 5.0), None: (1, None), "b": (1, None)}
