"""Recent sales are joined to rows with states only in the weeks that such rows have."""

import datetime as dt

from shelfsight.operators import oos as O


def test_only_weeks_with_rows_are_joined(spark):
    weeks = [dt.date(2000, 1, 3) + dt.timedelta(7 * k) for k in range(20)]
    panel = spark.createDataFrame([(s, w, 1, float(i % 3)) for s in "ab" for i, w in enumerate(weeks)], "sku_id string, week date, iso_week int, y double")
    rows = spark.createDataFrame([(s, w, 4.0, "IN_SEASON", 0.5, 0.5) for s in "ab" for w in weeks[-2:]], "sku_id string, week date, gated double, state string, pos_same double, p double")
    out = O.oos_features(rows, O.recent_sales(panel))
    assert {(r["sku_id"], r["week"]) for r in out.collect()} == {(s, w) for s in "ab" for w in weeks[-2:]}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
