"""The panel counts days and fills weeks without a join or a second copy of the lines."""

import datetime as dt

from shelfsight.config import SPLITS
from shelfsight.operators import panel as P


def test_dense_spine_equals_a_plain_version(spark):
    day = lambda s: dt.date.fromisoformat(s)
    first, end = day(SPLITS.start), day(SPLITS.end)
    lines = [
        (first - dt.timedelta(3), "early", 4.0), (end + dt.timedelta(9), "late", 4.0), (first, "a", 2.0), (first, "a", 3.0), (first + dt.timedelta(1), "a", 0.0), (first + dt.timedelta(2), "a", -5.0),
        (first + dt.timedelta(30), "a", None), (None, "a", 7.0), (end, "b", 1.0), (first + dt.timedelta(400), "b", -1.0), (first + dt.timedelta(5), None, 9.0),
    ]
    df = P.dense_spine(spark.createDataFrame(lines, "date date, sku_id string, units double"))
    weeks = [first + dt.timedelta(7 * k) for k in range((end - first).days // 7 + 1)]
    want = {}
    for s in ("early", "late", "a", "b"):
        for w in weeks:
            own = [(d, u) for d, t, u in lines if t == s and d and u is not None and u >= 0 and w <= d < w + dt.timedelta(7)]
            want[s, w] = (float(sum(u for _, u in own)), len({d for d, _ in own}), len({d for d, u in own if u > 0}))
    rows = df.collect()
    assert len(rows) == len(want) and {(r["sku_id"], r["week"]): (r["y"], r["days_active"], r["days_nonzero"]) for r in rows} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Expand" not in plan
