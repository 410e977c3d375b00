"""Figures are rounded once, as the SQL rounds them."""

from shelfsight.functions.columns import rounded
from shelfsight.operators.allocation import national_export


def test_alert_scores_are_rounded_once(spark):
    # to nine digits first this product would be 47.7020885, and then 47.702089
    rows = spark.createDataFrame([("1", "VAL", 0.5, 95.40417699999999, 1.0, 2.0, 120.0)], "sku_id string, split string, p double, q90 double, yhat double, q80 double, q95 double").selectExpr("*", "date'2000-03-13' AS week")
    metadata = spark.createDataFrame([("1", "LARGE")], "sku_id string, family string")
    assert 0.5 * 95.40417699999999 < 47.7020885
    assert rounded(national_export(rows, metadata)).first()["score"] == 47.702088
