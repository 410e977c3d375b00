"""Sales lines from the order tables, and readers and writers of flat files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stages import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sales line: date, sku, customer, units (returns below zero), base amount, place, family."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    orders = t("orders").select("o_orderkey", "o_custkey")
    customers = t("customer").select("c_custkey", "c_nationkey")
    places = t("nation").select("n_nationkey", F.col("n_name").alias("province"), F.col("n_regionkey").alias("nation"))
    parts = t("part").select("p_partkey", F.col("p_type").alias("family"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    base = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.floor(F.col("l_suppkey") / 3).cast("string").alias("sku_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("units"),
        base.alias("base_amount"),
        F.try_divide(base, F.col("l_quantity")).alias("unit_price"),
        "province", "nation", "family",
    )


def placed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that sold something with their place and part: what geography and families read of a line, without its prices.

    Orders find their province first, so lines are shuffled once, by their order. ``copies``: rows that the line's part has,
    which is one, but for tables that repeat a key; Spark sees how few others there are.
    """
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").select("n_nationkey", F.col("n_name").alias("province"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t("lineitem").where("l_quantity > 0 and l_suppkey is not null and (l_returnflag is null or l_returnflag <> 'R')").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.col("l_shipdate").cast("date").alias("date"))
    rows = lines.join(orders.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    copies = written(t("part").groupBy("p_partkey").agg(F.count("*").alias("copies")).where("copies > 1 and p_partkey is not null"), "part-copies")
    rows = rows.join(copies, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.select("date", F.floor(F.col("l_suppkey") / 3).cast("string").alias("sku_id"), F.col("l_quantity").alias("units"), "province", F.col("l_partkey").alias("part"), F.coalesce("copies", F.lit(1)).alias("copies"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("family"))


def sales_only(spark: SparkSession, sf_dir: str, per: int = 3) -> DataFrame:
    """Date, sku and units without the customer joins, for the panel; a SKU is ``per`` suppliers."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    units = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return lines.select(F.col("l_shipdate").cast("date").alias("date"), F.floor(F.col("l_suppkey") / per).cast("string").alias("sku_id"), units.alias("units"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Header, empty strings as null, quoted line feeds; types inferred where no schema is given."""
    reader = spark.read.option("header", True).option("nullValue", "").option("multiLine", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """Part files with headers; an empty table still gets one."""
    (df if limit is None else df.limit(limit)).write.mode("overwrite").option("header", True).csv(path)


def export_if(df: DataFrame, verdict: DataFrame, column: str = "verdict", value: str = "DEPLOY") -> DataFrame:
    """All rows if the one-row verdict has the value, else none."""
    return df.join(F.broadcast(verdict.select(F.col(column).alias("_verdict")).limit(1)), F.col("_verdict") == value, "left_semi")
