"""Table access and the ``products`` view built from line items and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def products(spark: SparkSession, folder: str) -> DataFrame:
    """A nutrition-like table with gaps, outliers, bad codes and free-text serving sizes.

    The join side is left to the optimizer: small parts are broadcast by their file size, large ones
    are shuffled with skew handling.
    """
    lines = read_table(spark, folder, "lineitem")
    parts = read_table(spark, folder, "part")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    order, size = F.col("l_orderkey"), F.col("p_size")
    code = F.col("l_partkey") * 1000003 + order * 7919 + F.col("l_suppkey")
    unit = (F.when(order % 5 == 0, "g").when(order % 5 == 1, "oz").when(order % 5 == 2, "lb")
            .when(order % 5 == 3, "tbsp").otherwise("ml"))
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.lpad(code.cast("string"), 13, "0").alias("code"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("categories"),
        F.col("p_brand").alias("brands"),
        F.when(order % 10 != 0, F.concat(size.cast("string"), F.lit(" "), unit)).alias("serving_size"),
        (F.col("l_extendedprice") / 30).alias("energy_100g"),
        F.when(order % 997 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("proteins_100g"),
        F.when(order % 13 != 0, size.cast("double") * F.lit(1.2)).alias("carbohydrates_100g"),
        (F.col("l_discount") * 300).alias("fat_100g"),
        (F.col("l_tax") * 800).alias("fiber_100g"),
        F.when(order % 2 != 0, F.col("l_linenumber").cast("double")).alias("salt_100g"),
        (size.cast("double") * F.lit(0.6)).alias("sugars_100g"),
    )
