"""Named queries over the given tables, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PRODUCTS_SQL = """
products AS (
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
       lpad(CAST(l_partkey*1000003 + l_orderkey*7919 + l_suppkey AS VARCHAR(20)), 13, '0') AS code,
       p_name AS product_name, p_type AS categories, p_brand AS brands,
       CASE WHEN l_orderkey % 10 = 0 THEN NULL
            ELSE concat(CAST(p_size AS VARCHAR(20)), ' ',
                 CASE l_orderkey % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'oz' WHEN 2 THEN 'lb'
                                     WHEN 3 THEN 'tbsp' ELSE 'ml' END) END AS serving_size,
       l_extendedprice / 30 AS energy_100g,
       CASE WHEN l_orderkey % 997 = 0 THEN -l_quantity ELSE l_quantity END AS proteins_100g,
       CASE WHEN l_orderkey % 13 = 0 THEN NULL
            ELSE CAST(p_size AS DOUBLE) * CAST(1.2 AS DOUBLE) END AS carbohydrates_100g,
       l_discount * 300 AS fat_100g,
       l_tax * 800 AS fiber_100g,
       CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS salt_100g,
       CAST(p_size AS DOUBLE) * CAST(0.6 AS DOUBLE) AS sugars_100g
FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
WITH_PRODUCTS = "WITH " + PRODUCTS_SQL

TEXT = ["row_id", "code", "product_name", "categories", "brands", "serving_size"]
NUMBERS = ["energy_100g", "proteins_100g", "carbohydrates_100g", "fat_100g", "fiber_100g", "salt_100g",
           "sugars_100g"]
COLUMNS = TEXT + NUMBERS


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its optional SQL counterpart."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def per_column(template: str, columns: list[str]) -> str:
    """UNION ALL of a SELECT per column; ``{c}`` is the column name."""
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in columns)
