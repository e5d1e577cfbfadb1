"""Join helpers: the smaller side is broadcast only after its rows and bytes were measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tablemill.functions.numbers import quoted
from tablemill.session import checkpointed

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 2**20


def small_side(df: DataFrame, ready: bool = False) -> DataFrame:
    """Broadcast hint if the table is small, else the join is left to adaptive execution, which splits
    skewed partitions.

    The table is checkpointed first so that measuring it does not compute it twice; ``ready`` says
    that it comes straight from a checkpoint or work table already.
    """
    table = df if ready else checkpointed(df)
    width = F.lit(0)
    for f in table.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            width = width + F.coalesce(F.size(c), F.lit(0)) * 16
        else:
            width = width + 16
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else table


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, how: str = "left") -> DataFrame:
    """Attach columns of a keyed table; the key column of the table is dropped."""
    right = small_side(table.withColumnRenamed(table_key, "_key"))
    return df.join(right, quoted(key) == F.col("_key"), how).drop("_key")
