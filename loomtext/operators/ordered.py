"""Running values over an ordered key that may hold any share of the rows.

The order column is cut into blocks. Only one row per block crosses to the next level, so no window
partition is larger than a block or than the number of blocks of a key. The order column must be an integer;
rows that share a place are ordered by ``then``. Keys must not be null where a last known value is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 4096


def _block(order: str, block: int) -> Column:
    return F.floor(F.col(order) / F.lit(block))


def _levels(keys: Sequence[str], order: str, then: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    inside = Window.partitionBy(*keys, "_block").orderBy("_mark", order, *then)
    return inside, Window.partitionBy(*keys).orderBy("_block")


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, to: str, then: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``df`` with ``to``: the sum of ``value`` over the key's rows up to and with this one. A null value counts as 0."""
    inside, across = _levels(keys, order, then)
    rows = df.withColumn("_v", F.coalesce(value, F.lit(0)).cast("bigint")).withColumn("_block", _block(order, block)).withColumn("_mark", F.lit(1))
    carried = (
        rows.groupBy(*keys, "_block")
        .agg(F.sum("_v").alias("_v"))
        .withColumn("_v", F.sum("_v").over(across.rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.coalesce("_v", F.lit(0)) != 0)
        .withColumn("_mark", F.lit(0))
    )
    return (
        rows.unionByName(carried, allowMissingColumns=True)
        .withColumn(to, F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .where("_mark = 1")
        .drop("_v", "_block", "_mark")
    )


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: Column, to: str, then: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``df`` with ``to``: the largest ``value`` of the key's rows strictly before this one; null if there is none."""
    inside, across = _levels(keys, order, then)
    rows = df.withColumn("_v", value).withColumn("_block", _block(order, block)).withColumn("_mark", F.lit(1))
    carried = (
        rows.groupBy(*keys, "_block")
        .agg(F.max("_v").alias("_v"))
        .withColumn("_v", F.max("_v").over(across.rowsBetween(Window.unboundedPreceding, -1)))
        .where("_v IS NOT NULL")
        .withColumn("_mark", F.lit(0))
    )
    return (
        rows.unionByName(carried, allowMissingColumns=True)
        .withColumn(to, F.max("_v").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
        .where("_mark = 1")
        .drop("_v", "_block", "_mark")
    )


def last_known(df: DataFrame, keys: Sequence[str], order: str, value: Column, to: str, then: Sequence[str] = (), block: int = BLOCK, before: bool = True) -> DataFrame:
    """``df`` with ``to``: the last non-null ``value`` of the key's rows strictly before this one, or with ``before=False`` up to and with it."""
    inside, across = _levels(keys, order, then)
    rows = df.withColumn("_v", value).withColumn("_block", _block(order, block)).withColumn("_mark", F.lit(1))
    carried = (
        rows.where("_v IS NOT NULL")
        .groupBy(*keys, "_block")
        .agg(F.max_by("_v", F.struct(order, *then)).alias("_v"))
    )
    # Blocks without a value still need what came before them.
    seen = (
        rows.select(*keys, "_block").distinct().join(carried, [*keys, "_block"], "left")
        .withColumn("_v", F.last("_v", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)))
        .where("_v IS NOT NULL")
        .withColumn("_mark", F.lit(0))
    )
    return (
        rows.unionByName(seen, allowMissingColumns=True)
        .withColumn(to, F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)))
        .where("_mark = 1")
        .drop("_v", "_block", "_mark")
    )


def neighbour(df: DataFrame, keys: Sequence[str], order: str, value: Column, to: str, step: int = 1, then: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``df`` with ``to``: ``value`` of the key's next row (``step`` 1) or of the row before (``step`` -1); null at the end."""
    inside, across = _levels(keys, order, then)
    wrapped = F.struct(value.alias("v"))
    rows = df.withColumn("_v", wrapped).withColumn("_block", _block(order, block)).withColumn("_mark", F.lit(1))
    pick = F.min_by if step > 0 else F.max_by
    edge = rows.groupBy(*keys, "_block").agg(pick("_v", F.struct(order, *then)).alias("_v"))
    shift = F.lead if step > 0 else F.lag
    edge = edge.withColumn("_v", shift("_v").over(across)).where("_v IS NOT NULL").withColumn("_mark", F.lit(2 if step > 0 else 0))
    return (
        rows.unionByName(edge, allowMissingColumns=True)
        .withColumn("_n", shift("_v").over(inside))
        .where("_mark = 1")
        .withColumn(to, F.col("_n.v"))
        .drop("_v", "_n", "_block", "_mark")
    )
