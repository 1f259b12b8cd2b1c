"""Continuous periods and gaps of intervals that overlap, nest or leave holes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions per block of the two-level sweep. It bounds the rows that one window partition holds.
BLOCK = 4096


def periods_and_gaps(spans: DataFrame, keys: Sequence[str], start: str, end: str, block: int = BLOCK) -> DataFrame:
    """Sweep line over half-open intervals ``[start, end)`` of each ``keys`` group.

    Boundaries become events of +1 and -1, events at one position are added up before the shuffle,
    and prefix sums give the number of open intervals. A key may hold any share of the rows: the
    sums run per block of ``block`` positions and only one row per block crosses to the next
    level, so no window partition is larger than a block or than the number of blocks of a key.

    Result: ``keys``, ``what`` (``period`` or ``gap``), ``p_start``, ``p_end``, both of the type of
    ``start``. Intervals that touch are continuous. An interval that is empty, reversed or has a null
    end covers nothing; a group without any other has no rows. Null keys form a group of their own.
    Repeated rows change nothing, and an empty table gives an empty result. Further columns of
    ``spans`` are not read.
    """
    kind = spans.schema[start].dataType
    names = [f"_k{i}" for i in range(len(keys))]
    bounds = spans.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)],
        F.col(start).cast("bigint").alias("_s"),
        F.col(end).cast("bigint").alias("_e"),
    ).where(F.col("_s") < F.col("_e"))
    events = (
        bounds.select(
            *names,
            F.explode(
                F.array(
                    F.struct(F.col("_s").alias("pos"), F.lit(1).cast("bigint").alias("step")),
                    F.struct(F.col("_e").alias("pos"), F.lit(-1).cast("bigint").alias("step")),
                )
            ).alias("_b"),
        )
        .select(*names, "_b.pos", "_b.step")
        .groupBy(*names, "pos")
        .agg(F.sum("step").alias("step"))
        .where(F.col("step") != 0)
        .withColumn("block", F.floor(F.col("pos") / F.lit(block)))
    )
    by_block = Window.partitionBy(*names).orderBy("block")
    carried = (
        events.groupBy(*names, "block")
        .agg(F.sum("step").alias("step"))
        .withColumn("step", F.sum("step").over(by_block.rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.coalesce(F.col("step"), F.lit(0)) != 0)
        .select(*names, F.lit(None).cast("bigint").alias("pos"), "step", "block")
    )
    inside = Window.partitionBy(*names, "block").orderBy(F.col("pos").asc_nulls_first())
    edges = (
        events.unionByName(carried)
        .withColumn("after", F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("after") - F.col("step"))
        .where(F.col("pos").isNotNull() & ((F.col("before") == 0) != (F.col("after") == 0)))
        .select(*names, "block", "pos", (F.col("before") == 0).alias("opens"))
    )
    following = (
        edges.groupBy(*names, "block")
        .agg(F.min("pos").alias("pos"))
        .withColumn("pos", F.lead("pos").over(by_block))
        .where(F.col("pos").isNotNull())
        .select(*names, "block", "pos", F.lit(None).cast("boolean").alias("opens"))
    )
    return (
        edges.unionByName(following)
        .withColumn("next", F.lead("pos").over(Window.partitionBy(*names, "block").orderBy("pos")))
        .where(F.col("opens").isNotNull() & F.col("next").isNotNull())
        .select(
            *[F.col(n).alias(k) for k, n in zip(keys, names)],
            F.when(F.col("opens"), "period").otherwise("gap").alias("what"),
            F.col("pos").cast(kind).alias("p_start"),
            F.col("next").cast(kind).alias("p_end"),
        )
    )
