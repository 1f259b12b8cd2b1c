"""Passages and samples that come out the same every time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_passages(spots: DataFrame, keys: Sequence[str], place: str, quotations: int, most: int) -> DataFrame:
    """Stretches ``[from_place, to_place)`` that begin at a spot and hold ``quotations`` spots within ``most`` paragraphs.

    Spots count with repetition; ``keys`` should be small groups, such as the chapters of a book.
    """
    ordered = Window.partitionBy(*keys).orderBy(place)
    ends = spots.select(*keys, place, F.lead(place, quotations - 1).over(ordered).alias("last"), F.row_number().over(Window.partitionBy(*keys, place).orderBy(F.lit(1))).alias("_k"))
    fits = ends.where((F.col("_k") == 1) & (F.col("last") - F.col(place) + 1 <= most))
    return fits.select(*keys, F.col(place).alias("from_place"), (F.col("last") + 1).alias("to_place"))


def apart(passages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of passages that overlap the one that begins first; the next one kept begins where or after it ends, and so on along each group of ``keys``."""
    rows = F.array_sort(F.collect_list(F.struct("from_place", "to_place")))
    none = F.array().cast(passages.select(rows.alias("r")).schema["r"].dataType)

    def keep(kept: Column, p: Column) -> Column:
        return F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["to_place"] <= p["from_place"]), F.concat(kept, F.array(p))).otherwise(kept)

    grouped = passages.groupBy(*keys).agg(rows.alias("r"))
    return grouped.select(*keys, F.inline(F.aggregate(F.when(F.size("r") > 0, F.col("r")).otherwise(none), none, lambda k, p: F.when(F.size(k) == 0, F.array(p)).otherwise(keep(k, p)))))


def stratified(rows: DataFrame, keys: Sequence[str], place: str, strata: int, id_column: str, seed: int = 0) -> DataFrame:
    """One row from each of ``strata`` equal stretches of each group's places, chosen by a hash of its id."""
    bounds = rows.groupBy(*keys).agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    span = F.col("_hi") - F.col("_lo") + 1
    layered = rows.join(bounds, list(keys)).withColumn("stratum", F.floor((F.col(place) - F.col("_lo")) * strata / span).cast("int"))
    chosen = F.min_by(F.struct(place, id_column), F.struct(F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed)))), id_column)).alias("c")
    return layered.groupBy(*keys, "stratum").agg(chosen).select(*keys, "stratum", F.col(f"c.{place}").alias(place), F.col(f"c.{id_column}").alias(id_column))


def seeded_order(id_column: str, seed: int = 0) -> Column:
    """A key that shuffles rows the same way each time."""
    return F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed))))


def with_context(chosen: DataFrame, rows: DataFrame, keys: Sequence[str], place: str, around: int = 2) -> DataFrame:
    """For each chosen row those up to ``around`` places before and behind it: ``keys``, ``chosen``, ``place`` and the columns of ``rows``."""
    wanted = chosen.select(*keys, F.col(place).alias("chosen"), F.explode(F.sequence(F.col(place) - around, F.col(place) + around)).alias(place))
    return wanted.join(rows, [*keys, place])
