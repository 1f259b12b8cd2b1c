"""Sinks: index tables by book, exports, reports."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_VERSION = 1
#: Folders of each index table. A book lies in one of them by its hash; a fixed value, as it places the books of written indexes.
SHELVES = 64


def write_index(path: str, books: DataFrame, entries: DataFrame, spans: DataFrame, prefixes: DataFrame) -> None:
    """Writes the four index tables; each book that occurs in a table replaces its own rows there, other books stay.

    A book of another version than this one writes is refused before anything is written. The books of a table share ``SHELVES``
    folders, so that the files to commit and to list don't grow with the books; other books of a shelf are written again with it.
    """
    if not books.where(F.col("schema_version") != INDEX_VERSION).isEmpty():
        raise ValueError(f"this build writes version {INDEX_VERSION} only")
    tables = (("books", books, []), ("entries", entries, ["seq"]), ("spans", spans, ["seq", "ordinal"]), ("prefixes", prefixes.distinct(), ["prefix_hash", "seq"]))
    for name, table, order in tables:
        rows = table.withColumn("shelf", F.pmod(F.xxhash64("book_id"), F.lit(SHELVES)).cast("int"))
        if _exists(table.sparkSession, f"{path}/{name}"):
            rows = rows.unionByName(_other_books(f"{path}/{name}", rows), allowMissingColumns=True)
        # A shelf is split among as many tasks as its share of rows needs; sorting keeps a book's rows together in each file.
        spread = rows.hint("rebalance", "shelf").sortWithinPartitions("shelf", "book_id", *order)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shelf").parquet(f"{path}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _other_books(path: str, rows: DataFrame) -> DataFrame:
    """What the shelves of ``rows`` hold of other books."""
    held = rows.sparkSession.read.parquet(path)
    if "shelf" not in held.columns:
        raise ValueError(f"{path} has a folder for each book, as older builds wrote it: write it anew elsewhere")
    shelves = [r.shelf for r in rows.select("shelf").distinct().collect()]
    new = rows.select(F.col("book_id").alias("_new")).distinct()
    return held.where(F.col("shelf").isin(shelves)).join(new, F.col("book_id").eqNullSafe(F.col("_new")), "left_anti")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four index tables by name; an index that holds a book of a newer version than this build knows is an error."""
    tables = {name: spark.read.parquet(f"{path}/{name}").drop("shelf") for name in ("books", "entries", "spans", "prefixes")}
    known = F.when(F.col("schema_version") <= INDEX_VERSION, F.col("schema_version")).otherwise(F.raise_error(F.lit("the index is newer than this build reads")))
    return tables | {"books": tables["books"].withColumn("schema_version", known)}


def replace_file(path: str, content: bytes) -> None:
    """Writes a file so that a reader sees the old or the new one, never a part: a temporary file beside it is renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(prefix=f".{uuid.uuid4().hex}", dir=folder)
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(content)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def _flat(c: str) -> Column:
    return F.translate(c, "\t\n\r", "   ")


def attributed_tsv(lines: DataFrame, path: str) -> None:
    """``locator kind speaker confidence tier text`` with a header in each file, tabs and line breaks as spaces."""
    rows = lines.select("locator", "kind", F.coalesce("speaker", F.lit("")).alias("speaker"), F.format_string("%.2f", "confidence").alias("confidence"), "tier", _flat("text").alias("text"))
    plain = {"sep": "\t", "header": True, "quote": "", "escape": "", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").options(**plain).csv(path)


def bakeoff_dump(path: str, paragraphs: DataFrame, scenes: DataFrame, questions: DataFrame, cast: DataFrame) -> None:
    """The four files that an outside candidate reads; questions go without their truth."""
    for name, table in (("paragraphs", paragraphs), ("scenes", scenes), ("questions", questions.drop("gold", "truth", "speaker")), ("cast", cast)):
        table.write.mode("overwrite").json(f"{path}/{name}")


def script_json(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON script for each group of ``keys``: its lines in order of ``seq`` and ``n`` with speaker and text."""
    line = F.struct("seq", "n", "speaker", "text")
    grouped = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return grouped.select(*keys, F.to_json(F.struct(*keys, "lines"), {"ignoreNullFields": "true"}).alias("script"))


def report(rows: DataFrame, title: str, limit: int = 40) -> str:
    """A plain table of the first rows of a result that is small by nature, such as a tally."""
    shown = rows.limit(limit).toPandas()
    return f"{title}\n{shown.to_string(index=False)}\n"
