"""Small text formats: labelled passages, answers, profiles of voices, exports, delimited corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``i``, ``line`` of text files, in the order of each file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).where(~F.col("line").rlike(r"^\s*$") & ~F.startswith("line", F.lit("#")))


def labelled_passages(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``i``, ``gold`` (array of labels), ``text`` of lines ``gold TAB text``; a line without a tab is an error."""
    rows = _rows(spark, path)
    tab = F.instr("line", "\t")
    checked = F.when(tab > 0, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("no tab in line: "), F.col("line"))))
    return rows.select("path", "i", F.split(F.split(checked, "\t", 2)[0], "[|]").alias("gold"), F.split("line", "\t", 2)[1].alias("text"))


def declared_cast(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``name``, ``gender`` of the first line ``# cast: name=gender, ...`` of each file."""
    first = lines(spark, path).where(F.startswith("line", F.lit("# cast:"))).groupBy("path").agg(F.min_by("line", "i").alias("line"))
    pairs = F.split(F.regexp_replace("line", "^# cast:", ""), ",")
    told = first.select("path", F.explode(pairs).alias("p")).where(F.contains("p", F.lit("=")))
    gender = F.upper(F.trim(F.split("p", "=", 2)[1]))
    return told.select("path", F.trim(F.split("p", "=", 2)[0]).alias("name"), F.when(gender.isin("MALE", "FEMALE", "NEUTRAL"), gender).otherwise("UNKNOWN").alias("gender"))


def slice_labels(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``seq``, ``speaker`` (null for narration), ``text`` of lines ``speaker TAB sentence``."""
    rows = labelled_passages(spark, path).select("path", "i", F.array_join("gold", "|").alias("speaker"), "text")
    ordered = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "speaker", "text"))).alias("r"))
    return ordered.select("path", F.posexplode("r").alias("seq", "r")).select("path", "seq", F.nullif("r.speaker", F.lit("NARRATION")).alias("speaker"), "r.text")


def pitch_profile(spark: SparkSession, path: str) -> DataFrame:
    """``speaker``, ``f0_hz``, ``voice`` of the voices that are male or female and measured."""
    parts = F.split("line", "\t")
    rows = _rows(spark, path).where(~F.startswith("line", F.lit("speaker\t"))).where(F.size(parts) >= 3)
    typed = rows.select(F.trim(parts[0]).try_cast("int").alias("speaker"), F.trim(parts[1]).try_cast("double").alias("f0_hz"), F.trim(parts[2]).alias("voice"))
    return typed.where("speaker IS NOT NULL AND f0_hz IS NOT NULL AND voice IN ('male', 'female')")


def poor_voices(spark: SparkSession, path: str) -> DataFrame:
    """``speaker`` of the voices marked as poor."""
    parts = F.split("line", "\t")
    rows = _rows(spark, path).where(F.size(parts) >= 2).select(F.trim(parts[0]).try_cast("int").alias("speaker"), F.trim(parts[1]).alias("quality"))
    return rows.where("speaker IS NOT NULL AND quality = 'poor'").select("speaker").distinct()


def answers(spark: SparkSession, path: str, candidate: str) -> DataFrame:
    """``id``, ``speaker``, ``evidence`` of a candidate's answers; no speaker means that it declined, and gives no row."""
    parts = F.split("line", "\t")
    told = F.nullif(F.try_element_at(parts, F.lit(3)), F.lit(""))
    rows = _rows(spark, path).where(F.size(parts) >= 2).select(parts[0].alias("id"), F.nullif(parts[1], F.lit("")).alias("speaker"), F.coalesce(told, F.lit(candidate)).alias("evidence"))
    return rows.where("speaker IS NOT NULL")


def attributed_export(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``group``, ``i``, ``locator``, ``kind``, ``speaker``, ``confidence``, ``tier``, ``text``: each row belongs to the PARAGRAPH row before it."""
    from pyspark.sql import Window

    parts = F.split("line", "\t")
    rows = lines(spark, path).where("i > 0").where(F.size(parts) >= 6)
    typed = rows.select(
        "path", "i", parts[0].alias("locator"), parts[1].alias("kind"), F.nullif(F.trim(parts[2]), F.lit("")).alias("speaker"), F.coalesce(parts[3].try_cast("double"), F.lit(0.0)).alias("confidence"), parts[4].alias("tier"), parts[5].alias("text")
    )
    group = F.sum((F.col("kind") == "PARAGRAPH").cast("int")).over(Window.partitionBy("path").orderBy("i"))
    return typed.withColumn("group", group)


TRACE_FIELDS = "wall string, utterance int, gap_ms bigint, chars int, rate int, pitch int, locale string, voice string, caller_uid int, text string"


def host_trace(spark: SparkSession, path: str, stream: bool = False, rejected: bool = False) -> DataFrame:
    """Chunks of a reading app from tab-separated files with a header; a leading space of the text stays. With ``stream`` as a stream.

    With ``rejected`` instead the rows that do not fit the layout, as far as they can be read, each with its ``line``; none vanishes without a trace.
    """
    reader = spark.readStream if stream else spark.read
    options = {"sep": "\t", "header": "true", "quote": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "columnNameOfCorruptRecord": "line", "enforceSchema": "true"}
    rows = reader.schema(f"{TRACE_FIELDS}, line string").options(**options).csv(path)
    return rows.where("line IS NOT NULL") if rejected else rows.where(F.col("line").isNull() & F.col("text").rlike(r"\S")).drop("line")


def quoted_csv(spark: SparkSession, path: str, rejected: bool = False) -> DataFrame:
    """Comma-separated files with a header, quoted fields, doubled quotes and line breaks inside; with ``rejected`` instead the rows of another width, each with its ``line``."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False}
    if not rejected:
        return spark.read.options(mode="DROPMALFORMED", **options).csv(path)
    fields = spark.read.options(**options).csv(path).schema
    rows = spark.read.schema(StructType([*fields, StructField("line", StringType())])).options(columnNameOfCorruptRecord="line", **options).csv(path)
    return rows.where("line IS NOT NULL")


def novel_index(spark: SparkSession, path: str) -> DataFrame:
    """``folder``, ``title``, ``person``, ``translated``, ``genre``, ``year`` of a corpus of novels, with defaults 3, no, ``unknown`` and 0."""
    rows = quoted_csv(spark, path)
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return rows.select(
        F.trim("Folder Name").alias("folder"),
        F.trim("Novel Title").alias("title"),
        F.coalesce(F.regexp_extract("Narrative Person", r"(\d+)", 1).try_cast("int"), F.lit(3)).alias("person"),
        F.coalesce(F.upper(F.trim("Translator Code")).isin("Y", "YES", "1", "T", "TRUE"), F.lit(False)).alias("translated"),
        F.coalesce(text("Genre"), F.lit("unknown")).alias("genre"),
        F.coalesce(F.trim("Year of First Publication").try_cast("int"), F.lit(0)).alias("year"),
    )


def span_literal(c: Column) -> Column:
    """The pairs of a literal such as ``[[1, 5], [9, 12]]``."""
    pair = r"\[\s*(\d+)\s*,\s*(\d+)\s*\]"
    return F.zip_with(
        F.regexp_extract_all(c, F.lit(pair), F.lit(1)), F.regexp_extract_all(c, F.lit(pair), F.lit(2)), lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    )


def gold_quotations(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``text``, ``speaker``, ``type``, ``spans`` (in bytes) of labelled quotations with text and speaker."""
    rows = quoted_csv(spark, path)
    kind = F.nullif(F.trim("quoteType"), F.lit(""))
    return rows.select(
        F.trim("quoteID").alias("id"),
        F.translate(F.trim("quoteText"), "\n", " ").alias("text"),
        F.trim("speaker").alias("speaker"),
        F.when(kind.isNull() | (kind == "nan"), "Unspecified").otherwise(kind).alias("type"),
        span_literal(F.coalesce("quoteByteSpans", F.lit(""))).alias("spans"),
    ).where("text <> '' AND speaker <> ''")


def character_info(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``aliases`` (with the name), ``gender``, ``category`` of a novel's characters; aliases come as a set or list literal."""
    rows = quoted_csv(spark, path)
    alias = F.regexp_extract_all(F.coalesce("Aliases", F.lit("")), F.lit("'([^']*)'"), F.lit(1))
    return rows.select(F.trim("Main Name").alias("name"), F.array_union(F.array(F.trim("Main Name")), alias).alias("aliases"), F.trim("Gender").alias("gender"), F.trim("Category").alias("category"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
