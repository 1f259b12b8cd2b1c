"""Queries that run as streams over the tables, and their equals on the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import full_form
from loomtext.operators import matching as M
from loomtext.operators.segments import paragraphs
from loomtext.plans import sqltext as S
from loomtext.plans.library import _HITS
from loomtext.plans.registry import Registry
from loomtext.session import checkpointed
from loomtext.sources.tables import table
from loomtext.streaming import trace as R

STREAMS = Registry()


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


_SESSIONS = """
WITH t AS (SELECT session_id, captured_at AS c FROM host_trace WHERE captured_at IS NOT NULL),
g AS (SELECT *, CASE WHEN c - lag(c) OVER w < INTERVAL 5 SECONDS THEN 0 ELSE 1 END AS cut FROM t WINDOW w AS (PARTITION BY session_id ORDER BY c)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY session_id ORDER BY c ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT session_id, min(c) AS session_start, max(c) + INTERVAL 5 SECONDS AS session_end, count(*) AS n FROM s GROUP BY session_id, k"""


@STREAMS.add("sessions_gap", _SESSIONS)
def sessions_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of chunks that follow each other within five seconds."""
    return R.sessions(table(spark, folder, "host_trace").where("captured_at IS NOT NULL"), "captured_at", ["session_id"], "5 seconds")


@STREAMS.add(
    "tumbling_windows",
    """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each type by hour."""
    return R.windows(table(spark, folder, "events"), "ts", ["event_type"], "1 hour", n=F.count("*"), total=F.round(F.sum("value"), 4))


@STREAMS.add(
    "sliding_windows",
    """SELECT event_type, w AS window_start, w + INTERVAL 2 HOURS AS window_end, count(*) AS n FROM
    (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL""",
)
def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each type in windows of two hours every hour."""
    return R.windows(table(spark, folder, "events"), "ts", ["event_type"], "2 hours", "1 hour", n=F.count("*"))


@STREAMS.add(
    "stream_hourly",
    "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM events GROUP BY ALL",
)
def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """The events by hour, counted by a stream."""
    return R.drained(spark, R.windows(_stream(spark, folder, "events"), "ts", ["event_type"], "1 hour", n=F.count("*")), mode="complete")


@STREAMS.add("stream_deduplicated", "SELECT DISTINCT session_id, utterance FROM host_trace WHERE session_id IS NOT NULL AND utterance IS NOT NULL")
def stream_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks without redelivered ones, by a stream whose memory reaches ten years back."""
    rows = _stream(spark, folder, "host_trace").where("session_id IS NOT NULL AND utterance IS NOT NULL AND received_at IS NOT NULL")
    return R.drained(spark, R.once(rows, "received_at", ["session_id", "utterance"], "3650 days").select("session_id", "utterance"))


@STREAMS.add(
    "stream_lock",
    f"""WITH RECURSIVE {_HITS}, held_in AS (SELECT form, list(book_id ORDER BY indexed_at DESC, book_id) AS books FROM found GROUP BY 1),
    c AS (SELECT session_id, utterance, row_number() OVER (PARTITION BY session_id ORDER BY utterance, chunk_id) AS i, coalesce(books, []::VARCHAR[]) AS books
      FROM (SELECT session_id, utterance, chunk_id, {S.full_form('text')} AS form FROM host_trace WHERE session_id IS NOT NULL AND utterance IS NOT NULL) LEFT JOIN held_in USING (form)),
    k AS (
      SELECT DISTINCT session_id, 0::BIGINT AS i, NULL::BIGINT AS said_at, NULL::VARCHAR AS locked, 0 AS misses, []::VARCHAR[] AS one, []::VARCHAR[] AS two FROM c
      UNION ALL
      SELECT session_id, i, said_at, CASE WHEN locked IS NULL THEN list_filter(books, lambda b: list_contains(one, b) AND list_contains(two, b))[1] WHEN missed >= 10 THEN NULL ELSE locked END,
        CASE WHEN locked IS NULL OR missed >= 10 THEN 0 ELSE missed END, CASE WHEN locked IS NULL THEN books ELSE []::VARCHAR[] END, CASE WHEN locked IS NULL THEN one ELSE []::VARCHAR[] END
      FROM (SELECT k.session_id, c.i, c.utterance::BIGINT AS said_at, locked, CASE WHEN list_contains(books, locked) THEN 0 ELSE misses + 1 END AS missed, one, two, books FROM k JOIN c ON k.session_id = c.session_id AND c.i = k.i + 1))
    SELECT session_id, said_at AS "at", locked FROM k WHERE i > 0""",
)
def stream_lock(spark: SparkSession, folder: str) -> DataFrame:
    """The book that each session is locked on to after each chunk, of all books, by a stream of hits."""
    said = table(spark, folder, "host_trace").where("session_id IS NOT NULL AND utterance IS NOT NULL").select("session_id", "utterance", "chunk_id", full_form(F.col("text")).alias("form"))
    held = paragraphs(table(spark, folder, "entries")).select("book_id", full_form(F.col("text")).alias("form"))
    found = checkpointed(M.session_hits(said, held, table(spark, folder, "books")))
    rows = _stream(spark, folder, "host_trace").where("session_id IS NOT NULL AND utterance IS NOT NULL").withColumn("form", full_form(F.col("text")))
    hits = rows.join(found, ["session_id", "form"], "left").select("session_id", F.col("utterance").cast("bigint").alias("at"), F.coalesce("books", F.array().cast("array<string>")).alias("books"))
    return R.drained(spark, R.lock_stream(hits))


@STREAMS.add("index_roundtrip", "SELECT book_id, count(*) AS entries FROM (SELECT DISTINCT book_id, seq FROM entries WHERE book_id IS NOT NULL AND seq IS NOT NULL AND text IS NOT NULL AND NOT regexp_full_match(text, '[\\pZ\\t-\\r\\x1c-\\x1f\\x{85}]*')) GROUP BY 1")
def index_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of each book as they come back from a written index."""
    path = f"{R._shared(spark)}/entries"
    rows = paragraphs(table(spark, folder, "entries")).select("book_id", "seq", "text", "chapter")
    rows.hint("rebalance", "book_id").write.mode("overwrite").partitionBy("book_id").parquet(path)
    back = spark.read.schema("seq int, text string, chapter int, book_id string").parquet(path)
    return back.groupBy("book_id").agg(F.count("*").alias("entries"))
