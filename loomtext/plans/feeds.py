"""Queries over the raw feeds and the voice spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.badrows import HOST_TRACE, SPEAKER_LABELS, failed, loaded, parse_lines
from loomtext.operators.intervals import periods_and_gaps
from loomtext.plans.registry import Registry
from loomtext.sources.tables import table

FEEDS = Registry()


_LABEL_FIELD = '("[^"]*(?:""[^"]*)*"|[^",]*)'

_SQL_FOUND = f"""
WITH t AS (
  SELECT line_id, string_split(line, chr(9)) AS f FROM (
    SELECT line_id, regexp_replace(raw_line, '\\r?\\n?\\z', '') AS line FROM trace_raw WHERE raw_line IS NOT NULL)
  WHERE NOT regexp_full_match(line, '[\\pZ\\s]*') AND NOT starts_with(line, '#') AND NOT starts_with(line, 'wall')
), trace AS (
  SELECT line_id, CASE WHEN len(f) <> 10 THEN 'columns'
    WHEN NOT (regexp_full_match(trim(f[1]), '([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\\.[0-9]{{3}}')
      AND regexp_full_match(trim(f[2]), '[0-9]+') AND regexp_full_match(trim(f[3]), '[0-9]+')
      AND regexp_full_match(trim(f[4]), '[0-9]+') AND regexp_full_match(trim(f[5]), '[0-9]+')
      AND regexp_full_match(trim(f[6]), '[0-9]+') AND regexp_full_match(trim(f[7]), '[a-z]{{3}}-[A-Z]{{3}}')
      AND NOT regexp_full_match(f[8], '[\\pZ\\s]*') AND regexp_full_match(trim(f[9]), '[0-9]+')
      AND NOT regexp_full_match(f[10], '[\\pZ\\s]*') AND NOT regexp_matches(f[10], '[\\p{{Cc}}\\x{{FFFD}}]'))
    THEN 'value' END AS reason FROM t
), l AS (
  SELECT line_id, line, regexp_full_match(line, '(?s){_LABEL_FIELD}(,{_LABEL_FIELD})*') AS good,
    regexp_full_match(line, '(?s){_LABEL_FIELD}(,{_LABEL_FIELD}){{6}}') AS wide,
    regexp_extract(line, '(?s)^{",".join([_LABEL_FIELD] * 7)}$', ['c0','c1','c2','c3','c4','c5','c6']) AS c
  FROM (SELECT line_id, regexp_replace(raw_line, '\\r?\\n?\\z', '') AS line FROM labels_raw WHERE raw_line IS NOT NULL)
  WHERE NOT regexp_full_match(line, '[\\pZ\\s]*') AND NOT starts_with(line, '#') AND NOT starts_with(line, 'c0,')
), v AS (
  SELECT line_id, good, wide,
    trim(trim(c.c0, '"')) AS c0, trim(trim(c.c1, '"')) AS c1, trim(trim(c.c2, '"')) AS c2, trim(trim(c.c3, '"')) AS c3,
    trim(trim(c.c5, '"')) AS c5, CASE WHEN c.c6 LIKE '"%' THEN c.c6[2:-2] ELSE c.c6 END AS c6 FROM l
), labels AS (
  SELECT line_id, CASE WHEN NOT good THEN 'quoting' WHEN NOT wide THEN 'columns'
    WHEN NOT (regexp_full_match(c0, '[0-9a-f]{{16}}') AND regexp_full_match(c1, '[0-9]*[1-9][0-9]*')
      AND regexp_full_match(c2, '[0-9]+') AND c3 IN ('NARRATION', 'DIALOGUE')
      AND regexp_full_match(c5, '[0-9]+(\\.[0-9]+)?|\\.[0-9]+') AND coalesce(TRY_CAST(c5 AS DOUBLE) <= 1, false)
      AND NOT regexp_full_match(c6, '[\\pZ\\s]*') AND NOT regexp_matches(replace(replace(c6, chr(10), ''), chr(13), ''), '[\\p{{Cc}}\\x{{FFFD}}]'))
    THEN 'value' END AS reason FROM v
)
SELECT line_id, reason FROM trace WHERE reason IS NOT NULL
UNION ALL SELECT line_id, reason FROM labels WHERE reason IS NOT NULL
"""


@FEEDS.add("p3_found", _SQL_FOUND)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of both feeds that fail, each with its reason."""
    trace = failed(parse_lines(table(spark, folder, "trace_raw"), HOST_TRACE))
    labels = failed(parse_lines(table(spark, folder, "labels_raw"), SPEAKER_LABELS))
    return trace.unionByName(labels).select("line_id", "reason")


_CTES, _ = _SQL_FOUND.rsplit("SELECT line_id, reason FROM trace WHERE", 1)


@FEEDS.add(
    "p3_trace_rows",
    f"""{_CTES} SELECT line_id, trim(f[1]) AS wall, TRY_CAST(trim(f[2]) AS BIGINT) AS utterance, TRY_CAST(trim(f[3]) AS BIGINT) AS gap_ms, TRY_CAST(trim(f[4]) AS BIGINT) AS chars, TRY_CAST(trim(f[5]) AS BIGINT) AS rate,
    TRY_CAST(trim(f[6]) AS BIGINT) AS pitch, trim(f[7]) AS locale, trim(f[8]) AS voice, TRY_CAST(trim(f[9]) AS BIGINT) AS caller_uid, f[10] AS text FROM t JOIN trace USING (line_id) WHERE reason IS NULL""",
)
def p3_trace_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The good lines of the host traces as typed rows."""
    return loaded(parse_lines(table(spark, folder, "trace_raw"), HOST_TRACE), HOST_TRACE)


_FIELD = "replace(trim(CASE WHEN c.{c} LIKE '\"%' THEN c.{c}[2:-2] ELSE c.{c} END, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '\"\"', '\"')"


@FEEDS.add(
    "p3_label_rows",
    f"""{_CTES} SELECT line_id, {_FIELD.format(c='c0')} AS book_id, TRY_CAST({_FIELD.format(c='c1')} AS BIGINT) AS chapter, TRY_CAST({_FIELD.format(c='c2')} AS BIGINT) AS seq, {_FIELD.format(c='c3')} AS kind,
    {_FIELD.format(c='c4')} AS speaker, TRY_CAST({_FIELD.format(c='c5')} AS DOUBLE) AS confidence, {_FIELD.format(c='c6')} AS sentence FROM l JOIN labels USING (line_id) WHERE reason IS NULL""",
)
def p3_label_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The good lines of the speaker labels as typed rows."""
    return loaded(parse_lines(table(spark, folder, "labels_raw"), SPEAKER_LABELS), SPEAKER_LABELS)


@FEEDS.add("p3_bad_cells")
def p3_bad_cells(spark: SparkSession, folder: str) -> DataFrame:
    """How often each field of each feed holds an invalid value."""
    parts = [
        failed(parse_lines(table(spark, folder, name), layout))
        .select(F.lit(layout.name).alias("feed"), F.explode("bad").alias("field_name"))
        .groupBy("feed", "field_name")
        .agg(F.count("*").alias("n"))
        for name, layout in (("trace_raw", HOST_TRACE), ("labels_raw", SPEAKER_LABELS))
    ]
    return parts[0].unionByName(parts[1])


@FEEDS.add(
    "p4_found",
    """
    WITH s AS (SELECT DISTINCT book_id, seq, span_start, span_end FROM spans WHERE span_start < span_end),
    m AS (SELECT *, max(span_end) OVER (PARTITION BY book_id, seq ORDER BY span_start, span_end
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR span_start > reach THEN 1 ELSE 0 END)
            OVER (PARTITION BY book_id, seq ORDER BY span_start, span_end ROWS UNBOUNDED PRECEDING) AS island FROM m),
    p AS (SELECT book_id, seq, island, min(span_start) AS a, max(span_end) AS b FROM g GROUP BY ALL),
    n AS (SELECT *, lead(a) OVER (PARTITION BY book_id, seq ORDER BY a) AS nxt FROM p)
    SELECT book_id, seq, 'period' AS what, a AS p_start, b AS p_end FROM p
    UNION ALL SELECT book_id, seq, 'gap', b, nxt FROM n WHERE nxt IS NOT NULL
    """,
)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The continuous periods of every entry's spans and the gaps between them."""
    return periods_and_gaps(table(spark, folder, "spans"), ("book_id", "seq"), "span_start", "span_end")
