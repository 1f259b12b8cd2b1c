"""Queries over single texts: sentences, normal form, prefixes, runs, names, marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import names as N
from loomtext.functions import text as T
from loomtext.operators.segments import paragraphs, segments
from loomtext.plans import sqltext as S
from loomtext.plans.registry import Registry
from loomtext.session import spread
from loomtext.sources.tables import table

TEXTUAL = Registry()


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entries").where("text IS NOT NULL")


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments(paragraphs(table(spark, folder, "entries")))


@TEXTUAL.add(
    "sentence_split",
    f"SELECT entry_id, (i - 1)::INT AS n, s[i] AS sentence FROM (SELECT entry_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT entry_id, {S.index_sentences('text')} AS s FROM entries WHERE text IS NOT NULL))",
)
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    """Index sentences of every entry."""
    return _entries(spark, folder).select("entry_id", F.posexplode(T.index_sentences(F.col("text"))).alias("n", "sentence"))


@TEXTUAL.add(
    "sentence_split_names",
    f"SELECT entry_id, (i - 1)::INT AS n, s[i] AS sentence FROM (SELECT entry_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT entry_id, {S.plain_sentences('text')} AS s FROM entries WHERE text IS NOT NULL))",
)
def sentence_split_names(spark: SparkSession, folder: str) -> DataFrame:
    """Narration sentences of every entry."""
    return _entries(spark, folder).select("entry_id", F.posexplode(T.plain_sentences(F.col("text"))).alias("n", "sentence"))


@TEXTUAL.add("normalize_basic", f"SELECT entry_id, {S.normal_form('text')} AS normalized FROM entries WHERE text IS NOT NULL")
def normalize_basic(spark: SparkSession, folder: str) -> DataFrame:
    """The normal form without the compatibility step."""
    return _entries(spark, folder).select("entry_id", T.normal_form(F.col("text")).alias("normalized"))


@TEXTUAL.add("normalize_text", f"SELECT entry_id, {S.full_form('text')} AS normalized FROM entries WHERE text IS NOT NULL")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    """The full normal form of every entry."""
    return spread(_entries(spark, folder)).select("entry_id", T.full_form(F.col("text")).alias("normalized"))


@TEXTUAL.add(
    "normalized_sentences",
    f"""SELECT entry_id, normalized FROM (SELECT entry_id, {S.full_form('s')} AS normalized FROM
    (SELECT entry_id, unnest({S.index_sentences('text')}) AS s FROM entries WHERE text IS NOT NULL)) WHERE normalized <> ''""",
)
def normalized_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Index sentences in normal form."""
    sentences = _entries(spark, folder).select("entry_id", F.explode(T.index_sentences(F.col("text"))).alias("s"))
    return sentences.select("entry_id", T.full_form(F.col("s")).alias("normalized")).where("normalized <> ''")


@TEXTUAL.add(
    "prefix_hash",
    f"""WITH {S.PARAGRAPHS}, w AS (SELECT book_id, seq, string_split({S.full_form('text')}, ' ') AS w FROM para),
    p AS (SELECT DISTINCT book_id, seq, array_to_string(w[1:k], ' ') AS p FROM (SELECT *, unnest(generate_series(1, least(6, len(w)))) AS k FROM w))
    SELECT DISTINCT book_id, {S.fnv64('p')} AS prefix_hash, seq FROM p""",
)
def prefix_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The index table of openings: hashes of the first one to six words of each sentence."""
    openings = paragraphs(table(spark, folder, "entries")).select("book_id", "seq", F.explode(T.openings(T.full_form(F.col("text")))).alias("p"))
    return openings.select("book_id", T.fnv64(F.col("p")).alias("prefix_hash"), "seq").distinct()


@TEXTUAL.add("segment_quotes", f"WITH {S.SEGMENTS} SELECT book_id, seq, n, kind, run FROM seg")
def segment_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of narration and dialogue of every paragraph."""
    return _segments(spark, folder).select("book_id", "seq", "n", "kind", "run")


@TEXTUAL.add(
    "speech_tags",
    f"WITH {S.SEGMENTS} SELECT * FROM (SELECT book_id, seq, n, {S.tag_name('before', 'after')} AS tagged, {S.tag_pronoun('before', 'after')} AS pronoun FROM seg WHERE kind = 'DIALOGUE') WHERE tagged IS NOT NULL OR pronoun IS NOT NULL",
)
def speech_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The name and the pronoun of each quotation's speech tag."""
    runs = _segments(spark, folder).where("kind = 'DIALOGUE'")
    tags = runs.select("book_id", "seq", "n", N.tag_name(F.col("before"), F.col("after")).alias("tagged"), N.tag_pronoun(F.col("before"), F.col("after")).alias("pronoun"))
    return tags.where("tagged IS NOT NULL OR pronoun IS NOT NULL")


@TEXTUAL.add(
    "names_in_sentences",
    f"""SELECT entry_id, n, name, {S.title_gender('name')} AS title_gender FROM (
      SELECT entry_id, (i - 1)::INT AS n, unnest({S.names_in('s[i]')}) AS name FROM
      (SELECT entry_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT entry_id, {S.plain_sentences('text')} AS s FROM entries WHERE text IS NOT NULL)))""",
)
def names_in_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Names of each sentence, with the gender that a title tells."""
    sentences = sentence_split_names(spark, folder)
    found = sentences.select("entry_id", "n", F.explode(N.names_in(F.col("sentence"))).alias("name"))
    return found.select("entry_id", "n", "name", N.title_gender(F.col("name")).alias("title_gender"))


@TEXTUAL.add(
    "pronoun_genders",
    f"""SELECT entry_id, {S.pronoun_gender('text')} AS gender FROM entries WHERE {S.pronoun_gender('text')} IS NOT NULL""",
)
def pronoun_genders(spark: SparkSession, folder: str) -> DataFrame:
    """The entries whose pronouns are of one gender."""
    return _entries(spark, folder).select("entry_id", N.pronoun_gender(F.col("text")).alias("gender")).where("gender IS NOT NULL")


@TEXTUAL.add("without_quotes", f"SELECT entry_id, {S.without_quoted('text')} AS narration FROM entries WHERE text IS NOT NULL")
def without_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Entries with their quotations blanked."""
    return _entries(spark, folder).select("entry_id", N.without_quoted(F.col("text")).alias("narration"))


_MARKS = f"""
SELECT entry_id, regexp_full_match(text, '(?:{S.WHITE}|[*·•#~=_.,\\-‐‑‒–—―])*') AS scene_break,
  regexp_matches({S.strip('text')}, '(?i)\\A(?:(?:chapter|book|part|volume)\\b.*|[ivxlcdm]+\\.?|[0-9]+\\.?)\\z') AS heading,
  ceil(length(text) / 4)::INT AS tokens,
  ((length(text) - length(replace(text, '"', ''))) % 2 = 1 OR length(replace(text, '”', '')) > length(replace(text, '“', '')))
    AS leaves_open,
  coalesce({S.strip('text')}[1] IN ('"', '“', '«'), false) AS opens
FROM entries WHERE text IS NOT NULL"""


@TEXTUAL.add("paragraph_marks", _MARKS)
def paragraph_marks(spark: SparkSession, folder: str) -> DataFrame:
    """What each entry is: a break, a heading, its size in tokens, an opened or opening quotation."""
    t = F.col("text")
    return _entries(spark, folder).select(
        "entry_id",
        T.is_scene_break(t).alias("scene_break"),
        T.is_heading(t).alias("heading"),
        T.estimated_tokens(t).alias("tokens"),
        T.leaves_quotation_open(t).alias("leaves_open"),
        T.opens_quotation(t).alias("opens"),
    )


@TEXTUAL.add(
    "host_chunking",
    """SELECT entry_id, (i - 1)::INT AS n, c[i] AS chunk FROM (SELECT entry_id, c, unnest(generate_series(1, len(c))) AS i FROM
    (SELECT entry_id, list_filter(string_split(regexp_replace(text, ',', ',' || chr(2), 'g'), chr(2)), lambda s: s <> '') AS c FROM entries WHERE text IS NOT NULL))""",
)
def host_chunking(spark: SparkSession, folder: str) -> DataFrame:
    """Entries as a reading app would send them: split behind each comma."""
    return _entries(spark, folder).select("entry_id", F.posexplode(T.comma_chunks(F.col("text"))).alias("n", "chunk"))


@TEXTUAL.add("word_tokens", "SELECT entry_id, unnest(regexp_extract_all(text, '([A-Za-z0-9_]+|[^A-Za-z0-9_\\s])', 1)) AS token FROM entries WHERE text IS NOT NULL")
def word_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Words and marks of every entry."""
    return _entries(spark, folder).select("entry_id", F.explode(T.word_tokens(F.col("text"))).alias("token"))


@TEXTUAL.add("fragment_keys", "SELECT rec_id, regexp_replace(first_seen_locator, '#s[^#]*$', '') AS paragraph FROM manifest_characters WHERE first_seen_locator IS NOT NULL")
def fragment_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The paragraph part of each locator."""
    rows = table(spark, folder, "manifest_characters").where("first_seen_locator IS NOT NULL")
    return rows.select("rec_id", F.regexp_replace("first_seen_locator", "#s[^#]*$", "").alias("paragraph"))


@TEXTUAL.add(
    "folded_enums",
    """SELECT rec_id, CASE WHEN upper(gender) IN ('FEMALE', 'MALE', 'NEUTRAL') THEN upper(gender) ELSE 'UNKNOWN' END AS gender,
    CASE WHEN upper(age_band) IN ('CHILD', 'TEEN', 'ADULT', 'ELDER') THEN upper(age_band) ELSE 'UNKNOWN' END AS age_band FROM manifest_characters""",
)
def folded_enums(spark: SparkSession, folder: str) -> DataFrame:
    """Gender and age of every record; a value that nobody knows is UNKNOWN."""
    return table(spark, folder, "manifest_characters").select(
        "rec_id",
        T.known_or(F.col("gender"), ["FEMALE", "MALE", "NEUTRAL"]).alias("gender"),
        T.known_or(F.col("age_band"), ["CHILD", "TEEN", "ADULT", "ELDER"]).alias("age_band"),
    )


@TEXTUAL.add("digests", "SELECT DISTINCT book_id, substr(sha256(title), 1, 16) AS digest FROM books WHERE title IS NOT NULL")
def digests(spark: SparkSession, folder: str) -> DataFrame:
    """The first 16 digits of the SHA-256 of each title."""
    return table(spark, folder, "books").where("title IS NOT NULL").select("book_id", F.substring(F.sha2("title", 256), 1, 16).alias("digest")).distinct()


@TEXTUAL.add(
    "byte_offsets",
    """SELECT book_id, seq, ordinal, span_start, octet_length(encode(text[1:span_start])) AS byte_start FROM (
      SELECT DISTINCT s.book_id, s.seq, s.ordinal, s.span_start, e.text FROM spans s JOIN
        (SELECT book_id, seq, arg_min(text, entry_id) AS text FROM entries WHERE text IS NOT NULL AND book_id IS NOT NULL AND seq IS NOT NULL GROUP BY book_id, seq) e USING (book_id, seq)
      WHERE span_start >= 0)""",
)
def byte_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Where each span begins in the UTF-8 bytes of its entry."""
    entries = table(spark, folder, "entries").where("text IS NOT NULL AND book_id IS NOT NULL AND seq IS NOT NULL")
    texts = entries.groupBy("book_id", "seq").agg(F.min(F.struct("entry_id", "text")).alias("e")).select("book_id", "seq", F.col("e.text").alias("text"))
    spans = table(spark, folder, "spans").select("book_id", "seq", "ordinal", "span_start").where("span_start >= 0").distinct()
    start = F.octet_length(F.substr("text", F.lit(1), F.col("span_start"))).cast("bigint")
    return spans.join(texts, ["book_id", "seq"]).select("book_id", "seq", "ordinal", "span_start", start.alias("byte_start")).distinct()


@TEXTUAL.add(
    "bytes_back",
    """SELECT DISTINCT book_id, seq, ordinal, span_start, span_start AS char_start FROM spans s SEMI JOIN
      (SELECT book_id, seq, arg_min(text, entry_id) AS text FROM entries WHERE text IS NOT NULL AND book_id IS NOT NULL AND seq IS NOT NULL GROUP BY book_id, seq) e
      ON s.book_id = e.book_id AND s.seq = e.seq AND s.span_start >= 0 AND s.span_start <= length(e.text)""",
)
def bytes_back(spark: SparkSession, folder: str) -> DataFrame:
    """The character at each byte offset of a span; it is the one that the span began with."""
    entries = table(spark, folder, "entries").where("text IS NOT NULL AND book_id IS NOT NULL AND seq IS NOT NULL")
    texts = entries.groupBy("book_id", "seq").agg(F.min(F.struct("entry_id", "text")).alias("e")).select("book_id", "seq", F.col("e.text").alias("text"))
    placed = byte_offsets(spark, folder).join(texts, ["book_id", "seq"]).where(F.col("span_start") <= F.length("text"))
    return placed.select("book_id", "seq", "ordinal", "span_start", T.char_of_byte(F.col("text"), F.col("byte_start").cast("int")).alias("char_start")).distinct()


@TEXTUAL.add(
    "voice_descriptions",
    """SELECT rec_id, CASE upper(age_band) WHEN 'CHILD' THEN 'young' WHEN 'TEEN' THEN 'teenage' WHEN 'ELDER' THEN 'elderly' ELSE 'adult' END || ' ' ||
      CASE upper(gender) WHEN 'MALE' THEN 'man' WHEN 'FEMALE' THEN 'woman' ELSE 'person' END ||
      CASE WHEN len(traits) > 0 THEN ', ' || array_to_string(traits[1:2], ', ') ELSE '' END || '.' AS description FROM manifest_characters""",
)
def voice_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """One line about each record's voice: age, sort of person, the first two traits."""
    age = F.upper("age_band")
    gender = F.upper("gender")
    traits = F.coalesce("traits", F.array().cast("array<string>"))
    return table(spark, folder, "manifest_characters").select(
        "rec_id",
        F.concat(
            F.when(age == "CHILD", "young").when(age == "TEEN", "teenage").when(age == "ELDER", "elderly").otherwise("adult"),
            F.lit(" "),
            F.when(gender == "MALE", "man").when(gender == "FEMALE", "woman").otherwise("person"),
            F.when(F.size(traits) > 0, F.concat(F.lit(", "), F.array_join(F.slice(traits, 1, 2), ", "))).otherwise(""),
            F.lit("."),
        ).alias("description"),
    )


@TEXTUAL.add("json_strings", "SELECT line_id, to_json(raw_line)::VARCHAR AS quoted FROM labels_raw WHERE raw_line IS NOT NULL")
def json_strings(spark: SparkSession, folder: str) -> DataFrame:
    """Raw lines as JSON strings."""
    rows = table(spark, folder, "labels_raw").where("raw_line IS NOT NULL")
    return rows.select("line_id", F.regexp_extract(F.to_json(F.struct("raw_line")), r'(?s)^\{"raw_line":(.*)\}$', 1).alias("quoted"))


@TEXTUAL.add(
    "lengthened_openers",
    f"""WITH {S.PARAGRAPHS}, w AS (SELECT book_id, seq, string_split({S.normal_form('text')}, ' ') AS w FROM para),
    p AS (SELECT book_id, seq, k, array_to_string(w[1:k], ' ') AS p FROM (SELECT *, unnest(generate_series(1, len(w))) AS k FROM w)),
    c AS (SELECT *, count(*) OVER (PARTITION BY book_id, p) AS c FROM p)
    SELECT book_id, seq, min(k)::INT AS words FROM c WHERE c = 1 GROUP BY book_id, seq""",
)
def lengthened_openers(spark: SparkSession, folder: str) -> DataFrame:
    """How many opening words tell a paragraph from all others of its book; one that another repeats or goes on from has no row."""
    paras = paragraphs(table(spark, folder, "entries")).select("book_id", "seq", T.normal_form(F.col("text")).alias("form"))
    openings = paras.select("book_id", "seq", F.posexplode(T.openings(F.col("form"))).alias("k", "p"))
    # An opening that occurs once has one place, so no rows of a repeated one are gathered.
    alone = openings.groupBy("book_id", "p").agg(F.count("*").alias("c"), F.min("seq").alias("seq"), F.min("k").alias("k")).where("c = 1")
    short = alone.groupBy("book_id", "seq").agg((F.min("k") + 1).alias("words"))
    # Of texts in order, each has the most words in common with the one before or behind it. Only those that share all
    # words of the longest opening are put in order, equal ones once.
    w = F.split("form", " ")
    longer = paras.where(F.size(w) >= T.HEAD_WORDS).groupBy("book_id", "form").agg(F.count("*").alias("c"), F.min("seq").alias("seq"))
    longer = longer.select("book_id", "c", "seq", w.alias("w")).withColumn("head", F.array_join(F.slice("w", 1, T.HEAD_WORDS), " "))
    ordered = Window.partitionBy("book_id", "head").orderBy("w")
    common = lambda other: F.coalesce(F.array_position(F.zip_with("w", other, lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1, F.lit(0))
    met = longer.withColumns({"a": F.lag("w").over(ordered), "b": F.lead("w").over(ordered)})
    # One without a neighbour that shares its opening is among the short ones.
    told = met.withColumn("words", (F.greatest(common(F.col("a")), common(F.col("b"))) + 1).cast("int")).where((F.col("c") == 1) & (F.col("words") > T.HEAD_WORDS) & (F.col("words") <= F.size("w")))
    return short.unionByName(told.select("book_id", "seq", "words"))
