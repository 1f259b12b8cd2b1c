"""Queries on files: rows of the tables written in each format and read back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import char_of_byte
from loomtext.operators.segments import paragraphs, segments
from loomtext.plans import sqltext as S
from loomtext.plans.registry import Registry
from loomtext.sources import books as B
from loomtext.sources import fixtures as X
from loomtext.sources import manifests as M
from loomtext.sources import sinks as K
from loomtext.sources.tables import table
from loomtext.streaming.trace import _shared

FILES = Registry()

#: White space of any kind as one space each, as the formats of one line for a row need it.
_FLAT = r"[\p{Z}\t-\r\x1c-\x1f\x{85}]+"


def _flat_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{S.WHITE}+', ' ', 'g'))"


def _flat(c: str) -> Column:
    return F.trim(F.regexp_replace(c, _FLAT, " "))


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs(table(spark, folder, "entries"))


def _written(spark: SparkSession, lines: DataFrame) -> str:
    """The path of text files of the column ``value``."""
    path = f"{_shared(spark)}/text"
    lines.select("value").write.text(path)
    return path


def _written_csv(spark: SparkSession, rows: DataFrame) -> str:
    path = f"{_shared(spark)}/csv"
    rows.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


_PARTS = f"""{S.PARAGRAPHS}, part AS (SELECT book_id, chapter, (row_number() OVER (PARTITION BY book_id, chapter ORDER BY seq) - 1)::BIGINT AS idx, {_flat_sql('text')} AS text FROM para WHERE chapter IS NOT NULL)"""


@FILES.add("epub_roundtrip", f"WITH {_PARTS} SELECT book_id, chapter, idx, text FROM part")
def epub_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every chapter as an EPUB of its own, and the paragraphs read from it."""
    rows = _paragraphs(spark, folder).where("chapter IS NOT NULL").select("book_id", "chapter", "seq", "text")

    def pack(key: tuple, chapter: pd.DataFrame) -> pd.DataFrame:
        texts = chapter.sort_values("seq")["text"].tolist()
        return pd.DataFrame({"path": [f"{key[0]}/{key[1]}"], "content": [B.epub_bytes("Chapter", [texts])]})

    archives = rows.groupBy("book_id", "chapter").applyInPandas(pack, "path string, content binary")
    place = F.split("path", "/")
    return B.epub_rows(archives).select(place[0].alias("book_id"), place[1].cast("int").alias("chapter"), "idx", "text")


@FILES.add("sound_roundtrip", "SELECT vec_id, len(embedding) AS samples, list_sum(list_transform(embedding, lambda v: floor(greatest(-1, least(1, v::DOUBLE)) * 32767 + 0.5)))::BIGINT AS total FROM embeddings")
def sound_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as a sound file, and the samples read from it."""

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heard = [M.wav_samples(M.wav_bytes(v, 8000))[0] for v in batch["vec"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "samples": [len(x) for x in heard], "total": [int(np.rint(x * 32767).sum()) for x in heard]})

    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return vectors.mapInPandas(through, "vec_id bigint, samples bigint, total bigint")


@FILES.add(
    "labelled_roundtrip",
    f"""WITH {S.SEGMENTS} SELECT array_to_string(list(kind ORDER BY n), '+') AS gold, any_value({_flat_sql('para.text')}) AS text
    FROM seg JOIN para ON seg.book_id = para.book_id AND seg.seq = para.seq GROUP BY seg.book_id, seg.seq""",
)
def labelled_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs as labelled passages with the kinds of their runs, and read back."""
    paras = _paragraphs(spark, folder)
    kinds = segments(paras).groupBy("book_id", "seq").agg(F.array_sort(F.collect_list(F.struct("n", "kind"))).alias("k"))
    lines = paras.join(kinds, ["book_id", "seq"]).select(F.concat_ws("\t", F.array_join(F.transform("k", lambda x: x["kind"]), "|"), _flat("text")).alias("value"))
    return X.labelled_passages(spark, _written(spark, lines)).select(F.array_join("gold", "+").alias("gold"), "text")


@FILES.add("slice_roundtrip", f"WITH {S.SEGMENTS} SELECT nullif(kind, 'NARRATION') AS speaker, {_flat_sql('run')} AS text FROM seg")
def slice_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Runs as labels of a slice, narration without a speaker, and read back."""
    lines = segments(_paragraphs(spark, folder)).select(F.concat_ws("\t", "kind", _flat("run")).alias("value"))
    return X.slice_labels(spark, _written(spark, lines)).select("speaker", "text")


@FILES.add(
    "declared_roundtrip",
    f"""WITH c AS (SELECT DISTINCT book_id, {_flat_sql("translate(display_name, ',=', '  ')")} AS name, upper(coalesce(gender, '')) AS g FROM manifest_characters WHERE book_id IS NOT NULL AND display_name IS NOT NULL)
    SELECT DISTINCT book_id || '/' || name AS name, CASE WHEN g IN ('MALE', 'FEMALE', 'NEUTRAL') THEN g ELSE 'UNKNOWN' END AS gender FROM c""",
)
def declared_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The cast as the header line of files, and read back."""
    named = table(spark, folder, "manifest_characters").where("book_id IS NOT NULL AND display_name IS NOT NULL")
    pairs = named.select("book_id", F.concat("book_id", F.lit("/"), _flat(F.translate("display_name", ",=", "  ")), F.lit("="), F.coalesce("gender", F.lit(""))).alias("p")).distinct()
    # A line for each book; its file has no other.
    lines = pairs.groupBy("book_id").agg(F.concat(F.lit("# cast: "), F.array_join(F.array_sort(F.collect_list("p")), ", ")).alias("value"))
    path = f"{_shared(spark)}/cast"
    lines.hint("rebalance", "book_id").write.partitionBy("book_id").text(path)
    return X.declared_cast(spark, path).select("name", "gender").distinct()


@FILES.add("profile_roundtrip", "SELECT speaker, f0_hz, voice FROM voices WHERE f0_hz IS NOT NULL AND voice IN ('male', 'female')")
def profile_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The voices' pitches as lines, and read back."""
    lines = table(spark, folder, "voices").select(F.concat_ws("\t", "speaker", F.coalesce(F.col("f0_hz").cast("string"), F.lit("?")), "voice").alias("value"))
    return X.pitch_profile(spark, _written(spark, lines.unionByName(spark.createDataFrame([("# pitch",), ("speaker\tf0_hz\tvoice",)], "value string"))))


@FILES.add("quality_roundtrip", "SELECT DISTINCT speaker FROM voices WHERE quality = 'poor'")
def quality_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The voices' qualities as lines, and the poor ones read back."""
    lines = table(spark, folder, "voices").select(F.concat_ws("\t", "speaker", F.coalesce("quality", F.lit("good")), F.lit("note")).alias("value"))
    return X.poor_voices(spark, _written(spark, lines))


@FILES.add("answers_roundtrip", "SELECT concat_ws(':', book_id, seq, ordinal) AS id, speaker_id AS speaker, 'readers' AS evidence FROM spans WHERE speaker_id IS NOT NULL AND speaker_id <> ''")
def answers_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The readers' spans as a candidate's answers, and read back; those without a speaker decline."""
    lines = table(spark, folder, "spans").select(F.concat_ws("\t", F.concat_ws(":", "book_id", "seq", "ordinal"), F.coalesce("speaker_id", F.lit(""))).alias("value"))
    return X.answers(spark, _written(spark, lines), "readers")


@FILES.add(
    "export_roundtrip",
    f"WITH {S.SEGMENTS} SELECT book_id || '/' || seq || '#' || n AS locator, kind, 0.25::DOUBLE AS confidence, 'NONE' AS tier, translate(run, chr(9) || chr(10) || chr(13), '   ') AS text FROM seg",
)
def export_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Attributed runs exported as lines, and read back."""
    path = f"{_shared(spark)}/export"
    rows = segments(_paragraphs(spark, folder)).select(
        F.concat("book_id", F.lit("/"), "seq", F.lit("#"), "n").alias("locator"), "kind", F.lit(None).cast("string").alias("speaker"), F.lit(0.25).alias("confidence"), F.lit("NONE").alias("tier"), F.col("run").alias("text")
    )
    K.attributed_tsv(rows, path)
    return X.attributed_export(spark, path).select("locator", "kind", "confidence", "tier", "text")


@FILES.add("csv_roundtrip", "SELECT doc_id::VARCHAR AS doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''")
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as quoted fields with commas, quotes and line breaks, and read back."""
    rows = table(spark, folder, "documents").select("doc_id", "text").where("text IS NOT NULL AND text <> ''")
    return X.quoted_csv(spark, _written_csv(spark, rows))


@FILES.add(
    "novels_roundtrip",
    "SELECT book_id AS folder, trim(title) AS title, 3 AS person, lang IS DISTINCT FROM 'en' AS translated, coalesce(lang, 'unknown') AS genre, entry_count AS year FROM books",
)
def novels_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Books as the index of a corpus, and read back with its defaults."""
    books = table(spark, folder, "books")
    rows = books.select(
        F.col("book_id").alias("Folder Name"), F.col("title").alias("Novel Title"), F.lit("third").alias("Narrative Person"),
        F.when(F.col("lang").eqNullSafe("en"), "n").otherwise("y").alias("Translator Code"), F.col("lang").alias("Genre"), F.col("entry_count").alias("Year of First Publication"),
    )
    return X.novel_index(spark, _written_csv(spark, rows))


_QUOTED = f"{S.SEGMENTS}, q AS (SELECT book_id || '/' || seq || '/' || n AS id, {_flat_sql('run')} AS text, run_start FROM seg WHERE kind = 'DIALOGUE')"


@FILES.add("quotations_roundtrip", f"WITH {_QUOTED} SELECT id, text, 'Unspecified' AS type, 1 AS spans, run_start::INT AS span_start, (run_start + length(text))::INT AS span_end FROM q WHERE text <> ''")
def quotations_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Quotations as labelled rows with literals of spans, and read back."""
    quotes = segments(_paragraphs(spark, folder)).where("kind = 'DIALOGUE'").withColumn("t", _flat("run"))
    literal = F.concat(F.lit("[["), "run_start", F.lit(", "), F.col("run_start") + F.length("t"), F.lit("]]"))
    rows = quotes.select(F.concat_ws("/", "book_id", "seq", "n").alias("quoteID"), F.col("t").alias("quoteText"), F.lit("nobody").alias("speaker"), F.lit("nan").alias("quoteType"), literal.alias("quoteByteSpans"))
    read = X.gold_quotations(spark, _written_csv(spark, rows))
    return read.select("id", "text", "type", F.size("spans").alias("spans"), F.col("spans")[0]["start"].alias("span_start"), F.col("spans")[0]["end"].alias("span_end"))


@FILES.add(
    "characters_roundtrip",
    f"""WITH c AS (SELECT {_flat_sql("replace(display_name, chr(39), '’')")} AS name, list_distinct(list_transform(list_filter(coalesce(aliases, []), lambda a: a IS NOT NULL AND a <> ''), lambda a: replace(a, chr(39), '’'))) AS al, coalesce(gender, '?') AS gender
      FROM manifest_characters WHERE display_name IS NOT NULL AND NOT regexp_full_match(display_name, '{S.WHITE}*'))
    SELECT name, len(list_distinct(list_prepend(name, al)))::INT AS known_by, gender, 'minor' AS category FROM c""",
)
def characters_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the cast with a literal of aliases, and read back."""
    plain = lambda c: F.replace(c, F.lit("'"), F.lit("’"))
    people = table(spark, folder, "manifest_characters").where(F.col("display_name").rlike(r"[^\p{Z}\t-\r\x1c-\x1f\x{85}]"))
    listed = F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != "")), lambda a: F.concat(F.lit("'"), plain(a), F.lit("'")))
    rows = people.select(
        F.trim(F.regexp_replace(plain(F.col("display_name")), _FLAT, " ")).alias("Main Name"), F.concat(F.lit("{"), F.array_join(listed, ", "), F.lit("}")).alias("Aliases"), F.coalesce("gender", F.lit("?")).alias("Gender"), F.lit("minor").alias("Category")
    )
    return X.character_info(spark, _written_csv(spark, rows)).select("name", F.size("aliases").alias("known_by"), "gender", "category")


@FILES.add("trace_roundtrip", "SELECT session_id AS voice, utterance, translate(text, chr(9) || chr(10) || chr(13), '   ') AS text FROM host_trace WHERE utterance IS NOT NULL AND session_id IS NOT NULL AND regexp_matches(text, '[^ \\t\\n\\x0b\\f\\r]')")
def trace_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks as lines of a trace, and read back with their leading spaces."""
    chunks = table(spark, folder, "host_trace").where("utterance IS NOT NULL AND session_id IS NOT NULL AND text IS NOT NULL")
    zero = F.lit("0")
    said = F.translate("text", "\t\n\r", "   ")
    rows = chunks.select(F.lit("00:00:00.000").alias("wall"), "utterance", *[zero.alias(c) for c in ("gapMs", "chars", "rate", "pitch")], F.lit("eng-GBR").alias("locale"), F.col("session_id").alias("voice"), zero.alias("callerUid"), said.alias("text"))
    path = f"{_shared(spark)}/trace"
    rows.write.options(sep="\t", header=True, quote="", escape="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return X.host_trace(spark, path).select("voice", "utterance", "text")


@FILES.add(
    "novel_roundtrip",
    f"""WITH p AS (SELECT book_id, seq, {_flat_sql('text')} AS text FROM (SELECT book_id, seq, text FROM ({'WITH ' + S.PARAGRAPHS + ' SELECT * FROM para'}))),
    o AS (SELECT *, (row_number() OVER w - 1)::INT AS idx, (coalesce(sum(length(text) + 2) OVER (PARTITION BY book_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS from_char, lead(seq) OVER w IS NULL AS final FROM p WINDOW w AS (PARTITION BY book_id ORDER BY seq))
    SELECT book_id, idx, CASE WHEN final THEN text || ' ' ELSE text END AS text, from_char, (from_char + length(text) + final::INT)::INT AS to_char FROM o""",
)
def novel_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Books as plain texts, and their paragraphs with their places in the file; the last keeps the file's closing line break as a space."""
    rows = _paragraphs(spark, folder).select("book_id", F.struct("seq", _flat("text").alias("t")).alias("p"))
    texts = rows.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "\n\n").alias("value"))
    path = f"{_shared(spark)}/novels"
    texts.write.partitionBy("book_id").text(path)
    placed = B.read_paragraphs(spark, path)
    return placed.select(F.regexp_extract("path", "book_id=([^/]+)", 1).alias("book_id"), F.col("idx").cast("int").alias("idx"), "text", F.col("start").alias("from_char"), F.col("end").alias("to_char"))


@FILES.add(
    "text_chapters",
    f"""WITH {S.PARAGRAPHS}, h AS (SELECT book_id, seq, text, regexp_matches(text, '(?i)^(CHAPTER|LETTER)[ \\t\\n\\x0b\\f\\r]+[\\dIVXLC]+\\b') AS h, regexp_matches(text, '(?i)^(VOLUME|PART)\\b') AS v FROM para),
    c AS (SELECT *, sum(h::INT) OVER (PARTITION BY book_id ORDER BY seq) AS seen, sum(h::INT) OVER (PARTITION BY book_id) AS total FROM h)
    SELECT book_id, seq, greatest(0, seen - 1)::INT AS chapter FROM c WHERE (total = 0 OR (seen > 0 AND NOT h)) AND NOT (total > 0 AND v)""",
)
def text_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """The chapter of each paragraph of books read as plain texts, from their headings alone."""
    rows = _paragraphs(spark, folder).select(F.col("book_id").alias("path"), F.col("seq").alias("idx"), "text")
    return B.text_chapters(rows).select(F.col("path").alias("book_id"), F.col("idx").alias("seq"), "chapter")


@FILES.add("json_roundtrip", "SELECT rec_id, display_name, len(aliases) AS aliases, line_count FROM manifest_characters")
def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Records as lines of JSON, and read back."""
    path = f"{_shared(spark)}/json"
    table(spark, folder, "manifest_characters").select("rec_id", "display_name", "aliases", "line_count").write.json(path)
    read = X.json_lines(spark, path, "rec_id bigint, display_name string, aliases array<string>, line_count int")
    return read.select("rec_id", "display_name", F.size("aliases").cast("bigint").alias("aliases"), "line_count")


@FILES.add(
    "manifest_roundtrip",
    """SELECT book_id, count(*) AS characters, sum(greatest(coalesce(line_count, 0), 0))::BIGINT AS lines, count(*) FILTER (WHERE upper(gender) = 'FEMALE') AS female FROM manifest_characters WHERE book_id IS NOT NULL AND char_id IS NOT NULL GROUP BY 1""",
)
def manifest_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The cast of every book as a manifest in JSON, checked as it is read back."""
    cast = table(spark, folder, "manifest_characters").where("book_id IS NOT NULL AND char_id IS NOT NULL")
    voice = F.lit(None).cast(f"struct<{M.VOICE}>").alias("voice")

    def character(*columns: Column) -> Column:
        return F.struct(*columns).cast(f"struct<{M.CHARACTER}>")

    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    one = character(F.col("char_id"), F.col("display_name"), F.col("aliases"), F.upper("gender"), F.upper("age_band"), F.col("traits"), confidence, F.col("first_seen_locator"), F.greatest(F.lit(0), F.coalesce("line_count", F.lit(0))), voice)
    narrator = character(*map(F.lit, ["narrator", "Narrator"]), F.array().cast("array<string>"), F.lit("NEUTRAL"), F.lit("ADULT"), F.array().cast("array<string>"), F.lit(1.0), F.lit(None).cast("string"), F.lit(0), voice)
    grouped = cast.groupBy("book_id").agg(F.collect_list(one).alias("people"))
    manifest = F.struct(F.lit(1), F.col("book_id"), F.lit(0).cast("bigint"), narrator, F.col("people")).cast(f"struct<{M.MANIFEST}>")
    read = M.decoded(grouped.select("book_id", M.encoded(manifest).alias("json")))
    people = F.col("manifest")["characters"]
    lines = F.aggregate(people, F.lit(0).cast("bigint"), lambda t, c: t + c["lineCount"])
    return read.select("book_id", F.size(people).cast("bigint").alias("characters"), lines.alias("lines"), F.size(F.filter(people, lambda c: F.upper(c["gender"]) == "FEMALE")).cast("bigint").alias("female"))


@FILES.add(
    "index_tables",
    f"""WITH {S.PARAGRAPHS}, p AS (SELECT book_id, count(*) AS n FROM (SELECT DISTINCT book_id, seq, unnest(generate_series(1, least(6, len(string_split(f, ' '))))) AS k FROM (SELECT book_id, seq, {S.full_form('text')} AS f FROM para)) GROUP BY 1),
    s AS (SELECT book_id, count(*) AS n FROM (SELECT DISTINCT book_id, seq, ordinal, span_start, span_end FROM spans WHERE book_id IS NOT NULL) GROUP BY 1)
    SELECT b.book_id, b.title, (SELECT count(*) FROM para WHERE para.book_id = b.book_id) AS entries, coalesce(s.n, 0) AS spans, coalesce(p.n, 0) AS openings FROM books b LEFT JOIN s USING (book_id) LEFT JOIN p USING (book_id)""",
)
def index_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The four tables of an index as they are read back, counted by book."""
    from loomtext.functions.text import fnv64_batched, full_form, openings

    path = f"{_shared(spark)}/index"
    paras = _paragraphs(spark, folder)
    heads = paras.select("book_id", "seq", F.explode(openings(full_form(F.col("text")))).alias("p")).select("book_id", fnv64_batched("p").alias("prefix_hash"), "seq")
    spans = table(spark, folder, "spans").where("book_id IS NOT NULL").select("book_id", "seq", "ordinal", "span_start", "span_end").distinct()
    books = table(spark, folder, "books").select("book_id", "title", F.lit(K.INDEX_VERSION).alias("schema_version"))
    K.write_index(path, books, paras.select("book_id", "seq", "text", "chapter"), spans, heads)
    index = K.read_index(spark, path)
    counts = [index[name].groupBy("book_id").agg(F.count("*").alias(to)) for name, to in (("entries", "entries"), ("spans", "spans"), ("prefixes", "openings"))]
    out = index["books"].select("book_id", "title")
    for c in counts:
        out = out.join(c, "book_id", "left")
    return out.select("book_id", "title", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("entries", "spans", "openings")])


@FILES.add(
    "scripts",
    f"""WITH {S.SEGMENTS} SELECT book_id, chapter, count(*)::INT AS lines, arg_min(run, (seq, n)) AS first_text, sum(length(run))::BIGINT AS characters FROM seg GROUP BY ALL""",
)
def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """A script in JSON for every chapter, and what a reader of it finds."""
    rows = segments(_paragraphs(spark, folder)).select("book_id", "chapter", "seq", "n", F.col("kind").alias("speaker"), F.col("run").alias("text"))
    made = K.script_json(rows, ["book_id", "chapter"])
    lines = F.from_json("script", "lines array<struct<seq: int, n: int, speaker: string, text: string>>")["lines"]
    read = made.select("book_id", "chapter", lines.alias("l"))
    return read.select("book_id", "chapter", F.size("l").alias("lines"), F.col("l")[0]["text"].alias("first_text"), F.aggregate("l", F.lit(0).cast("bigint"), lambda t, x: t + F.length(x["text"])).alias("characters"))


@FILES.add(
    "dumped_questions",
    f"WITH {S.SEGMENTS} SELECT book_id, seq, n, run AS text FROM seg WHERE kind = 'DIALOGUE'",
)
def dumped_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The questions of a dump for outside candidates as they read them: without the truth."""
    path = f"{_shared(spark)}/dump"
    paras = _paragraphs(spark, folder)
    questions = segments(paras).where("kind = 'DIALOGUE'").select("book_id", "seq", "n", F.col("run").alias("text"), F.lit("?").alias("speaker"))
    cast = table(spark, folder, "manifest_characters").select("book_id", "char_id", "display_name")
    K.bakeoff_dump(path, paras.select("book_id", "seq", "text"), paras.select("book_id", "chapter").distinct(), questions, cast)
    read = spark.read.json(f"{path}/questions")
    return read.select("book_id", F.col("seq").cast("int").alias("seq"), F.col("n").cast("int").alias("n"), *[c for c in read.columns if c not in ("book_id", "seq", "n")])


@FILES.add(
    "file_names",
    """SELECT DISTINCT display_name, array_to_string(list_transform(string_split(display_name, ''), lambda c: CASE WHEN regexp_matches(c, '[\\pL\\pN_-]') THEN c ELSE printf('%%%02X', unicode(c)) END), '') || '.characters.json' AS file
    FROM manifest_characters WHERE display_name IS NOT NULL AND display_name <> ''""",
)
def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """A file name for every display name."""

    @F.pandas_udf("string")
    def named(names: pd.Series) -> pd.Series:
        return names.map(B.file_name)

    names = table(spark, folder, "manifest_characters").where("display_name IS NOT NULL AND display_name <> ''").select("display_name").distinct()
    return names.select("display_name", named("display_name").alias("file"))


@FILES.add("span_bytes", f"WITH {_QUOTED} SELECT id, length(text)::INT AS characters FROM q")
def span_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """The number of characters of every quotation found from the number of its bytes."""
    quotes = segments(_paragraphs(spark, folder)).where("kind = 'DIALOGUE'").select(F.concat_ws("/", "book_id", "seq", "n").alias("id"), _flat("run").alias("t"))
    return quotes.select("id", char_of_byte(F.col("t"), F.octet_length("t")).cast("int").alias("characters"))
