"""Queries on the index of books and on chunks that a reading app sends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import full_form
from loomtext.operators import matching as M
from loomtext.operators.attribution import by_rules
from loomtext.operators.ordered import running_max, running_sum
from loomtext.operators.segments import paragraphs, segments
from loomtext.plans import sqltext as S
from loomtext.plans.registry import Registry
from loomtext.plans.speech import _RULES
from loomtext.session import checkpointed
from loomtext.sources.tables import table

LIBRARY = Registry()


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs(table(spark, folder, "entries"))


def _placed(where: str) -> str:
    return f"""
sen0 AS (SELECT book_id, seq, text, {S.index_sentences('text')} AS s FROM {where}),
sen1 AS (SELECT book_id, seq, text, s, list_reduce(list_prepend({{'s': '', 'p': [0]}}, list_transform(s, lambda x: {{'s': x, 'p': [0]}})),
  lambda a, b: {{'s': b.s, 'p': list_append(list_append(a.p, CASE WHEN instr(text[a.p[-1] + 1:], b.s) > 0 THEN a.p[-1] + instr(text[a.p[-1] + 1:], b.s) - 1 ELSE a.p[-1] END),
    CASE WHEN instr(text[a.p[-1] + 1:], b.s) > 0 THEN a.p[-1] + instr(text[a.p[-1] + 1:], b.s) - 1 ELSE a.p[-1] END + length(b.s))}}).p AS p FROM sen0 WHERE len(s) > 0),
sen AS (SELECT book_id, seq, (i - 1)::INT AS i, s[i] AS sentence, p[2 * i]::INT AS a, p[2 * i + 1]::INT AS b FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM sen1))"""


@LIBRARY.add("sentence_places", f"WITH {S.PARAGRAPHS}, {_placed('para')} SELECT book_id, seq, i, a AS sent_from, b AS sent_to FROM sen")
def sentence_places(spark: SparkSession, folder: str) -> DataFrame:
    """Where each index sentence lies in its paragraph."""
    placed = _paragraphs(spark, folder).select("book_id", "seq", F.posexplode(M.placed_sentences(F.col("text"))).alias("i", "p"))
    return placed.select("book_id", "seq", "i", F.col("p.start").alias("sent_from"), F.col("p.end").alias("sent_to"))


@LIBRARY.add(
    "entry_assembly",
    f"""WITH {_RULES}, {_placed('para')},
    clip AS (SELECT s.book_id, s.seq, s.i, greatest(a, run_start) - a AS x, least(b, run_start + length(run)) - a AS y, kind, speaker_id, confidence
      FROM sen s JOIN lines l ON s.book_id = l.book_id AND s.seq = l.seq AND least(b, run_start + length(run)) > greatest(a, run_start))
    SELECT s.book_id, s.seq, s.i, sentence, coalesce(x, 0)::INT AS span_start, coalesce(y, length(sentence))::INT AS span_end, coalesce(kind, 'NARRATION') AS kind, speaker_id, coalesce(confidence, 0)::DOUBLE AS confidence
    FROM sen s LEFT JOIN clip c ON s.book_id = c.book_id AND s.seq = c.seq AND s.i = c.i""",
)
def entry_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries with their voice spans."""
    paras = _paragraphs(spark, folder)
    return M.entry_spans(paras, by_rules(segments(paras), table(spark, folder, "manifest_characters")))


@LIBRARY.add("dense_entries", f"WITH {S.PARAGRAPHS} SELECT book_id, seq, (row_number() OVER (PARTITION BY book_id ORDER BY seq) - 1)::BIGINT AS place FROM para")
def dense_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries numbered anew from 0."""
    return running_sum(_paragraphs(spark, folder), ["book_id"], "seq", F.lit(1), "place").select("book_id", "seq", (F.col("place") - 1).alias("place"))


_FORMS = f"""{S.PARAGRAPHS}, held AS (SELECT book_id, seq, {S.full_form('text')} AS form FROM para),
asked AS (SELECT chunk_id, session_id, utterance, book_id, {S.full_form('text')} AS form FROM host_trace WHERE text IS NOT NULL AND book_id IS NOT NULL)"""


@LIBRARY.add(
    "relocate_chunks",
    f"""WITH {_FORMS}, d AS (SELECT DISTINCT book_id, form FROM asked WHERE form <> ''),
    f AS (SELECT d.book_id, d.form, min(seq) AS seq FROM d JOIN held h ON d.book_id = h.book_id AND h.form <> '' AND (starts_with(h.form || ' ', d.form || ' ') OR starts_with(d.form || ' ', h.form || ' ')) GROUP BY ALL)
    SELECT chunk_id, book_id, seq FROM asked JOIN f USING (book_id, form)""",
)
def relocate_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The first entry of the book that each chunk can lie at."""
    chunks = table(spark, folder, "host_trace").where("text IS NOT NULL AND book_id IS NOT NULL").select("chunk_id", "book_id", full_form(F.col("text")).alias("form"))
    held = _paragraphs(spark, folder).select("book_id", "seq", full_form(F.col("text")).alias("form"))
    return M.relocate(chunks, held)


@LIBRARY.add("match_cursor")
def match_cursor(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk placed by its session's cursor."""
    chunks = table(spark, folder, "host_trace").select("session_id", "book_id", "chunk_id", "utterance", "text")
    read = chunks.where("text IS NOT NULL").select("book_id").distinct()
    held = paragraphs(table(spark, folder, "entries").join(read, "book_id", "left_semi"))
    return M.follow(chunks, held.select("book_id", "seq", "text"))


_HITS = f"""{S.PARAGRAPHS}, held AS (SELECT book_id, seq, {S.full_form('text')} AS form FROM para),
said AS (SELECT DISTINCT session_id, utterance, {S.full_form('text')} AS form FROM host_trace WHERE text IS NOT NULL),
asked_at AS (SELECT form, array_to_string(w[1:k], ' ') AS o FROM (SELECT form, w, unnest(generate_series(1, least(6, len(w)))) AS k FROM (SELECT DISTINCT form, string_split(form, ' ') AS w FROM said WHERE form <> ''))),
held_at AS (SELECT form, array_to_string(w[1:k], ' ') AS o FROM (SELECT form, w, unnest(generate_series(1, least(6, len(w)))) AS k FROM (SELECT DISTINCT form, string_split(form, ' ') AS w FROM held WHERE form <> ''))),
met AS (SELECT DISTINCT a.form AS asked, h.form AS held FROM asked_at a JOIN held_at h USING (o)
  WHERE starts_with(h.form || ' ', a.form || ' ') OR starts_with(a.form || ' ', h.form || ' ')),
found AS (SELECT DISTINCT asked AS form, book_id, indexed_at FROM met JOIN held ON held.form = met.held JOIN books USING (book_id))"""


@LIBRARY.add(
    "identify_lock",
    f"""WITH {_HITS}, u AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY utterance) AS i FROM said WHERE session_id IS NOT NULL AND utterance IS NOT NULL),
    h AS (SELECT DISTINCT session_id, utterance, i, book_id, indexed_at FROM u JOIN found USING (form)),
    r AS (SELECT a.* FROM h a JOIN h b ON a.session_id = b.session_id AND a.book_id = b.book_id AND b.i = a.i - 1 JOIN h c ON a.session_id = c.session_id AND a.book_id = c.book_id AND c.i = a.i - 2)
    SELECT session_id, arg_min(book_id, (utterance, -indexed_at, book_id)) AS book_id, min(utterance) AS locked_at FROM r GROUP BY 1""",
)
def identify_lock(spark: SparkSession, folder: str) -> DataFrame:
    """The book that each session locks on to, of all books, and at which utterance; the newest book wins a tie."""
    trace = table(spark, folder, "host_trace").where("text IS NOT NULL").select("session_id", "utterance", full_form(F.col("text")).alias("form"))
    return M.first_locks(trace, checkpointed(chunk_books(spark, folder)), table(spark, folder, "books"))


def chunk_books(spark: SparkSession, folder: str) -> DataFrame:
    """``form``, ``book_id``: the normal form of every chunk, named book or not, with each book that it can lie in."""
    forms = table(spark, folder, "host_trace").where("text IS NOT NULL").select(full_form(F.col("text")).alias("form"))
    return M.found_in(forms, _paragraphs(spark, folder).select("book_id", full_form(F.col("text")).alias("form")))


@LIBRARY.add(
    "segment_plan",
    """WITH t AS (SELECT book_id, seq, length(arg_min(text, entry_id)) AS len FROM entries WHERE text IS NOT NULL AND book_id IS NOT NULL AND seq IS NOT NULL GROUP BY ALL),
    s AS (SELECT DISTINCT book_id, seq, ordinal, span_start, span_end, speaker_id FROM spans WHERE span_start < span_end),
    o AS (SELECT s.*, len, least(max(span_end) OVER w, len) AS covered, lead(span_start) OVER (PARTITION BY s.book_id, s.seq ORDER BY span_start, ordinal, span_end, speaker_id) IS NULL AS final FROM s JOIN t USING (book_id, seq)
      WINDOW w AS (PARTITION BY s.book_id, s.seq ORDER BY span_start, ordinal, span_end, speaker_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p AS (SELECT book_id, seq, speaker_id, coalesce(covered, 0) AS plan_start, CASE WHEN final THEN len ELSE greatest(least(span_end, len), coalesce(covered, 0)) END AS plan_end FROM o)
    SELECT book_id, seq, plan_start::INT AS plan_start, plan_end::INT AS plan_end, speaker_id FROM p WHERE plan_end > plan_start""",
)
def segment_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Each entry cut into stretches of one voice: what lies between spans joins the one that follows, the last runs to the end."""
    entries = table(spark, folder, "entries").where("text IS NOT NULL AND book_id IS NOT NULL AND seq IS NOT NULL")
    sizes = entries.groupBy("book_id", "seq").agg(F.min(F.struct("entry_id", F.length("text").alias("len"))).alias("e")).select("book_id", "seq", "e.len")
    spans = table(spark, folder, "spans").where("span_start < span_end").select("book_id", "seq", "ordinal", "span_start", "span_end", "speaker_id").distinct()
    rows = spans.join(sizes, ["book_id", "seq"])
    rank = ["ordinal", "span_end", "speaker_id"]
    covered = running_max(rows, ["book_id", "seq"], "span_start", F.col("span_end"), "covered", then=rank)
    last = rows.groupBy("book_id", "seq").agg(F.max(F.struct("span_start", "ordinal", "span_end", F.coalesce("speaker_id", F.lit("￿")).alias("w"))).alias("last"))
    here = F.struct("span_start", "ordinal", "span_end", F.coalesce("speaker_id", F.lit("￿")).alias("w"))
    start = F.coalesce(F.least("covered", "len"), F.lit(0))
    end = F.when(here == F.col("last"), F.col("len")).otherwise(F.greatest(F.least("span_end", "len"), start))
    plan = covered.join(last, ["book_id", "seq"]).select("book_id", "seq", start.cast("int").alias("plan_start"), end.cast("int").alias("plan_end"), "speaker_id")
    return plan.where("plan_end > plan_start")


@LIBRARY.add(
    "span_voices",
    """SELECT DISTINCT s.book_id, s.seq, s.ordinal, coalesce(m.display_name, 'narrator') AS voiced_by, coalesce(m.display_name <> 'narrator', false) AS cast_member
    FROM spans s LEFT JOIN (SELECT book_id, char_id, arg_min(display_name, rec_id) AS display_name FROM manifest_characters WHERE display_name IS NOT NULL GROUP BY ALL) m
    ON s.book_id = m.book_id AND s.speaker_id = m.char_id""",
)
def span_voices(spark: SparkSession, folder: str) -> DataFrame:
    """Each span's character, else the narrator."""
    named = table(spark, folder, "manifest_characters").where("display_name IS NOT NULL").groupBy("book_id", F.col("char_id").alias("speaker_id")).agg(F.min_by("display_name", "rec_id").alias("display_name"))
    spans = table(spark, folder, "spans").select("book_id", "seq", "ordinal", "speaker_id").distinct()
    return spans.join(named, ["book_id", "speaker_id"], "left").select(
        "book_id", "seq", "ordinal", F.coalesce("display_name", F.lit("narrator")).alias("voiced_by"), F.coalesce(F.col("display_name") != "narrator", F.lit(False)).alias("cast_member")
    ).distinct()


@LIBRARY.add(
    "paragraph_of_span",
    """WITH e AS (SELECT book_id, seq, sum(len) OVER (PARTITION BY book_id ORDER BY seq) - len AS from_char, len FROM
      (SELECT book_id, seq, length(coalesce(arg_min(text, entry_id), '')) + 1 AS len FROM entries WHERE book_id IS NOT NULL AND seq IS NOT NULL GROUP BY ALL)),
    q AS (SELECT DISTINCT book_id, from_char + 3 AS at FROM e WHERE len > 4)
    SELECT q.book_id, q.at::BIGINT AS at, e.seq FROM q JOIN e ON q.book_id = e.book_id AND q.at >= e.from_char AND q.at < e.from_char + e.len""",
)
def paragraph_of_span(spark: SparkSession, folder: str) -> DataFrame:
    """The paragraph in which each of a set of places of the running text of a book lies: an as-of join through blocks of places."""
    entries = table(spark, folder, "entries").where("book_id IS NOT NULL AND seq IS NOT NULL")
    sizes = entries.groupBy("book_id", "seq").agg(F.min(F.struct("entry_id", (F.length(F.coalesce("text", F.lit(""))) + 1).alias("len"))).alias("e")).select("book_id", "seq", "e.len")
    placed = running_sum(sizes, ["book_id"], "seq", F.col("len"), "upto").withColumn("from_char", F.col("upto") - F.col("len"))
    asked = placed.where("len > 4").select("book_id", (F.col("from_char") + 3).alias("at")).distinct()
    block = 4096
    covers = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("from_char") / block), F.floor((F.col("upto") - 1) / block))))
    met = asked.withColumn("block", F.floor(F.col("at") / block)).join(covers, ["book_id", "block"])
    return met.where((F.col("at") >= F.col("from_char")) & (F.col("at") < F.col("upto"))).select("book_id", "at", "seq")


@LIBRARY.add("chapters", "SELECT DISTINCT book_id, chapter FROM entries WHERE chapter IS NOT NULL ORDER BY 1, 2")
def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """The chapters of every book in order."""
    return table(spark, folder, "entries").where("chapter IS NOT NULL").select("book_id", "chapter").distinct().orderBy("book_id", "chapter")


@LIBRARY.add("silence_flags", f"WITH {S.SEGMENTS} SELECT book_id, seq, n, coalesce(lag(seq) OVER (PARTITION BY book_id, chapter ORDER BY seq, n) <> seq, false) AS silence FROM seg")
def silence_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Runs before which a pause belongs: those that open another paragraph of their chapter."""
    from loomtext.operators.ordered import neighbour

    runs = segments(_paragraphs(spark, folder)).select("book_id", "chapter", "seq", "n")
    before = neighbour(runs, ["book_id", "chapter"], "seq", F.col("seq"), "last", step=-1, then=["n"])
    return before.select("book_id", "seq", "n", F.coalesce(F.col("last") != F.col("seq"), F.lit(False)).alias("silence"))


@LIBRARY.add("duplicate_characters", "SELECT book_id, char_id, count(*) AS records FROM manifest_characters GROUP BY ALL HAVING count(*) > 1")
def duplicate_characters(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that a book's cast has more than once."""
    return table(spark, folder, "manifest_characters").groupBy("book_id", "char_id").agg(F.count("*").alias("records")).where("records > 1")
