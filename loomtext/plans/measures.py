"""Queries on playback, candidates, samples and measures of a reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import WIDE_ABBREVIATIONS, index_sentences, unquoted
from loomtext.operators import casting as C
from loomtext.operators import playback as P
from loomtext.operators import sampling as Z
from loomtext.operators.segments import paragraphs, segments
from loomtext.plans import sqltext as S
from loomtext.plans.cast import _SPLIT, _SCENED, scene_split
from loomtext.plans.dialogue import _SPOKEN, spoken_lines
from loomtext.plans.registry import Registry
from loomtext.plans.sound import SOUND
from loomtext.operators.scenes import with_scenes
from loomtext.sources.tables import table

MEASURES = Registry()


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs(table(spark, folder, "entries"))


@MEASURES.add(
    "utterance_events",
    f"""WITH c AS (SELECT chunk_id, text, list_filter(string_split_regex(text, '{S.WHITE}'), lambda w: w <> '') AS w FROM host_trace WHERE text IS NOT NULL)
    SELECT chunk_id, count(*) AS events, sum((k = 'range')::INT)::BIGINT AS ranges, max(i)::INT AS last FROM (
      SELECT chunk_id, unnest(e) AS k, unnest(range(len(e))) AS i FROM (SELECT chunk_id, list_concat(['started'], list_transform(w, lambda x: 'range'), CASE WHEN len(w) > 0 THEN ['audio'] ELSE [] END, ['done']) AS e FROM c)) GROUP BY 1""",
)
def utterance_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of every chunk as it is spoken, counted."""
    events = P.utterance_events(table(spark, folder, "host_trace"), "chunk_id")
    return events.groupBy("chunk_id").agg(F.count("*").alias("events"), F.count_if(F.col("event") == "range").alias("ranges"), F.max("i").alias("last"))


_STEPS = "st AS (SELECT session_id, utterance, min(length(text) % 7 + utterance)::INT AS place FROM host_trace WHERE session_id IS NOT NULL AND utterance IS NOT NULL AND text IS NOT NULL GROUP BY ALL)"


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    """A reader's way through sentences, with steps ahead and back."""
    chunks = table(spark, folder, "host_trace").where("session_id IS NOT NULL AND utterance IS NOT NULL AND text IS NOT NULL")
    return chunks.groupBy("session_id", "utterance").agg(F.min(F.length("text") % 7 + F.col("utterance")).cast("int").alias("place"))


@MEASURES.add(
    "prefetch_plan",
    f"""WITH {_STEPS}, w AS (SELECT *, place - lag(place) OVER (PARTITION BY session_id ORDER BY utterance) AS went FROM st),
    k AS (SELECT *, CASE WHEN went BETWEEN 0 AND 2 THEN 3 - went ELSE 0 END AS kept FROM w)
    SELECT session_id, utterance, place, (3 - kept)::INT AS loads, CASE WHEN went IS NULL THEN 0 ELSE 3 - kept END::INT AS drops, coalesce(NOT went BETWEEN 0 AND 2, true) AS seek FROM k""",
)
def prefetch_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What is synthesized ahead and what is dropped at each step of a reader."""
    return P.prefetched(_steps(spark, folder), ["session_id"], "utterance", "place")


@MEASURES.add(
    "fallback_announced",
    f"""WITH {_STEPS}, s AS (SELECT *, CASE WHEN place % 3 = 0 THEN 'local' ELSE 'primary' END AS source FROM st)
    SELECT session_id, utterance, CASE WHEN source = 'primary' THEN place ELSE -1 END AS value, source, source = 'local' AND lag(source) OVER (PARTITION BY session_id ORDER BY utterance) IS DISTINCT FROM 'local' AS announced FROM s""",
)
def fallback_announced(spark: SparkSession, folder: str) -> DataFrame:
    """A reader whose first voice fails at times: the local one steps in, announced once each time."""
    primary = F.when(F.col("place") % 3 != 0, F.col("place"))
    return P.with_fallback(_steps(spark, folder), ["session_id"], "utterance", primary, F.lit(-1)).drop("place")


@MEASURES.add(
    "answers_completed",
    f"""WITH {_SPOKEN}, q AS (SELECT book_id, seq, count(*)::INT AS asked, count(*) FILTER (WHERE truth IS NULL) = 0 AS named FROM spoken WHERE kind = 'DIALOGUE' GROUP BY ALL)
    SELECT book_id, seq, CASE WHEN seq % 4 <> 0 THEN 1 ELSE 2 END AS attempt, asked AS answers FROM q WHERE named AND (seq % 4 <> 0 OR seq % 8 <> 0)""",
)
def answers_completed(spark: SparkSession, folder: str) -> DataFrame:
    """Replies of a model to the quotations of each entry, some of them cut short: what has the shape at once, or when asked again."""
    line = F.struct(F.col("n").alias("index"), F.col("truth").alias("speaker"), F.lit(0.5).alias("confidence"))
    asked = spoken_lines(spark, folder).where("kind = 'DIALOGUE'").groupBy("book_id", "seq").agg(F.count("*").cast("int").alias("asked"), F.collect_list(line).alias("answers"))
    whole = F.to_json(F.struct("answers"))
    cut = F.substr(whole, F.lit(1), F.length(whole) - 2)
    replies = asked.select("book_id", "seq", "asked", F.when(F.col("seq") % 4 != 0, whole).otherwise(cut).alias("first"), F.when(F.col("seq") % 8 != 0, whole).otherwise(F.lit("no idea")).alias("second"))
    done = replies.select("book_id", "seq", P.completed(F.col("first"), F.col("second"), F.col("asked")).alias("c")).where("c IS NOT NULL")
    return done.select("book_id", "seq", "c.attempt", F.size("c.answers").alias("answers"))


@MEASURES.add("opinion_scores", "SELECT book_id, round(avg(1 + 4 * confidence), 4) AS mean, round(avg(1 + 4 * confidence), 4) >= 3.5 AS passes FROM spans WHERE confidence IS NOT NULL GROUP BY 1")
def opinion_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The readers' confidences as opinion scores from 1 to 5 of each book, and whether they pass."""
    scored = table(spark, folder, "spans").where("confidence IS NOT NULL").groupBy("book_id").agg(P.mean_opinion(1 + 4 * F.col("confidence")).alias("o"))
    return scored.select("book_id", "o.mean", "o.passes")


@MEASURES.add(
    "battery_drain",
    """WITH h AS (SELECT user_id, count(*) AS readings, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000 AS minutes FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1)
    SELECT user_id, readings, CASE WHEN minutes > 0 THEN round((a - b) * 60 / minutes, 4) END AS drain FROM h""",
)
def battery_drain(spark: SparkSession, folder: str) -> DataFrame:
    """The loss an hour between the first and the last value of each user, the values taken as readings of a charge."""
    rows = table(spark, folder, "events").where("value IS NOT NULL AND ts IS NOT NULL")
    when = F.struct("ts", "event_id")
    ends = rows.groupBy("user_id").agg(
        F.count("*").alias("readings"), F.min_by("value", when).alias("a"), F.max_by("value", when).alias("b"), ((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 60_000_000).alias("minutes")
    )
    return ends.select("user_id", "readings", P.drain_per_hour(F.col("a"), F.col("b"), F.col("minutes")).alias("drain"))


@MEASURES.add("dialogue_characters", "SELECT book_id, sum(greatest(line_count, 0)::BIGINT * 60)::BIGINT AS characters FROM manifest_characters WHERE line_count IS NOT NULL GROUP BY 1")
def dialogue_characters(spark: SparkSession, folder: str) -> DataFrame:
    """The characters of speech to be expected of every book, sixty for each line of its cast."""
    rows = table(spark, folder, "manifest_characters").where("line_count IS NOT NULL")
    return rows.groupBy("book_id").agg(F.sum(F.greatest("line_count", F.lit(0)).cast("bigint") * 60).alias("characters"))


@MEASURES.add(
    "voice_ids",
    """WITH c AS (SELECT DISTINCT book_id, char_id FROM manifest_characters WHERE book_id IS NOT NULL AND char_id IS NOT NULL)
    SELECT book_id, char_id, (100 + (row_number() OVER (PARTITION BY book_id ORDER BY char_id) - 1) * (780 // count(*) OVER (PARTITION BY book_id)))::INT AS voice FROM c""",
)
def voice_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A voice's number for everyone of a cast, evenly spread."""
    cast = table(spark, folder, "manifest_characters").where("book_id IS NOT NULL AND char_id IS NOT NULL").select("book_id", "char_id").distinct()
    listed = cast.groupBy("book_id").agg(F.array_sort(F.collect_list("char_id")).alias("l")).select("book_id", F.size("l").alias("n"), F.posexplode("l").alias("i", "char_id"))
    return listed.select("book_id", "char_id", P.spread_ids(F.col("i"), F.col("n")).alias("voice"))


_AGED = "CASE WHEN f0_hz >= 200 THEN 'CHILD' WHEN f0_hz >= 110 THEN 'ADULT' WHEN f0_hz IS NOT NULL THEN 'ELDER' END"


@MEASURES.add(
    "voice_candidates",
    f"""WITH p AS (SELECT speaker, CASE voice WHEN 'male' THEN 'MALE' WHEN 'female' THEN 'FEMALE' END AS gender, {_AGED} AS age FROM voices WHERE speaker IS NOT NULL),
    ex AS (SELECT gender, age, count(DISTINCT speaker) AS n, min(speaker) AS f FROM p WHERE gender IS NOT NULL AND age IS NOT NULL GROUP BY ALL), sa AS (SELECT gender, count(DISTINCT speaker) AS n, min(speaker) AS f FROM p WHERE gender IS NOT NULL GROUP BY ALL),
    al AS (SELECT count(DISTINCT speaker) AS n, min(speaker) AS f FROM p), m AS (SELECT rec_id, upper(gender) AS gender, upper(age_band) AS age FROM manifest_characters)
    SELECT rec_id, coalesce(ex.n, sa.n, al.n)::INT AS candidates, coalesce(ex.f, sa.f, al.f) AS first FROM m CROSS JOIN al LEFT JOIN ex ON m.gender = ex.gender AND m.age = ex.age LEFT JOIN sa ON m.gender = sa.gender""",
)
def voice_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The voices that everyone may get: of the same gender and age, else gender, else all."""
    voices = table(spark, folder, "voices").where("speaker IS NOT NULL")
    gender = F.when(F.col("voice") == "male", "MALE").when(F.col("voice") == "female", "FEMALE")
    pool = voices.select("speaker", gender.alias("gender"), F.expr(_AGED).alias("age"))
    people = table(spark, folder, "manifest_characters").select("rec_id", F.upper("gender").alias("gender"), F.upper("age_band").alias("age"))
    return C.candidates_for(people, pool).select("rec_id", F.size("candidates").alias("candidates"), F.col("candidates")[0].alias("first"))


@MEASURES.add(
    "cast_assembled",
    f"""WITH {_SPOKEN}, m AS (SELECT book_id, char_id, count(*) AS mentions FROM manifest_characters WHERE book_id IS NOT NULL AND char_id IS NOT NULL GROUP BY ALL),
    s AS (SELECT book_id, truth AS char_id, count(*) AS lines FROM spoken WHERE kind = 'DIALOGUE' AND truth IS NOT NULL GROUP BY ALL)
    SELECT book_id, char_id, coalesce(lines, 0)::BIGINT AS lines, coalesce(mentions, 0)::BIGINT AS mentions, CASE WHEN lines IS NOT NULL THEN 1.0 ELSE 0.4 END::DOUBLE AS confidence
    FROM m FULL JOIN s USING (book_id, char_id) WHERE lines IS NOT NULL OR mentions >= 3""",
)
def cast_assembled(spark: SparkSession, folder: str) -> DataFrame:
    """Speakers and those noted at least three times in one cast; who is neither walks on and is left out."""
    noted = table(spark, folder, "manifest_characters").where("book_id IS NOT NULL AND char_id IS NOT NULL").groupBy("book_id", "char_id").agg(F.count("*").alias("mentions"))
    spoke = spoken_lines(spark, folder).where("kind = 'DIALOGUE' AND truth IS NOT NULL").groupBy("book_id", F.col("truth").alias("char_id")).agg(F.count("*").alias("lines"))
    both = noted.join(spoke, ["book_id", "char_id"], "full").where("lines IS NOT NULL OR mentions >= 3")
    confidence = F.when(F.col("lines").isNotNull(), 1.0).otherwise(0.4).alias("confidence")
    return both.select("book_id", "char_id", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("mentions", F.lit(0)).alias("mentions"), confidence)


@MEASURES.add("scorable_labels", "SELECT file_name, count(*) AS lines, count(*) FILTER (WHERE f <> '' AND NOT starts_with(f, '_')) AS scorable FROM (SELECT file_name, trim(coalesce(string_split(raw_line, ',')[5], '')) AS f FROM labels_raw WHERE raw_line IS NOT NULL) GROUP BY 1")
def scorable_labels(spark: SparkSession, folder: str) -> DataFrame:
    """How many label lines of each file name someone who can be scored: not nobody, and no stand-in with a leading underscore."""
    rows = table(spark, folder, "labels_raw").where("raw_line IS NOT NULL")
    speaker = F.trim(F.coalesce(F.get(F.split("raw_line", ",", -1), 4), F.lit("")))
    return rows.groupBy("file_name").agg(F.count("*").alias("lines"), F.count_if((speaker != "") & ~F.startswith(speaker, F.lit("_"))).alias("scorable"))


@MEASURES.add(
    "scene_report",
    f"""WITH RECURSIVE {_SPLIT}, pieces AS (SELECT book_id, count(*) AS pieces, round(avg((NOT clean)::INT), 6) AS mid_exchange FROM bounds GROUP BY 1),
    qs AS (SELECT s.book_id, s.scene_start, count(q.n) AS quotes FROM scened s LEFT JOIN seg q ON s.book_id = q.book_id AND s.seq = q.seq AND q.kind = 'DIALOGUE' GROUP BY ALL)
    SELECT book_id, scenes, quotes, round(quotes / scenes, 6) AS quotes_per_scene, pieces, mid_exchange FROM (SELECT book_id, count(*) AS scenes, sum(quotes)::BIGINT AS quotes FROM qs GROUP BY 1) JOIN pieces USING (book_id)""",
)
def scene_report(spark: SparkSession, folder: str) -> DataFrame:
    """Scenes, quotations and pieces of every book, and the share of pieces that open in the middle of an exchange."""
    paras = _paragraphs(spark, folder)
    said = segments(paras).where("kind = 'DIALOGUE'").groupBy("book_id", "seq").agg(F.count("*").alias("q"))
    placed = with_scenes(paras.join(said, ["book_id", "seq"], "left"))
    scenes = placed.groupBy("book_id", "scene_at").agg(F.sum(F.coalesce("q", F.lit(0))).alias("quotes")).groupBy("book_id").agg(F.count("*").alias("scenes"), F.sum("quotes").alias("quotes"))
    pieces = scene_split(spark, folder).groupBy("book_id").agg(F.count("*").alias("pieces"), F.round(F.avg((~F.col("at_turn_boundary")).cast("int")), 6).alias("mid_exchange"))
    return scenes.join(pieces, "book_id").select("book_id", "scenes", "quotes", F.round(F.col("quotes") / F.col("scenes"), 6).alias("quotes_per_scene"), "pieces", "mid_exchange")


@MEASURES.add(
    "gender_score",
    """WITH n AS (SELECT book_id, lower(display_name) AS name, upper(gender) AS gender FROM manifest_characters WHERE book_id IS NOT NULL AND display_name IS NOT NULL),
    gold AS (SELECT book_id, name, max(gender) FILTER (gender IN ('MALE', 'FEMALE')) AS gold FROM n GROUP BY ALL), said AS (SELECT book_id, lower(unnest(cast_names)) AS name FROM documents WHERE book_id IS NOT NULL),
    found AS (SELECT DISTINCT book_id, name, CASE WHEN regexp_matches(name, '^(mr|sir|lord)[. ]') THEN 'MALE' WHEN regexp_matches(name, '^(mrs|miss|ms|lady)[. ]') THEN 'FEMALE' END AS guess FROM (SELECT * FROM said UNION SELECT book_id, name FROM n) WHERE name IS NOT NULL)
    SELECT book_id, count(*) FILTER (WHERE gold IS NOT NULL AND guess IS NOT NULL) AS scored, count(*) FILTER (WHERE gold = guess) AS correct, count(*) FILTER (WHERE gold IS NOT NULL AND guess IS NULL) AS missing FROM found JOIN gold USING (book_id, name) GROUP BY 1""",
)
def gender_score(spark: SparkSession, folder: str) -> DataFrame:
    """Genders told by the titles of names against those that readers noted: scored, right, and missing."""
    cast = table(spark, folder, "manifest_characters").where("book_id IS NOT NULL AND display_name IS NOT NULL").select("book_id", F.lower("display_name").alias("name"), F.upper("gender").alias("gender"))
    gold = cast.groupBy("book_id", "name").agg(F.max(F.when(F.col("gender").isin("MALE", "FEMALE"), F.col("gender"))).alias("gold"))
    said = table(spark, folder, "documents").where("book_id IS NOT NULL").select("book_id", F.explode("cast_names").alias("n")).select("book_id", F.lower("n").alias("name"))
    guess = F.when(F.col("name").rlike("^(mr|sir|lord)[. ]"), "MALE").when(F.col("name").rlike("^(mrs|miss|ms|lady)[. ]"), "FEMALE")
    found = said.unionByName(cast.select("book_id", "name")).where("name IS NOT NULL").distinct().withColumn("guess", guess).join(gold, ["book_id", "name"])
    told, known = F.col("guess").isNotNull(), F.col("gold").isNotNull()
    return found.groupBy("book_id").agg(F.count_if(known & told).alias("scored"), F.count_if(F.coalesce(F.col("gold") == F.col("guess"), F.lit(False))).alias("correct"), F.count_if(known & ~told).alias("missing"))


@MEASURES.add(
    "condition_scores",
    f"""WITH {_SPOKEN}, c AS (SELECT truth, speaker_id AS rules, lag(truth) OVER (PARTITION BY book_id, seq ORDER BY n) AS again FROM spoken WHERE kind = 'DIALOGUE' AND truth IS NOT NULL),
    a AS (SELECT 'rules' AS condition, truth, rules AS answer, again IS NOT NULL AND rules IS NOT NULL AS shared FROM c UNION ALL SELECT 'repeat', truth, again, again IS NOT NULL AND rules IS NOT NULL FROM c)
    SELECT condition, count(*) AS asked, round(count(answer) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE answer = truth) / count(answer), 6) AS precision, round(count(*) FILTER (WHERE answer = truth) / count(*), 6) AS accuracy,
      count(*) FILTER (WHERE answer IS NULL) AS declined, count(*) FILTER (WHERE NOT shared) AS dropped FROM a GROUP BY 1""",
)
def condition_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Two ways to answer, each on all lines: coverage, precision, accuracy, what it declines, and what a comparison on shared lines drops."""
    from pyspark.sql import Window

    said = spoken_lines(spark, folder).where("kind = 'DIALOGUE' AND truth IS NOT NULL")
    rows = said.select("truth", F.col("speaker_id").alias("rules"), F.lag("truth").over(Window.partitionBy("book_id", "seq").orderBy("n")).alias("again"))
    shared = F.col("rules").isNotNull() & F.col("again").isNotNull()
    both = F.array(F.struct(F.lit("rules").alias("condition"), F.col("rules").alias("answer")), F.struct(F.lit("repeat").alias("condition"), F.col("again").alias("answer")))
    lines = rows.select("truth", shared.alias("shared"), F.inline(both))
    right = F.count_if(F.coalesce(F.col("answer") == F.col("truth"), F.lit(False)))
    return lines.groupBy("condition").agg(
        F.count("*").alias("asked"), F.round(F.count("answer") / F.count("*"), 6).alias("coverage"), F.round(right / F.count("answer"), 6).alias("precision"),
        F.round(right / F.count("*"), 6).alias("accuracy"), F.count_if(F.col("answer").isNull()).alias("declined"), F.count_if(~F.col("shared")).alias("dropped"),
    )


@MEASURES.add("sentences_wide", f"SELECT entry_id, len({S.index_sentences('text', WIDE_ABBREVIATIONS)})::INT AS sentences FROM entries WHERE text IS NOT NULL")
def sentences_wide(spark: SparkSession, folder: str) -> DataFrame:
    """How many sentences every entry has when more abbreviations are known."""
    return table(spark, folder, "entries").where("text IS NOT NULL").select("entry_id", F.size(index_sentences(F.col("text"), WIDE_ABBREVIATIONS)).alias("sentences"))


@MEASURES.add("unquoted_runs", f"""WITH {S.SEGMENTS} SELECT book_id, seq, n, {S.strip("regexp_replace(" + S.strip('run') + ", '^[\"“”]+|[\"“”]+$', '', 'g')")} AS said FROM seg WHERE kind = 'DIALOGUE'""")
def unquoted_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Quotations without their marks."""
    return segments(_paragraphs(spark, folder)).where("kind = 'DIALOGUE'").select("book_id", "seq", "n", unquoted(F.col("run")).alias("said"))


@MEASURES.add(
    "names_resolved",
    """WITH k AS (SELECT book_id, lower(display_name) AS known, min(char_id) AS id FROM manifest_characters WHERE book_id IS NOT NULL AND display_name IS NOT NULL AND display_name <> '' GROUP BY ALL),
    s AS (SELECT DISTINCT book_id, lower(n) AS said FROM (SELECT book_id, unnest(cast_names) AS n FROM documents WHERE book_id IS NOT NULL) WHERE n IS NOT NULL AND n <> '')
    SELECT s.book_id, said, arg_min(id, (CASE WHEN said = known THEN 0 ELSE 1 END, -length(known), known)) AS id FROM s JOIN k ON s.book_id = k.book_id AND (contains(said, known) OR contains(known, said)) GROUP BY ALL""",
)
def names_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Names of documents with the character of that name, else of the longest name that holds it or that it holds."""
    cast = table(spark, folder, "manifest_characters").where("book_id IS NOT NULL AND display_name IS NOT NULL AND display_name <> ''")
    known = cast.groupBy("book_id", F.lower("display_name").alias("known")).agg(F.min("char_id").alias("id"))
    said = table(spark, folder, "documents").where("book_id IS NOT NULL").select("book_id", F.explode("cast_names").alias("n")).where("n IS NOT NULL AND n <> ''")
    said = said.select("book_id", F.lower("n").alias("said")).distinct()
    fits = F.contains("said", F.col("known")) | F.contains("known", F.col("said"))
    rank = F.struct((F.col("said") != F.col("known")).cast("int"), -F.length("known"), "known")
    return said.join(known, "book_id").where(fits).groupBy("book_id", "said").agg(F.min_by("id", rank).alias("id"))


@MEASURES.add(
    "sample_with_context",
    f"""WITH c AS ({SOUND.sql['stratified_sample']}), para AS (SELECT * FROM ({'WITH ' + S.PARAGRAPHS + ' SELECT * FROM para'}))
    SELECT c.book_id, c.seq AS chosen, p.seq, length(p.text)::INT AS characters FROM c JOIN para p ON c.book_id = p.book_id AND p.seq BETWEEN c.seq - 2 AND c.seq + 2""",
)
def sample_with_context(spark: SparkSession, folder: str) -> DataFrame:
    """The paragraphs of a sample with two before and two behind each."""
    chosen = SOUND.queries["stratified_sample"](spark, folder).select("book_id", "seq")
    rows = _paragraphs(spark, folder).select("book_id", "seq", F.length("text").alias("characters"))
    return Z.with_context(chosen, rows, ["book_id"], "seq")


assert _SCENED in _SPLIT
