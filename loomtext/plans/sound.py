"""Queries on voices, their assignment, and kernels on samples and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.operators import audio as U
from loomtext.operators import casting as C
from loomtext.operators import sampling as P
from loomtext.operators.attribution import by_rules
from loomtext.operators.scenes import with_scenes
from loomtext.operators.segments import paragraphs, segments
from loomtext.plans import sqltext as S
from loomtext.plans.registry import Registry
from loomtext.plans.speech import _RULES
from loomtext.sources.tables import table

SOUND = Registry()

_POOL = """pool AS (SELECT upper(voice) AS gender, speaker, f0_hz, quality, (row_number() OVER (PARTITION BY voice ORDER BY f0_hz, speaker) - 1)::INT AS place,
  count(*) OVER (PARTITION BY voice)::INT AS size FROM voices WHERE voice IN ('male', 'female') AND f0_hz IS NOT NULL),
good AS (SELECT gender, speaker, f0_hz, (row_number() OVER (PARTITION BY gender ORDER BY f0_hz, speaker) - 1)::INT AS place, count(*) OVER (PARTITION BY gender)::INT AS size FROM
  (SELECT *, count(*) FILTER (WHERE quality IS DISTINCT FROM 'poor') OVER (PARTITION BY gender) AS g FROM pool) WHERE g = 0 OR quality IS DISTINCT FROM 'poor')"""


@SOUND.add("voice_pools", f"WITH {_POOL} SELECT gender, speaker, place, size FROM pool")
def voice_pools(spark: SparkSession, folder: str) -> DataFrame:
    """Voices by gender and pitch."""
    return C.pools(table(spark, folder, "voices")).select("gender", "speaker", "place", "size")


@SOUND.add("voice_median", f"WITH {_POOL} SELECT gender, round(median(f0_hz), 6) AS f0_hz, count(*) AS voices FROM pool GROUP BY 1")
def voice_median(spark: SparkSession, folder: str) -> DataFrame:
    """The median pitch of each pool."""
    return C.pools(table(spark, folder, "voices")).groupBy("gender").agg(F.round(F.median("f0_hz"), 6).alias("f0_hz"), F.count("*").alias("voices"))


@SOUND.add(
    "voice_class",
    "SELECT speaker, CASE WHEN f0_hz IS NULL OR f0_hz <= 0 THEN 'unknown' WHEN f0_hz < 135 THEN 'male' WHEN f0_hz > 155 THEN 'female' ELSE 'unclear' END AS sort FROM voices",
)
def voice_class(spark: SparkSession, folder: str) -> DataFrame:
    """The sort of each voice by its pitch."""
    return table(spark, folder, "voices").select("speaker", C.voice_class(F.col("f0_hz")).alias("sort"))


@SOUND.add("poor_antijoin", f"WITH {_POOL} SELECT gender, speaker, place, size FROM good")
def poor_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Pools without poor voices."""
    return C.without_poor(C.pools(table(spark, folder, "voices"))).select("gender", "speaker", "place", "size")


def _people(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "manifest_characters")
    gender = F.when(F.upper("gender").isin("MALE", "FEMALE", "NEUTRAL"), F.upper("gender")).otherwise("UNKNOWN")
    return rows.select("rec_id", "book_id", "char_id", gender.alias("gender"), F.upper("age_band").alias("age_band"), "line_count", "display_name")


_TARGET = f"""{_POOL}, med AS (SELECT gender, median(f0_hz) AS hz FROM pool GROUP BY 1),
target AS (SELECT rec_id, book_id, char_id, g AS gender, coalesce((SELECT hz FROM med WHERE gender = g), (SELECT avg(hz) FROM med), 145)
   + CASE age WHEN 'CHILD' THEN 40 WHEN 'TEEN' THEN 15 WHEN 'ELDER' THEN -10 ELSE 0 END AS target_hz FROM
   (SELECT rec_id, book_id, char_id, CASE WHEN upper(gender) IN ('MALE', 'FEMALE', 'NEUTRAL') THEN upper(gender) ELSE 'UNKNOWN' END AS g, upper(age_band) AS age FROM manifest_characters))"""


@SOUND.add("voice_design", f"WITH {_TARGET} SELECT rec_id, round(target_hz, 6) AS target_hz FROM target")
def voice_design(spark: SparkSession, folder: str) -> DataFrame:
    """The pitch that each character should have."""
    people = C.target_pitch(_people(spark, folder), C.pools(table(spark, folder, "voices")))
    return people.select("rec_id", F.round("target_hz", 6).alias("target_hz"))


@SOUND.add(
    "blend_plan",
    f"""WITH {_TARGET}, t AS (SELECT DISTINCT gender, target_hz FROM target),
    lo AS (SELECT t.*, arg_max(speaker, (f0_hz, place)) AS s, max(f0_hz) AS f FROM t JOIN good g ON t.gender = g.gender AND g.f0_hz < target_hz GROUP BY ALL),
    hi AS (SELECT t.*, arg_min(speaker, (f0_hz, place)) AS s, min(f0_hz) AS f FROM t JOIN good g ON t.gender = g.gender AND g.f0_hz >= target_hz GROUP BY ALL),
    near AS (SELECT t.*, arg_min(speaker, (abs(f0_hz - target_hz), place)) AS s, max(f0_hz) AS top FROM t JOIN good g ON t.gender = g.gender GROUP BY ALL),
    p AS (SELECT n.gender, n.target_hz, CASE WHEN inside THEN lo.s ELSE n.s END AS parent_a, CASE WHEN inside THEN hi.s ELSE n.s END AS parent_b, CASE WHEN inside THEN (n.target_hz - lo.f) / (hi.f - lo.f) ELSE 0 END AS fraction FROM
      (SELECT n.*, lo.f IS NOT NULL AND hi.f IS NOT NULL AND n.target_hz < n.top AS inside FROM near n LEFT JOIN lo ON n.gender = lo.gender AND n.target_hz = lo.target_hz LEFT JOIN hi ON n.gender = hi.gender AND n.target_hz = hi.target_hz) n
      LEFT JOIN lo ON n.gender = lo.gender AND n.target_hz = lo.target_hz LEFT JOIN hi ON n.gender = hi.gender AND n.target_hz = hi.target_hz)
    SELECT rec_id, parent_a, parent_b, round(fraction, 6) AS fraction FROM target LEFT JOIN p USING (gender, target_hz)""",
)
def blend_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The two voices that each character's voice is mixed from."""
    pool = C.pools(table(spark, folder, "voices"))
    people = C.target_pitch(_people(spark, folder), pool)
    return C.blend_plan(people, C.without_poor(pool)).select("rec_id", "parent_a", "parent_b", F.round("fraction", 6).alias("fraction"))


@SOUND.add(
    "blend_vectors",
    """SELECT a.vec_id, t AS fraction, list_transform(list_zip(a.embedding, b.embedding), lambda p: round(p[1]::DOUBLE * (1 - t) + p[2]::DOUBLE * t, 9) + 0) AS mixed
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 CROSS JOIN (SELECT unnest([0, 0.25, 0.5, 0.75, 1])::DOUBLE AS t)""",
)
def blend_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector mixed with the next one in five steps."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    steps = rows.join(after, "vec_id").withColumn("fraction", F.explode(F.array(*map(F.lit, [0.0, 0.25, 0.5, 0.75, 1.0]))))
    return steps.select("vec_id", "fraction", F.transform(C.blend(F.col("a"), F.col("b"), F.col("fraction")), lambda x: F.round(x, 9) + 0.0).alias("mixed"))


@SOUND.add(
    "spread_index",
    """WITH c AS (SELECT book_id, char_id, rec_id, upper(coalesce(gender, 'UNKNOWN')) AS gender, (row_number() OVER w - 1)::INT AS nth, count(*) OVER (PARTITION BY book_id, upper(coalesce(gender, 'UNKNOWN')))::INT AS of_all
      FROM manifest_characters WINDOW w AS (PARTITION BY book_id, upper(coalesce(gender, 'UNKNOWN')) ORDER BY line_count DESC NULLS LAST, char_id, rec_id))
    SELECT rec_id, CASE WHEN of_all <= 1 THEN 20 ELSE greatest(0, least(39, floor((nth + 1) / (of_all + 1) * 39))) END::INT AS place FROM c""",
)
def spread_index(spark: SparkSession, folder: str) -> DataFrame:
    """Each character's place of forty so that those of one gender in a book lie apart."""
    rows = table(spark, folder, "manifest_characters").select("rec_id", "book_id", "char_id", F.upper(F.coalesce("gender", F.lit("UNKNOWN"))).alias("gender"), "line_count")
    group = Window.partitionBy("book_id", "gender")
    nth = F.row_number().over(group.orderBy(F.col("line_count").desc_nulls_last(), "char_id", "rec_id")) - 1
    placed = rows.select("rec_id", nth.alias("nth"), F.count("*").over(group).alias("n"))
    return placed.select("rec_id", C.spread_place(F.col("nth"), F.col("n"), F.lit(40)).alias("place"))


def _present(spark: SparkSession, folder: str) -> DataFrame:
    """Who speaks in which entry, as the readers' spans say."""
    return table(spark, folder, "spans").where("speaker_id IS NOT NULL AND kind = 1").select("book_id", "seq", F.col("speaker_id").alias("who")).distinct()


@SOUND.add(
    "conflict_edges",
    """WITH p AS (SELECT DISTINCT book_id, seq, speaker_id AS who FROM spans WHERE speaker_id IS NOT NULL AND kind = 1)
    SELECT DISTINCT x.book_id, x.who AS a, y.who AS b FROM p x JOIN p y ON x.book_id = y.book_id AND x.seq = y.seq AND x.who <> y.who""",
)
def conflict_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Characters who speak in one entry."""
    return C.conflicts(_present(spark, folder), ["book_id", "seq"])


@SOUND.add("cast_greedy")
def cast_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """A voice for each character of every book."""
    edges = C.conflicts(_present(spark, folder), ["book_id", "seq"])
    return C.cast_voices(_people(spark, folder), edges, C.pools(table(spark, folder, "voices")))


@SOUND.add("narrator_pick", f"WITH {_POOL} SELECT gender, speaker FROM pool WHERE place = size // 2")
def narrator_pick(spark: SparkSession, folder: str) -> DataFrame:
    """The middle voice of each pool."""
    return C.pools(table(spark, folder, "voices")).where(F.col("place") == F.floor(F.col("size") / 2)).select("gender", "speaker")


@SOUND.add(
    "guarded_pool",
    f"""WITH {_POOL}, n AS (SELECT f0_hz AS f FROM pool WHERE gender = 'FEMALE' AND place = size // 2)
    SELECT gender, speaker FROM (SELECT p.*, abs(f0_hz - f) >= 25 AS far, max((abs(f0_hz - f) >= 25)::INT) OVER (PARTITION BY gender) AS anyone FROM pool p CROSS JOIN n) WHERE far OR anyone = 0""",
)
def guarded_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Voices far enough from the narrator's, the middle female one; a whole pool where none is."""
    pool = C.pools(table(spark, folder, "voices"))
    middle = (F.col("gender") == "FEMALE") & (F.col("place") == F.floor(F.col("size") / 2))
    # The inventory of voices is of fixed size, so one partition holds it.
    narrator = F.max(F.when(middle, F.col("f0_hz"))).over(Window.partitionBy(F.lit(1)))
    marked = pool.withColumn("far", F.abs(F.col("f0_hz") - narrator) >= C.GUARD_HZ).withColumn("anyone", F.max("far").over(Window.partitionBy("gender")))
    return marked.where(F.col("far") | ~F.col("anyone")).select("gender", "speaker")


@SOUND.add(
    "name_groups",
    """WITH c AS (SELECT book_id, lower(display_name) AS name FROM manifest_characters WHERE display_name IS NOT NULL AND display_name <> '' GROUP BY ALL)
    SELECT a.book_id, a.name AS short_name, arg_max(b.name, (length(b.name), b.name)) AS long_name FROM c a JOIN c b ON a.book_id = b.book_id AND length(b.name) > length(a.name)
      AND suffix(b.name, a.name) AND regexp_full_match(b.name[length(b.name) - length(a.name)], '[^\\pL\\p{Nd}]') GROUP BY ALL""",
)
def name_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Names of a book that end a longer one of it as a word of its own: the longest such one."""
    names = table(spark, folder, "manifest_characters").where("display_name IS NOT NULL AND display_name <> ''").select("book_id", F.lower("display_name").alias("name")).distinct()
    # Every ending behind a character that is no letter or digit is joined by equality.
    ends = names.select("book_id", "name", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("name")))).alias("i"))
    ends = ends.where(F.substr("name", F.col("i") - 1, F.lit(1)).rlike(r"[^\p{L}\p{Nd}]"))
    ends = ends.select("book_id", F.col("name").alias("long"), F.substr("name", F.col("i"), F.length("name")).alias("name")).where("name <> ''")
    return names.join(ends, ["book_id", "name"]).groupBy("book_id", F.col("name").alias("short_name")).agg(F.max_by("long", F.struct(F.length("long"), "long")).alias("long_name"))


@SOUND.add(
    "pace_by_speaker",
    f"""WITH {_RULES} SELECT book_id, speaker_id, count(*) AS lines, round(greatest(0.85, least(1.2, avg(len(string_split_regex(run, '{S.WHITE}+'))) / 12)), 6) AS length_scale
    FROM lines WHERE tier = 'HEURISTIC' AND confidence >= 0.95 AND speaker_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""",
)
def pace_by_speaker(spark: SparkSession, folder: str) -> DataFrame:
    """The pace of speakers with at least three lines that a speech tag names."""
    from loomtext.functions.text import WHITE

    lines = by_rules(segments(paragraphs(table(spark, folder, "entries"))), table(spark, folder, "manifest_characters"))
    sure = lines.where("tier = 'HEURISTIC' AND confidence >= 0.95 AND speaker_id IS NOT NULL")
    words = F.avg(F.size(F.split("run", f"{WHITE}+")))
    return sure.groupBy("book_id", "speaker_id").agg(F.count("*").alias("lines"), F.round(C.pace(words), 6).alias("length_scale")).where(F.col("lines") >= C.LINES_LEAST)


_TIMED = f"""
tx AS (SELECT chunk_id, text AS t, length(text)::BIGINT * 60 AS total FROM host_trace WHERE text IS NOT NULL AND length(text) > 0),
cut AS (SELECT chunk_id, total, regexp_extract_all(t, {S.text(U.TIMED)}, 1) AS p FROM tx),
piece AS (SELECT chunk_id, total, i, p[i] AS s, length(array_to_string(p[1:i - 1], '')) AS pos FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM cut)),
body AS (SELECT chunk_id, total, i, {S.strip('s')} AS body, pos + length(regexp_extract(s, '^{S.WHITE}*')) AS char_start FROM piece),
wt AS (SELECT *, greatest(1, length(regexp_replace(body, '{S.WHITE}', '', 'g')))::BIGINT AS w FROM body WHERE body <> ''),
sums AS (SELECT *, sum(w) OVER (PARTITION BY chunk_id ORDER BY i)::BIGINT AS upto, sum(w) OVER (PARTITION BY chunk_id)::BIGINT AS whole FROM wt),
sent AS (SELECT chunk_id, i, body, char_start, (upto - w) * total // whole AS start_ms, upto * total // whole AS end_ms FROM sums),
word0 AS (SELECT chunk_id, i, char_start, start_ms, end_ms, j, p[j] AS s, length(array_to_string(p[1:j - 1], '')) + j - 1 AS pos FROM
  (SELECT *, unnest(generate_series(1, len(p))) AS j FROM (SELECT *, string_split_regex(body, '{S.WHITE}') AS p FROM sent))),
word AS (SELECT *, sum(length(s)) OVER (PARTITION BY chunk_id, i ORDER BY j)::BIGINT AS upto, sum(length(s)) OVER (PARTITION BY chunk_id, i)::BIGINT AS whole FROM word0 WHERE s <> ''),
timed AS (SELECT chunk_id, 'WORD' AS kind, start_ms + (upto - length(s)) * (end_ms - start_ms) // whole AS start_ms, start_ms + upto * (end_ms - start_ms) // whole AS end_ms,
    (char_start + pos)::INT AS char_start, (char_start + pos + length(s))::INT AS char_end FROM word
  UNION ALL SELECT chunk_id, 'SENTENCE', start_ms, end_ms, char_start::INT, (char_start + length(body))::INT FROM sent)"""


def _timings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "host_trace").where("text IS NOT NULL AND text <> ''")
    return U.timings(rows, "chunk_id", "text", F.length("text") * 60)


@SOUND.add("boundary_times", f"WITH {_TIMED} SELECT * FROM timed")
def boundary_times(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated times of the words and sentences of every chunk at 60 ms a character."""
    return _timings(spark, folder)


@SOUND.add(
    "slice_boundaries",
    f"""WITH {_TIMED}, k AS (SELECT * FROM timed WHERE kind = 'WORD' AND char_start >= 5 AND char_end <= 30)
    SELECT chunk_id, start_ms - min(start_ms) OVER (PARTITION BY chunk_id) AS start_ms, end_ms - min(start_ms) OVER (PARTITION BY chunk_id) AS end_ms, char_start - 5 AS char_start, char_end - 5 AS char_end FROM k""",
)
def slice_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """The words between the fifth and the thirtieth character of each chunk, with times from the first one."""
    return U.sliced(_timings(spark, folder), "chunk_id", F.lit(5), F.lit(30))


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("pcm"))


_PCM = "pcm AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"


@SOUND.add(
    "loudness_norm",
    f"""WITH {_PCM}, r AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms FROM pcm)
    SELECT vec_id, round(20 * log10(rms), 5) AS dbfs, list_transform(x, lambda v: round(greatest(-1, least(1, v * pow(10, -17 / 20.0) / rms)), 9) + 0) AS pcm FROM r""",
)
def loudness_norm(spark: SparkSession, folder: str) -> DataFrame:
    """Samples at the target level, and their level before."""
    x = F.col("pcm")
    return _samples(spark, folder).select("vec_id", F.round(U.dbfs(x), 5).alias("dbfs"), F.transform(U.loudness(x), lambda v: F.round(v, 9) + 0.0).alias("pcm"))


@SOUND.add(
    "crossfade",
    f"""WITH {_PCM} SELECT a.vec_id, list_transform(list_concat(a.x[1:-9], list_transform(generate_series(1, 8), lambda i: a.x[len(a.x) - 8 + i] * (1 - i / 9.0) + b.x[i] * (i / 9.0)), b.x[9:]), lambda v: round(v, 9) + 0) AS pcm
    FROM pcm a JOIN pcm b ON b.vec_id = a.vec_id + 1""",
)
def crossfade(spark: SparkSession, folder: str) -> DataFrame:
    """Each buffer joined to the next one over eight samples."""
    rows = _samples(spark, folder)
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pcm").alias("b"))
    return rows.join(after, "vec_id").select("vec_id", F.transform(U.crossfade(F.col("pcm"), F.col("b"), F.lit(8)), lambda v: F.round(v, 9) + 0.0).alias("pcm"))


@SOUND.add(
    "resample_linear",
    f"""WITH {_PCM} SELECT vec_id, list_transform(generate_series(0, floor(len(x) / 1.25)::INT - 1), lambda i: round(x[floor(i * 1.25)::INT + 1] + (x[least(floor(i * 1.25)::INT + 2, len(x))] - x[floor(i * 1.25)::INT + 1]) * (i * 1.25::DOUBLE - floor(i * 1.25)), 9) + 0) AS pcm FROM pcm""",
)
def resample_linear(spark: SparkSession, folder: str) -> DataFrame:
    """Samples a quarter faster."""
    return _samples(spark, folder).select("vec_id", F.transform(U.stretch(F.col("pcm"), F.lit(1.25)), lambda v: F.round(v, 9) + 0.0).alias("pcm"))


@SOUND.add("pcm16_encode", f"WITH {_PCM} SELECT vec_id, list_transform(x, lambda v: trunc(greatest(-1, least(1, v)) * 32767)::INT) AS pcm FROM pcm")
def pcm16_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Samples as 16-bit integers."""
    return _samples(spark, folder).select("vec_id", U.pcm16(F.col("pcm")).alias("pcm"))


@SOUND.add(
    "waveform_compare",
    f"""WITH {_PCM} SELECT a.vec_id, len(a.x) = len(b.x) AS same_length, a.x = b.x AS identical, round(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(a.x)), 5) AS rms_difference
    FROM pcm a JOIN pcm b ON b.vec_id = a.vec_id + 1""",
)
def waveform_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Each buffer against the next one."""
    rows = _samples(spark, folder)
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pcm").alias("b"))
    d = U.waveform_difference(F.col("pcm"), F.col("b"))
    return rows.join(after, "vec_id").select("vec_id", d.alias("d")).select("vec_id", "d.same_length", "d.identical", F.round("d.rms_difference", 5).alias("rms_difference"))


@SOUND.add(
    "softmax_best",
    f"WITH {_PCM} SELECT vec_id, (list_position(x, list_max(x)) - 1)::INT AS best, round(1 / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 5) AS share FROM pcm",
)
def softmax_best(spark: SparkSession, folder: str) -> DataFrame:
    """The best of each vector's scores and its share."""
    best = U.softmax_best(F.col("pcm"))
    return _samples(spark, folder).select("vec_id", best.alias("b")).select("vec_id", "b.best", F.round("b.share", 5).alias("share"))


@SOUND.add("joined_with_silence", f"WITH {_PCM} SELECT a.vec_id, len(a.x) + 16 + len(b.x) AS samples, a.x[1] AS first_sample FROM pcm a JOIN pcm b ON b.vec_id = a.vec_id + 1")
def joined_with_silence(spark: SparkSession, folder: str) -> DataFrame:
    """Each buffer and the next one with a pause of sixteen samples between."""
    rows = _samples(spark, folder)
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pcm").alias("b"))
    joined = U.with_silence(F.array("pcm", "b"), 16)
    return rows.join(after, "vec_id").select("vec_id", F.size(joined).cast("bigint").alias("samples"), joined[0].alias("first_sample"))


@SOUND.add("median_pitch")
def median_pitch(spark: SparkSession, folder: str) -> DataFrame:
    """The pitch of a synthesized tone for each voice that has one: it comes out near the voice's own."""
    voices = table(spark, folder, "voices").where("f0_hz IS NOT NULL")
    tone = F.transform(F.sequence(F.lit(0), F.lit(1599)), lambda i: 0.5 * F.sin(2 * F.pi() * F.col("f0_hz") * i / 8000))
    return voices.select("speaker", "f0_hz", F.round(U.median_pitch(tone, F.lit(8000)), 2).alias("measured_hz"))


@SOUND.add(
    "real_time_factor",
    """WITH s AS (SELECT session_id, median(gap_ms / (chars * 60.0)) AS rtf, sum(gap_ms) / sum(chars * 60.0) AS overall FROM host_trace WHERE chars > 0 GROUP BY 1)
    SELECT session_id, round(rtf, 6) AS rtf, round(overall, 6) AS overall FROM s""",
)
def real_time_factor(spark: SparkSession, folder: str) -> DataFrame:
    """Waiting time against spoken time: the median over a session's chunks, and over all of it."""
    rows = table(spark, folder, "host_trace").where("chars > 0")
    spoken = F.col("chars") * 60.0
    return rows.groupBy("session_id").agg(F.round(F.median(F.col("gap_ms") / spoken), 6).alias("rtf"), F.round(F.sum("gap_ms") / F.sum(spoken), 6).alias("overall"))


def _spots(spark: SparkSession, folder: str) -> DataFrame:
    return segments(paragraphs(table(spark, folder, "entries"))).where("kind = 'DIALOGUE'").select("book_id", "chapter", "seq", "n")


@SOUND.add(
    "passages_natural",
    f"""WITH {S.SEGMENTS}, d AS (SELECT book_id, chapter, seq, lead(seq, 5) OVER (PARTITION BY book_id, chapter ORDER BY seq, n) AS last, row_number() OVER (PARTITION BY book_id, chapter, seq ORDER BY n) AS k FROM seg WHERE kind = 'DIALOGUE')
    SELECT book_id, chapter, seq AS from_place, last + 1 AS to_place FROM d WHERE k = 1 AND last - seq + 1 <= 12""",
)
def passages_natural(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of at most twelve paragraphs that hold six quotations."""
    spots = _spots(spark, folder)
    ordered = Window.partitionBy("book_id", "chapter").orderBy("seq", "n")
    ends = spots.select("*", F.lead("seq", 5).over(ordered).alias("last"), F.row_number().over(Window.partitionBy("book_id", "chapter", "seq").orderBy("n")).alias("k"))
    return ends.where("k = 1 AND last - seq + 1 <= 12").select("book_id", "chapter", F.col("seq").alias("from_place"), (F.col("last") + 1).alias("to_place"))


@SOUND.add("passages_apart")
def passages_apart(spark: SparkSession, folder: str) -> DataFrame:
    """Such stretches, none overlapping another."""
    return P.apart(passages_natural(spark, folder), ["book_id", "chapter"])


@SOUND.add(
    "stratified_sample",
    f"""WITH {S.PARAGRAPHS}, b AS (SELECT book_id, seq, min(seq) OVER (PARTITION BY book_id) AS lo, max(seq) OVER (PARTITION BY book_id) AS hi FROM para),
    s AS (SELECT book_id, seq, floor((seq - lo) * 10 / (hi - lo + 1))::INT AS stratum, md5(book_id || '-' || seq || ':7') AS h FROM b)
    SELECT book_id, stratum, arg_min(seq, (h, seq)) AS seq FROM s GROUP BY ALL""",
)
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """One paragraph from each tenth of every book."""
    paras = paragraphs(table(spark, folder, "entries")).withColumn("id", F.concat_ws("-", "book_id", "seq"))
    return P.stratified(paras, ["book_id"], "seq", 10, "id", seed=7).select("book_id", "stratum", "seq")


@SOUND.add("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || ':11'), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty documents, the same each time."""
    return table(spark, folder, "documents").select("doc_id").orderBy(P.seeded_order("doc_id", 11), "doc_id").limit(50)
