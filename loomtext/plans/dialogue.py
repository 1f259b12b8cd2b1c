"""Queries on conversations as the readers' spans tell them, where most lines are speech and many have no speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import attribution as A
from loomtext.operators import casting as C
from loomtext.operators.turns import FLOORS, Floor, alternation, turn_taking
from loomtext.plans.registry import Registry
from loomtext.plans.speech import SPEECH, _RULES
from loomtext.plans.cast import _SCENED
from loomtext.plans import sqltext as S
from loomtext.sources.tables import table

DIALOGUE = Registry()


def spoken_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``book_id``, ``chapter``, ``seq``, ``n``, ``kind``, ``speaker_id``, ``truth`` and what rules would add, one row for each place of a span.

    ``speaker_id`` is what is known beforehand: the speaker of every third line; the others are to be found.
    """
    spans = table(spark, folder, "spans").where("book_id IS NOT NULL AND seq IS NOT NULL AND ordinal IS NOT NULL")
    places = spans.groupBy("book_id", "seq", F.col("ordinal").alias("n")).agg(F.max("kind").alias("k"), F.max("speaker_id").alias("truth"))
    entries = table(spark, folder, "entries").where("book_id IS NOT NULL AND seq IS NOT NULL AND chapter IS NOT NULL").groupBy("book_id", "seq").agg(F.min("chapter").alias("chapter"))
    rows = places.join(entries, ["book_id", "seq"])
    return rows.select(
        "book_id", "chapter", "seq", "n", F.when(F.col("k") == 1, "DIALOGUE").otherwise("NARRATION").alias("kind"),
        F.when((F.col("k") == 1) & ((F.col("seq") + F.col("n")) % 3 == 0), F.col("truth")).alias("speaker_id"), "truth",
        F.lit(0.0).alias("confidence"), F.lit("NONE").alias("tier"), F.lit("").alias("evidence"),
    )


_SPOKEN = """
place AS (SELECT book_id, seq, ordinal AS n, max(kind) AS k, max(speaker_id) AS truth FROM spans WHERE book_id IS NOT NULL AND seq IS NOT NULL AND ordinal IS NOT NULL GROUP BY ALL),
spoken AS (SELECT p.book_id, chapter, p.seq, n, CASE WHEN k = 1 THEN 'DIALOGUE' ELSE 'NARRATION' END AS kind, CASE WHEN k = 1 AND (p.seq + n) % 3 = 0 THEN truth END AS speaker_id, truth
  FROM place p JOIN (SELECT book_id, seq, min(chapter) AS chapter FROM entries WHERE book_id IS NOT NULL AND seq IS NOT NULL AND chapter IS NOT NULL GROUP BY ALL) e ON p.book_id = e.book_id AND p.seq = e.seq)"""

#: Turn-taking, one line of each chapter a round.
_TAKEN = """
l AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter ORDER BY seq, n) AS i FROM spoken),
t AS (
  SELECT DISTINCT book_id, chapter, 0::BIGINT AS i, []::VARCHAR[] AS turns, NULL::INT AS here, NULL::INT AS quiet_at, 0 AS quiet, false AS skipped, NULL::INT AS seq, NULL::INT AS n, NULL::VARCHAR AS who, NULL::VARCHAR AS why, NULL::DOUBLE AS sure FROM l
  UNION ALL
  SELECT book_id, chapter, i,
    CASE WHEN move = 'narrated' AND quiet + 1 > 2 THEN []::VARCHAR[] WHEN move = 'told' THEN list_append(turns, speaker_id)[-6:] WHEN move = 'other' THEN list_append(turns, other)[-6:] WHEN move = 'sole' THEN list_append(turns, last)[-6:] ELSE turns END,
    CASE WHEN said THEN seq ELSE here END, CASE WHEN said THEN NULL WHEN move = 'narrated' THEN seq ELSE quiet_at END, CASE WHEN said THEN 0 WHEN move = 'narrated' THEN quiet + 1 ELSE quiet END,
    CASE WHEN move IN ('told', 'other', 'sole') OR (move = 'narrated' AND quiet + 1 > 2) THEN false WHEN move = 'skip' THEN true ELSE skipped END, seq, n,
    CASE move WHEN 'same' THEN last WHEN 'other' THEN other WHEN 'sole' THEN last END,
    CASE move WHEN 'same' THEN 'same paragraph as ' || last WHEN 'other' THEN 'alternation after ' || last WHEN 'sole' THEN 'revert to ' || last END, CASE move WHEN 'same' THEN 0.8 WHEN 'other' THEN 0.7 WHEN 'sole' THEN 0.7 END
  FROM (SELECT *, CASE WHEN NOT said THEN CASE WHEN seq IS NOT DISTINCT FROM here OR seq IS NOT DISTINCT FROM quiet_at THEN 'none' ELSE 'narrated' END WHEN speaker_id IS NOT NULL THEN 'told'
      WHEN here = seq AND len(turns) > 0 THEN 'same' WHEN speakers = 2 THEN 'other' WHEN speakers = 1 AND skipped THEN 'sole' WHEN speakers = 1 THEN 'skip' ELSE 'none' END AS move
    FROM (SELECT l.book_id, l.chapter, l.i, turns, here, quiet_at, quiet, skipped, l.seq, l.n, kind = 'DIALOGUE' AS said, speaker_id, turns[-1] AS last, len(list_distinct(turns)) AS speakers, list_filter(turns, lambda x: x <> turns[-1])[1] AS other
      FROM t JOIN l ON t.book_id = l.book_id AND t.chapter = l.chapter AND l.i = t.i + 1)))"""


@DIALOGUE.add("spoken_turns", f"WITH RECURSIVE {_SPOKEN}, {_TAKEN} SELECT book_id, seq, n, who AS speaker_id, sure AS confidence, why AS evidence FROM t WHERE who IS NOT NULL")
def spoken_turns(spark: SparkSession, folder: str) -> DataFrame:
    """What turn-taking adds to the lines of every chapter."""
    found = turn_taking(spoken_lines(spark, folder).drop("truth"))
    return found.where("tier = 'SCENE'").select("book_id", "seq", "n", "speaker_id", "confidence", "evidence")


def floor_sql(turns: str, rules: Floor) -> str:
    """A recursive statement ``floor`` over the rows of ``turns``: ``book_id``, ``chapter``, ``seq``, ``scene_start``, ``told``, ``why``, ``open`` (some answer is missing), ``opens``, ``leaves``; one turn of each chapter a round."""
    two_clear = "NULL" if rules.pair else "w1"
    stopped = " OR ".join(["false", *(["(step IS DISTINCT FROM 1)"] if rules.adjacent else []), *([f"chain >= {rules.longest}"] if rules.longest is not None else [])])
    seated = "why IS DISTINCT FROM 'speech tag'" if rules.strong else "false"
    near = "(a1 - a2 = 1)" if rules.adjacent else "true"
    solo = "true" if rules.solo else "false"
    return f"""
tu AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter ORDER BY seq) AS i FROM {turns}),
f AS (
  SELECT DISTINCT book_id, chapter, 0::BIGINT AS i, NULL::VARCHAR AS w1, NULL::INT AS a1, NULL::VARCHAR AS w2, NULL::INT AS a2, false AS known, 0 AS chain, NULL::VARCHAR AS sole, NULL::INT AS sole_at, NULL::INT AS passed_at,
    NULL::INT AS last_at, NULL::INT AS last_scene, false AS left_open, NULL::INT AS seq, NULL::VARCHAR AS who, NULL::VARCHAR AS how FROM tu
  UNION ALL
  SELECT book_id, chapter, i, CASE WHEN taken IS NOT NULL THEN taken ELSE w1 END, CASE WHEN taken IS NOT NULL THEN seq ELSE a1 END, new_w2, CASE WHEN new_w2 IS NULL THEN NULL WHEN taken IS NULL OR new_w2 IS NOT DISTINCT FROM w2 THEN a2 ELSE a1 END,
    CASE WHEN taken IS NOT NULL THEN true WHEN move IN ('told', 'tagged') THEN false WHEN move = 'goes on' THEN known AND w1 IS NOT NULL ELSE false END,
    CASE WHEN move IN ('told', 'tagged') THEN 0 WHEN move = 'next' THEN chain + 1 ELSE chain END,
    CASE WHEN move = 'tagged' AND {solo} THEN CASE WHEN new_w2 IS NOT NULL THEN NULL ELSE told END WHEN move = 'lost' THEN NULL ELSE sole END,
    CASE WHEN (move = 'tagged' AND {solo}) OR move = 'revert' THEN seq ELSE sole_at END, CASE WHEN (move = 'tagged' AND {solo}) OR move = 'revert' THEN NULL WHEN move = 'pass' THEN seq ELSE passed_at END,
    seq, scene_start, leaves, seq,
    CASE WHEN move IN ('told', 'tagged') THEN CASE WHEN open THEN told END WHEN move = 'goes on' THEN CASE WHEN known THEN w1 END WHEN move = 'next' THEN taken WHEN move = 'revert' THEN sole END,
    CASE WHEN move IN ('told', 'tagged') THEN 'same paragraph as tag' WHEN move = 'goes on' THEN 'continued speech' WHEN move = 'next' THEN CASE chain WHEN 0 THEN 'alternation' WHEN 1 THEN 'alternation x2' WHEN 2 THEN 'alternation x3' ELSE 'alternation x4+' END WHEN move = 'revert' THEN 'revert to sole speaker' END
  FROM (SELECT *, CASE WHEN taken IS NULL THEN w2 WHEN taken = w1 THEN w2 WHEN taken = w2 THEN w1 WHEN w2 IS NOT NULL THEN {two_clear} ELSE w1 END AS new_w2
   FROM (SELECT *, CASE WHEN move = 'tagged' THEN told WHEN move = 'next' THEN w2 END AS taken
    FROM (SELECT *, CASE WHEN told IS NOT NULL AND {seated} THEN 'told' WHEN told IS NOT NULL THEN 'tagged' WHEN coalesce(step = 1 AND left_open AND opens, false) AND {str(rules.continues).lower()} THEN 'goes on'
       WHEN NOT ({stopped}) AND known AND w2 IS NOT NULL AND {near} THEN 'next'
       WHEN NOT ({stopped}) AND {solo} AND sole IS NOT NULL AND w2 IS NULL THEN CASE WHEN passed_at IS NULL AND seq - sole_at = 1 THEN 'pass' WHEN passed_at IS NOT NULL AND seq - passed_at = 1 THEN 'revert' ELSE 'lost' END ELSE 'none' END AS move
     FROM (SELECT u.book_id, u.chapter, u.i, u.seq, u.scene_start, u.told, u.why, u.open, u.opens, u.leaves, chain, left_open, sole_at, CASE WHEN same THEN w1 END AS w1, CASE WHEN same THEN a1 END AS a1, CASE WHEN same THEN w2 END AS w2, CASE WHEN same THEN a2 END AS a2,
         known AND same AS known, CASE WHEN same THEN sole END AS sole, CASE WHEN same THEN passed_at END AS passed_at, CASE WHEN same THEN u.seq - last_at END AS step
       FROM (SELECT f.*, f.last_scene IS NULL OR f.last_scene = x.scene_start AS same, x.i AS xi FROM f JOIN tu x ON f.book_id = x.book_id AND f.chapter = x.chapter AND x.i = f.i + 1) g
       JOIN tu u ON g.book_id = u.book_id AND g.chapter = u.chapter AND u.i = g.xi))))),
floor AS (SELECT book_id, seq, who AS speaker_id, how AS evidence FROM f WHERE who IS NOT NULL)"""


_SPOKEN_TURNS = f"""{_SPOKEN},
spoken_turn AS (SELECT book_id, chapter, seq, seq // 40 AS scene_start, arg_min(speaker_id, n) FILTER (speaker_id IS NOT NULL) AS told,
  CASE WHEN arg_min(n, n) FILTER (speaker_id IS NOT NULL) % 2 = 0 THEN 'speech tag' ELSE 'action beat' END AS why, bool_or(speaker_id IS NULL) AS open, seq % 2 = 0 AS opens, seq % 5 = 1 AS leaves FROM spoken WHERE kind = 'DIALOGUE' GROUP BY book_id, chapter, seq)"""


def spoken_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The paragraphs of the spoken lines with the answers known beforehand; places tell scenes and open quotations."""
    said = spoken_lines(spark, folder).where("kind = 'DIALOGUE'")
    why = F.when(F.col("speaker_id").isNull(), "no tag").when(F.col("n") % 2 == 0, "speech tag").otherwise("action beat")
    rows = said.groupBy("book_id", "chapter", "seq").agg(F.sort_array(F.collect_list(F.struct("n", "speaker_id", why.alias("evidence")))).alias("q"))
    return rows.select(
        "book_id", "chapter", "seq", F.floor(F.col("seq") / 40).cast("int").alias("scene_start"), F.col("q.speaker_id").alias("speakers"), F.col("q.evidence").alias("evidence"),
        (F.col("seq") % 2 == 0).alias("opens"), (F.col("seq") % 5 == 1).alias("leaves_open"),
    )


_READ_TURNS = f"""{_RULES.replace(S.PARAGRAPHS, _SCENED)},
read_turn AS (SELECT l.book_id, l.chapter, l.seq, any_value(s.scene_start) AS scene_start, arg_min(l.speaker_id, l.n) FILTER (l.speaker_id IS NOT NULL) AS told, arg_min(l.evidence, l.n) FILTER (l.speaker_id IS NOT NULL) AS why,
  bool_or(l.speaker_id IS NULL) AS open, any_value(s.text[1] IN ('"', '“', '«')) AS opens, any_value((length(s.text) - length(replace(s.text, '"', ''))) % 2 = 1 OR length(replace(s.text, '”', '')) > length(replace(s.text, '“', ''))) AS leaves
  FROM lines l JOIN scened s ON l.book_id = s.book_id AND l.seq = s.seq WHERE l.kind = 'DIALOGUE' GROUP BY l.book_id, l.chapter, l.seq)"""


def _floor(name: str) -> None:
    rules = FLOORS[name]

    @DIALOGUE.add("spoken_" + name.replace("-", "_"), f"WITH RECURSIVE {_SPOKEN_TURNS}, {floor_sql('spoken_turn', rules)} SELECT * FROM floor")
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return alternation(spoken_paragraphs(spark, folder), rules)

    query.__doc__ = f"Spoken paragraphs answered by the floor's variant {name}."
    # The statement for the query on the rules' lines, registered without one.
    DIALOGUE.sql[name.replace("-", "_")] = f"WITH RECURSIVE {_READ_TURNS}, {floor_sql('read_turn', rules)} SELECT * FROM floor"


for _name in FLOORS:
    _floor(_name)

DIALOGUE.sql["composite_coalesce"] = f"""WITH RECURSIVE {_READ_TURNS}, {floor_sql('read_turn', FLOORS['alternation'])},
both_said AS (SELECT coalesce(l.speaker_id, o.speaker_id) AS who, CASE WHEN l.speaker_id IS NULL AND o.speaker_id IS NOT NULL THEN o.evidence ELSE l.evidence END AS e FROM lines l LEFT JOIN floor o ON l.book_id = o.book_id AND l.seq = o.seq WHERE l.kind = 'DIALOGUE')
SELECT CASE WHEN starts_with(e, 'tag names') THEN 'tag names' ELSE e END AS evidence, count(*) AS quotations, count(who) AS answered FROM both_said GROUP BY 1"""


@DIALOGUE.add(
    "spoken_two_party",
    f"""WITH {_SPOKEN}, part AS (SELECT *, seq // 2 AS part FROM spoken),
    party AS (SELECT *, list_sort(list_distinct(list(speaker_id) FILTER (speaker_id IS NOT NULL) OVER (PARTITION BY book_id, part))) AS who,
      coalesce(last_value(speaker_id IGNORE NULLS) OVER (PARTITION BY book_id, part ORDER BY seq, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        first_value(speaker_id IGNORE NULLS) OVER (PARTITION BY book_id, part ORDER BY seq, n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS near FROM part)
    SELECT book_id, seq, n, CASE WHEN near = who[1] THEN who[2] ELSE who[1] END AS inferred FROM party WHERE speaker_id IS NULL AND kind = 'DIALOGUE' AND len(who) = 2""",
)
def spoken_two_party(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of exchanges of two paragraphs with two known speakers, given to the other one."""
    told = A.two_party(spoken_lines(spark, folder).withColumn("part", F.floor(F.col("seq") / 2)), ["book_id", "part"])
    return told.where("inferred IS NOT NULL").select("book_id", "seq", "n", "inferred")


@DIALOGUE.add(
    "spoken_pace",
    f"""WITH {_SPOKEN}, w AS (SELECT p.book_id, p.truth, len(string_split_regex(trim(e.text), '[ ]+')) AS words FROM spoken p JOIN (SELECT book_id, seq, arg_min(text, entry_id) AS text FROM entries GROUP BY ALL) e ON p.book_id = e.book_id AND p.seq = e.seq
      WHERE kind = 'DIALOGUE' AND truth IS NOT NULL AND text IS NOT NULL)
    SELECT book_id, truth AS speaker_id, count(*) AS lines, round(greatest(0.85, least(1.2, avg(words) / 12)), 6) AS length_scale FROM w GROUP BY ALL HAVING count(*) >= 3""",
)
def spoken_pace(spark: SparkSession, folder: str) -> DataFrame:
    """The pace of speakers with at least three lines, by the words of the entries they speak in."""
    entries = table(spark, folder, "entries").where("book_id IS NOT NULL AND seq IS NOT NULL").groupBy("book_id", "seq").agg(F.min(F.struct("entry_id", "text")).alias("e"))
    said = spoken_lines(spark, folder).where("kind = 'DIALOGUE' AND truth IS NOT NULL").join(entries, ["book_id", "seq"]).where("e.text IS NOT NULL")
    words = F.avg(F.size(F.split(F.trim("e.text"), "[ ]+")))
    return said.groupBy("book_id", F.col("truth").alias("speaker_id")).agg(F.count("*").alias("lines"), F.round(C.pace(words), 6).alias("length_scale")).where(F.col("lines") >= C.LINES_LEAST)


@DIALOGUE.add(
    "spoken_conversion",
    f"""WITH RECURSIVE {_SPOKEN}, {_TAKEN}, a AS (SELECT book_id, seq, n, speaker_id, NULL::VARCHAR AS why FROM spoken WHERE speaker_id IS NOT NULL UNION ALL SELECT book_id, seq, n, who, why FROM t WHERE who IS NOT NULL)
    SELECT count(*) AS lines, count(a.speaker_id) AS answered, count(*) FILTER (WHERE a.speaker_id = s.truth) AS correct, count(*) FILTER (WHERE a.why IS NOT NULL) AS found FROM spoken s LEFT JOIN a ON s.book_id = a.book_id AND s.seq = a.seq AND s.n = a.n WHERE s.kind = 'DIALOGUE' AND truth IS NOT NULL""",
)
def spoken_conversion(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the spoken lines turn-taking answers, and how many of the answers agree with the readers."""
    found = turn_taking(spoken_lines(spark, folder)).where("kind = 'DIALOGUE' AND truth IS NOT NULL")
    return found.agg(F.count("*").alias("lines"), F.count("speaker_id").alias("answered"), F.count_if(F.col("speaker_id") == F.col("truth")).alias("correct"), F.count_if(F.col("tier") == "SCENE").alias("found"))


assert set(DIALOGUE.sql) - set(DIALOGUE.queries) <= set(SPEECH.queries)
