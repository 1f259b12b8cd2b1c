"""Queries about who speaks, and how well that is told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions.text import leaves_quotation_open, opens_quotation
from loomtext.operators import attribution as A
from loomtext.operators import scoring as G
from loomtext.operators.ordered import running_sum
from loomtext.operators.scenes import with_scenes
from loomtext.operators.segments import paragraphs, segments
from loomtext.operators.turns import FLOORS, alternation, turn_taking
from loomtext.plans import sqltext as S
from loomtext.plans.registry import Registry
from loomtext.sources.tables import table

SPEECH = Registry()
LINE = ["book_id", "seq", "n", "kind", "speaker_id", "confidence", "tier", "evidence"]


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments(paragraphs(table(spark, folder, "entries")))


def _lines(spark: SparkSession, folder: str, **rules: bool) -> DataFrame:
    return A.by_rules(_segments(spark, folder), table(spark, folder, "manifest_characters"), **rules)


def _rules_sql(pronouns: bool = True, beats: bool = True) -> str:
    beat = S.names_in(S.plain_sentences("before") + "[-1]") if beats else "[]::VARCHAR[]"
    return f"""{S.SEGMENTS},
castn AS (SELECT book_id, lower(name) AS name, arg_min(char_id, (rec_id, i)) AS char_id FROM (
    SELECT book_id, char_id, rec_id, i, x[i + 1] AS name FROM (SELECT *, unnest(generate_series(0, len(x) - 1)) AS i FROM
      (SELECT book_id, char_id, rec_id, list_filter(list_concat([display_name], coalesce(aliases, [])), lambda a: a IS NOT NULL AND a <> '') AS x FROM manifest_characters))) GROUP BY ALL),
alone AS (SELECT book_id, upper(gender) AS gender, min(char_id) AS char_id FROM manifest_characters WHERE upper(gender) IN ('FEMALE', 'MALE') GROUP BY ALL HAVING count(*) = 1),
rd AS (SELECT *, CASE WHEN kind = 'DIALOGUE' THEN {S.tag_name('before', 'after')} END AS tag, CASE WHEN kind = 'DIALOGUE' THEN {S.tag_pronoun('before', 'after')} END AS pron,
    CASE WHEN kind = 'DIALOGUE' THEN {beat} END AS beat FROM seg),
ask AS (SELECT book_id, seq, n, i, lower(x[i]) AS folded FROM (SELECT *, unnest(generate_series(1, len(x))) AS i FROM
    (SELECT book_id, seq, n, CASE WHEN tag IS NOT NULL THEN [tag] WHEN pron IS NULL THEN beat ELSE [] END AS x FROM rd WHERE kind = 'DIALOGUE'))),
hit AS (SELECT a.book_id, a.folded, arg_max(c.char_id, length(c.name)) AS char_id FROM (SELECT DISTINCT book_id, folded FROM ask) a JOIN castn c ON a.book_id = c.book_id AND suffix(a.folded, c.name) GROUP BY ALL),
known AS (SELECT book_id, seq, n, arg_min(char_id, i) AS known FROM ask JOIN hit USING (book_id, folded) GROUP BY ALL),
ruled AS (SELECT r.*, k.known, {'o.char_id' if pronouns else 'NULL'} AS single FROM rd r LEFT JOIN known k ON r.book_id = k.book_id AND r.seq = k.seq AND r.n = k.n
    LEFT JOIN alone o ON r.book_id = o.book_id AND o.gender = CASE r.pron WHEN 'she' THEN 'FEMALE' WHEN 'he' THEN 'MALE' END),
line AS (SELECT book_id, chapter, seq, lead, n, kind, run, before, after, run_start,
    CASE WHEN kind = 'NARRATION' THEN NULL WHEN tag IS NOT NULL THEN known WHEN pron IS NOT NULL THEN single ELSE known END AS speaker_id,
    CASE WHEN kind = 'NARRATION' THEN 'NARRATOR' WHEN tag IS NOT NULL THEN CASE WHEN known IS NULL THEN 'NONE' ELSE 'HEURISTIC' END
      WHEN pron IS NOT NULL THEN CASE WHEN single IS NULL THEN 'NONE' ELSE 'HEURISTIC' END WHEN known IS NOT NULL THEN 'HEURISTIC' ELSE 'NONE' END AS tier,
    CASE WHEN kind = 'NARRATION' THEN 'narration' WHEN tag IS NOT NULL AND known IS NOT NULL THEN 'speech tag' WHEN tag IS NOT NULL THEN 'tag names ' || tag || ', not in cast'
      WHEN pron IS NOT NULL AND single IS NOT NULL THEN 'pronoun tag, one candidate' WHEN pron IS NOT NULL THEN 'pronoun speech tag' WHEN known IS NOT NULL THEN 'action beat' ELSE 'no tag' END AS evidence FROM ruled),
lines AS (SELECT *, CASE evidence WHEN 'speech tag' THEN 0.95 WHEN 'pronoun tag, one candidate' THEN 0.85 WHEN 'action beat' THEN 0.75 ELSE 0 END::DOUBLE AS confidence FROM line)"""


_RULES = _rules_sql()
_COLUMNS = ", ".join(LINE)


@SPEECH.add("heuristic_cascade", f"WITH {_RULES} SELECT {_COLUMNS} FROM lines")
def heuristic_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Every run with the speaker that the rules find."""
    return _lines(spark, folder).select(*LINE)


@SPEECH.add("heuristic_nopronouns", f"WITH {_rules_sql(pronouns=False)} SELECT {_COLUMNS} FROM lines")
def heuristic_nopronouns(spark: SparkSession, folder: str) -> DataFrame:
    """The rules without pronouns."""
    return _lines(spark, folder, pronouns=False).select(*LINE)


@SPEECH.add("heuristic_tags_only", f"WITH {_rules_sql(pronouns=False, beats=False)} SELECT {_COLUMNS} FROM lines")
def heuristic_tags_only(spark: SparkSession, folder: str) -> DataFrame:
    """The rules on speech tags alone."""
    return _lines(spark, folder, pronouns=False, beats=False).select(*LINE)


@SPEECH.add("demote_unresolved", f"WITH {_RULES} SELECT CASE tier WHEN 'NONE' THEN 'NARRATOR' ELSE tier END AS tier, count(*) AS runs FROM lines GROUP BY 1")
def demote_unresolved(spark: SparkSession, folder: str) -> DataFrame:
    """Runs by tier once unresolved ones go to the narrator."""
    return A.demoted(_lines(spark, folder)).groupBy("tier").agg(F.count("*").alias("runs"))


@SPEECH.add(
    "tier_counts",
    f"""WITH {_RULES} SELECT tier, (list_position(['HEURISTIC', 'SLM', 'SCENE', 'NARRATOR', 'NONE'], tier) - 1)::INT AS ordinal, count(*) AS runs FROM lines GROUP BY ALL ORDER BY ordinal""",
)
def tier_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Runs by tier, the cheapest first."""
    order = F.array(*map(F.lit, ["HEURISTIC", "SLM", "SCENE", "NARRATOR", "NONE"]))
    counts = _lines(spark, folder).groupBy("tier").agg(F.count("*").alias("runs"))
    return counts.select("tier", (F.array_position(order, F.col("tier")) - 1).cast("int").alias("ordinal"), "runs").orderBy("ordinal")


@SPEECH.add(
    "coverage_fraction",
    f"""WITH {_RULES} SELECT book_id, count_if(kind = 'DIALOGUE')::BIGINT AS dialogue, count_if(kind = 'DIALOGUE' AND speaker_id IS NOT NULL)::BIGINT AS resolved,
    CASE WHEN count_if(kind = 'DIALOGUE') > 0 THEN round(count_if(kind = 'DIALOGUE' AND speaker_id IS NOT NULL) / count_if(kind = 'DIALOGUE'), 6) ELSE 0 END::DOUBLE AS fraction FROM lines GROUP BY 1""",
)
def coverage_fraction(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each book's dialogue that has a speaker."""
    said = F.count_if(F.col("kind") == "DIALOGUE")
    told = F.count_if((F.col("kind") == "DIALOGUE") & F.col("speaker_id").isNotNull())
    return _lines(spark, folder).groupBy("book_id").agg(said.alias("dialogue"), told.alias("resolved"), G.ratio(told, said).alias("fraction"))


_TWO = f"""{_RULES},
party AS (SELECT *, list_sort(list_distinct(list(speaker_id) FILTER (speaker_id IS NOT NULL) OVER (PARTITION BY book_id, chapter))) AS who,
    coalesce(last_value(speaker_id IGNORE NULLS) OVER (PARTITION BY book_id, chapter ORDER BY seq, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      first_value(speaker_id IGNORE NULLS) OVER (PARTITION BY book_id, chapter ORDER BY seq, n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS near FROM lines),
inferred AS (SELECT *, CASE WHEN speaker_id IS NULL AND kind = 'DIALOGUE' AND len(who) = 2 THEN CASE WHEN near = who[1] THEN who[2] ELSE who[1] END END AS guess FROM party)"""


@SPEECH.add("scene_inference", f"WITH {_TWO} SELECT book_id, seq, n, guess AS inferred FROM inferred WHERE guess IS NOT NULL")
def scene_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of chapters with two known speakers, given to the other one."""
    told = A.two_party(_lines(spark, folder), ["book_id", "chapter"])
    return told.where("inferred IS NOT NULL").select("book_id", "seq", "n", "inferred")


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """The readers' spans as another candidate's answers: of each quotation the speaker of the span that overlaps most."""
    quotes = _segments(spark, folder).where("kind = 'DIALOGUE'").select(
        F.struct("book_id", "seq", "n").alias("qid"), "book_id", "seq", "n", (F.col("lead") + F.col("run_start")).alias("q0"), (F.col("lead") + F.col("run_start") + F.length("run")).alias("q1")
    )
    spans = table(spark, folder, "spans").where("kind = 1 AND span_start < span_end")
    spans = spans.select("book_id", "seq", "ordinal", F.col("span_start").alias("s0"), F.col("span_end").alias("s1"), F.struct("speaker_id", "confidence").alias("said"))
    best = G.best_overlap(quotes, spans, ["book_id", "seq"], ("q0", "q1"), ("s0", "s1"), F.col("said"), ["ordinal", "s0"], "best")
    return best.select("book_id", "seq", "n", F.col("best.speaker_id").alias("answer"), F.col("best.confidence").alias("score"))


_ANSWERS = """
quo AS (SELECT book_id, seq, n, lead + run_start AS q0, lead + run_start + length(run) AS q1 FROM seg WHERE kind = 'DIALOGUE'),
spn AS (SELECT DISTINCT book_id, seq, ordinal, span_start AS s0, span_end AS s1, speaker_id, confidence FROM spans WHERE kind = 1 AND span_start < span_end),
met AS (SELECT q.book_id, q.seq, q.n, s.*, least(q1, s1) - greatest(q0, s0) AS shared FROM quo q JOIN spn s ON q.book_id = s.book_id AND q.seq = s.seq WHERE least(q1, s1) > greatest(q0, s0)),
top AS (SELECT book_id, seq, n, arg_max({'a': speaker_id, 'c': confidence}, (shared, -ordinal, -s0)) AS b FROM met GROUP BY ALL),
ans AS (SELECT q.book_id, q.seq, q.n, b.a AS answer, b.c AS score FROM quo q LEFT JOIN top t ON q.book_id = t.book_id AND q.seq = t.seq AND q.n = t.n)"""


@SPEECH.add("best_overlap", f"WITH {S.SEGMENTS}, {_ANSWERS} SELECT * FROM ans")
def best_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Each quotation with the speaker and confidence of the span that overlaps it most."""
    return _answers(spark, folder)


@SPEECH.add(
    "slm_cascade",
    f"""WITH {_TWO}, {_ANSWERS},
    asked AS (SELECT i.*, a.answer, a.score, a.answer IS NOT NULL AND a.score >= 0.65 AS sure, coalesce(a.score >= 0.40, true) AS fair FROM inferred i
      LEFT JOIN ans a ON i.book_id = a.book_id AND i.seq = a.seq AND i.n = a.n WHERE tier = 'NONE'),
    told AS (SELECT *, coalesce(sure, false) AS ok, CASE WHEN sure THEN answer WHEN fair THEN guess END AS spk FROM asked)
    SELECT tier, evidence, count(*) AS runs, round(avg(confidence), 6) AS confidence FROM (
      SELECT tier, CASE WHEN starts_with(evidence, 'tag names') THEN 'tag names' ELSE evidence END AS evidence, confidence FROM lines WHERE tier <> 'NONE'
      UNION ALL SELECT CASE WHEN ok THEN 'SLM' WHEN spk IS NOT NULL THEN 'SCENE' ELSE 'NARRATOR' END, CASE WHEN ok THEN 'model' WHEN spk IS NOT NULL THEN 'two speakers' ELSE 'nobody' END,
        CASE WHEN ok THEN score WHEN spk IS NOT NULL THEN coalesce(score, 0.40) ELSE 0 END FROM told) GROUP BY ALL""",
)
def slm_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Rules first, then a model's sure answers, then the two-speaker inference, else the narrator: runs by tier and evidence."""
    inferred = A.two_party(_lines(spark, folder), ["book_id", "chapter"])
    told = A.gated(inferred, _answers(spark, folder))
    evidence = F.when(F.startswith("evidence", F.lit("tag names")), "tag names").otherwise(F.col("evidence")).alias("evidence")
    return told.groupBy("tier", evidence).agg(F.count("*").alias("runs"), F.round(F.avg("confidence"), 6).alias("confidence"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Quotations whose truth the readers' spans tell, with the rules' answer."""
    place = ["book_id", "seq", "n"]
    truth = _answers(spark, folder).where("answer IS NOT NULL").select(*place, F.col("answer").alias("truth"))
    given = _lines(spark, folder).where("kind = 'DIALOGUE'")
    kind = F.when(F.startswith("evidence", F.lit("tag names")), "tag names").otherwise(F.col("evidence"))
    return given.join(truth, place).select(*place, "chapter", kind.alias("evidence"), F.col("speaker_id").alias("answer"), "truth", "confidence")


_SCORED = f"""{_RULES}, {_ANSWERS},
sc AS (SELECT l.book_id, l.seq, l.n, l.chapter, CASE WHEN starts_with(evidence, 'tag names') THEN 'tag names' ELSE evidence END AS evidence, speaker_id AS answer, a.answer AS truth, confidence
  FROM lines l JOIN ans a ON l.book_id = a.book_id AND l.seq = a.seq AND l.n = a.n WHERE l.kind = 'DIALOGUE' AND a.answer IS NOT NULL)"""
_TALLY = """count(*) AS scored, count(answer) AS answered, count(*) FILTER (WHERE answer = truth) AS correct, round(count(answer) / count(*), 6) AS coverage,
  CASE WHEN count(answer) > 0 THEN round(count(*) FILTER (WHERE answer = truth) / count(answer), 6) ELSE 0 END::DOUBLE AS precision, round(count(*) FILTER (WHERE answer = truth) / count(*), 6) AS accuracy,
  round((count(answer) - count(*) FILTER (WHERE answer = truth)) / count(*), 6) AS wrong"""


@SPEECH.add("attribution_tally", f"WITH {_SCORED} SELECT evidence, {_TALLY} FROM sc GROUP BY ROLLUP (evidence)")
def attribution_tally(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage, precision and accuracy of the rules by evidence, and of all."""
    return G.scored(_scored(spark, folder), ["evidence"], totals=True)


@SPEECH.add("bakeoff_by_book", f"WITH {_SCORED} SELECT book_id, {_TALLY}, rank() OVER (ORDER BY round(count(*) FILTER (WHERE answer = truth) / count(*), 6) DESC)::INT AS place FROM sc GROUP BY book_id")
def bakeoff_by_book(spark: SparkSession, folder: str) -> DataFrame:
    """The same for each book, with its place by accuracy."""
    by_book = G.scored(_scored(spark, folder), ["book_id"])
    # Accuracies are millionths, so the books with a better one are a running sum over at most a million steps, in blocks.
    worse = (F.lit(1_000_000) - F.round(F.col("accuracy") * 1_000_000)).cast("int")
    steps = by_book.groupBy("accuracy").agg(F.count("*").alias("k")).select("accuracy", "k", worse.alias("worse"), F.lit(1).alias("one"))
    places = running_sum(steps, ["one"], "worse", F.col("k"), "upto").select("accuracy", (F.col("upto") - F.col("k") + 1).cast("int").alias("place"))
    return by_book.join(places, "accuracy")


@SPEECH.add(
    "bakeoff_axes",
    f"""WITH {_SCORED}, ax AS (SELECT s.*, unnest(list_filter([CASE WHEN b.lang = 'en' THEN 'english' END, CASE WHEN b.lang <> 'en' THEN 'other language' END, CASE WHEN b.lang IS NULL THEN 'no language' END,
      CASE WHEN b.author IS NULL THEN 'no author' END], lambda x: x IS NOT NULL)) AS axis FROM sc s JOIN books b USING (book_id))
    SELECT axis, {_TALLY} FROM ax GROUP BY 1 UNION ALL SELECT 'all' AS axis, {_TALLY} FROM sc SEMI JOIN books b ON sc.book_id = b.book_id""",
)
def bakeoff_axes(spark: SparkSession, folder: str) -> DataFrame:
    """The same on overlapping groups of books, and on all."""
    answers = _scored(spark, folder).join(table(spark, folder, "books").select("book_id", "lang", "author"), "book_id")
    axes = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(F.col("lang") == "en", "english"),
            F.when(F.col("lang") != "en", "other language"),
            F.when(F.col("lang").isNull(), "no language"),
            F.when(F.col("author").isNull(), "no author"),
        )
    )
    return G.scored(answers.withColumn("axis", F.explode(axes)), ["axis"])


@SPEECH.add(
    "threshold_sweep",
    f"""WITH {_SCORED}, t AS (SELECT unnest([0.0, 0.5, 0.75, 0.85, 0.9, 0.99])::DOUBLE AS least), s AS (SELECT least, CASE WHEN confidence >= least THEN answer END AS answer, truth FROM sc CROSS JOIN t)
    SELECT least, {_TALLY} FROM s GROUP BY 1""",
)
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """The tally at each least confidence, from one pass over the answers."""
    levels = F.explode(F.array(*map(F.lit, [0.0, 0.5, 0.75, 0.85, 0.9, 0.99])))
    swept = _scored(spark, folder).withColumn("least", levels).withColumn("answer", F.when(F.col("confidence") >= F.col("least"), F.col("answer")))
    return G.scored(swept, ["least"])


@SPEECH.add(
    "paired_conditions",
    f"""WITH {_SCORED}, o AS (SELECT evidence, (answer IS NOT NULL)::INT AS a, coalesce(answer = truth, false)::INT AS r, (truth = last_truth)::INT AS b FROM
      (SELECT *, lag(truth) OVER (PARTITION BY book_id, seq ORDER BY n) AS last_truth FROM sc) WHERE last_truth IS NOT NULL)
    SELECT evidence, count(*) AS shared, sum(r)::BIGINT AS rules_right, sum(b)::BIGINT AS repeat_right, sum(r * b)::BIGINT AS both_right FROM o GROUP BY 1""",
)
def paired_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """On the quotations that both can answer: the rules against repeating the paragraph's last speaker."""
    repeat = F.lag("truth").over(Window.partitionBy("book_id", "seq").orderBy("n"))
    shared = _scored(spark, folder).withColumn("repeat", repeat).where("repeat IS NOT NULL")
    right, again = F.coalesce(F.col("answer") == F.col("truth"), F.lit(False)), F.col("repeat") == F.col("truth")
    return shared.groupBy("evidence").agg(
        F.count("*").alias("shared"), F.count_if(right).alias("rules_right"), F.count_if(again).alias("repeat_right"), F.count_if(right & again).alias("both_right")
    )


@SPEECH.add("turn_taking_by_chapter")
def turn_taking_by_chapter(spark: SparkSession, folder: str) -> DataFrame:
    """Runs by tier and the first words of the evidence, after turn-taking within each chapter."""
    cast = table(spark, folder, "manifest_characters").select("book_id", F.col("char_id").alias("speaker_id"))
    lines = _lines(spark, folder).select("chapter", *LINE)
    return turn_taking(lines, cast).select(*LINE)


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    paras = with_scenes(paragraphs(table(spark, folder, "entries"))).select(
        "book_id", "seq", "scene_start", opens_quotation(F.col("text")).alias("opens"), leaves_quotation_open(F.col("text")).alias("leaves_open")
    )
    said = _lines(spark, folder).where("kind = 'DIALOGUE'").groupBy("book_id", "chapter", "seq").agg(F.sort_array(F.collect_list(F.struct("n", "speaker_id", "evidence"))).alias("q"))
    return said.select("book_id", "chapter", "seq", F.col("q.speaker_id").alias("speakers"), F.col("q.evidence").alias("evidence")).join(paras, ["book_id", "seq"])


def _floor(name: str) -> None:
    @SPEECH.add(name.replace("-", "_"))
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return alternation(_turns(spark, folder), FLOORS[name])

    query.__doc__ = f"Untagged turns answered by the floor's variant {name}."


for _name in FLOORS:
    _floor(_name)


@SPEECH.add("composite_coalesce")
def composite_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    """The rules' answer, else the alternation's: quotations by evidence."""
    rules = _lines(spark, folder).where("kind = 'DIALOGUE'").select("book_id", "seq", "n", "speaker_id", "evidence")
    floor = alternation(_turns(spark, folder)).withColumnsRenamed({"speaker_id": "s", "evidence": "e"})
    passed = rules.select("book_id", "seq", "n").join(floor, ["book_id", "seq"]).withColumnsRenamed({"s": "speaker_id", "e": "evidence"})
    both = A.first_answer(rules, passed)
    kind = F.when(F.startswith("evidence", F.lit("tag names")), "tag names").otherwise(F.col("evidence"))
    return both.groupBy(kind.alias("evidence")).agg(F.count("*").alias("quotations"), F.count("speaker_id").alias("answered"))
