"""Queries about scenes and about the cast of a book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import estimated_tokens
from loomtext.operators import roster as R
from loomtext.operators.scenes import chapters_from_headings, scenes, split_scenes, turn_boundaries, with_scenes
from loomtext.operators.segments import paragraphs, segments
from loomtext.plans import sqltext as S
from loomtext.plans.registry import Registry
from loomtext.session import checkpointed
from loomtext.sources.tables import table

CAST = Registry()

_BREAK = f"regexp_full_match(text, '(?:{S.WHITE}|[*·•#~=_.,\\-‐‑‒–—―])*')"
_SCENED = f"""{S.PARAGRAPHS},
opened AS (SELECT *, CASE WHEN lag(seq) OVER w IS NULL OR lag(chapter) OVER w IS DISTINCT FROM chapter
    OR (lag({_BREAK}) OVER w AND NOT {_BREAK}) THEN 1 ELSE 0 END AS o FROM para WINDOW w AS (PARTITION BY book_id ORDER BY seq)),
natural_run AS (SELECT *, sum(o) OVER (PARTITION BY book_id ORDER BY seq) AS g FROM opened),
counted AS (SELECT *, (row_number() OVER (PARTITION BY book_id, g ORDER BY seq) - 1) // 400 AS k FROM natural_run),
scened AS (SELECT book_id, chapter, seq, text, min(seq) OVER (PARTITION BY book_id, g, k) AS scene_start FROM counted),
scene AS (SELECT book_id, scene_start, coalesce(lead(scene_start) OVER (PARTITION BY book_id ORDER BY scene_start), last + 1) AS scene_end, paragraphs
  FROM (SELECT book_id, scene_start, count(*) AS paragraphs, max(seq) AS last FROM scened GROUP BY ALL))"""


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs(table(spark, folder, "entries"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments(_paragraphs(spark, folder))


@CAST.add("scene_segment", f"WITH {_SCENED} SELECT * FROM scene")
def scene_segment(spark: SparkSession, folder: str) -> DataFrame:
    """Scenes of every book."""
    return scenes(_paragraphs(spark, folder))


@CAST.add(
    "scene_stats",
    f"""WITH {_SCENED}, n AS (SELECT book_id, count(*) AS n FROM scene GROUP BY 1)
    SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, median(n)::DOUBLE AS middle, count(*) AS books FROM n""",
)
def scene_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Scenes per book: least, most, mean and median."""
    n = scenes(_paragraphs(spark, folder)).groupBy("book_id").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("middle"), F.count("*").alias("books"))


@CAST.add(
    "scene_budget_share",
    f"""WITH {_SCENED}, t AS (SELECT book_id, scene_start, sum(ceil(length(text) / 4)::INT) AS tokens FROM scened GROUP BY ALL)
    SELECT book_id, count(*) AS scenes, count_if(tokens > 2048)::BIGINT AS over_budget, round(count_if(tokens > 2048) / count(*), 6) AS share FROM t GROUP BY 1""",
)
def scene_budget_share(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each book's scenes beyond 2,048 estimated tokens."""
    placed = with_scenes(_paragraphs(spark, folder))
    tokens = placed.groupBy("book_id", "scene_at").agg(F.sum(estimated_tokens(F.col("text"))).alias("tokens"))
    over = F.count_if(F.col("tokens") > 2048)
    return tokens.groupBy("book_id").agg(F.count("*").alias("scenes"), over.alias("over_budget"), F.round(over / F.count("*"), 6).alias("share"))


@CAST.add("scenes_partition", f"WITH {_SCENED} SELECT s.book_id, p.seq, count(*) AS scenes FROM para p JOIN scene s ON s.book_id = p.book_id AND p.seq >= scene_start AND p.seq < scene_end GROUP BY ALL HAVING count(*) <> 1")
def scenes_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that lie in no scene or in several: there are none."""
    paras = _paragraphs(spark, folder)
    return (
        with_scenes(paras)
        .join(scenes(paras), ["book_id", "scene_start"], "left")
        .groupBy("book_id", "seq")
        .agg(F.count_if((F.col("seq") >= F.col("scene_start")) & (F.col("seq") < F.col("scene_end"))).alias("scenes"))
        .where("scenes <> 1")
    )


@CAST.add(
    "chapter_reconstruct",
    f"""WITH {S.PARAGRAPHS} SELECT book_id, seq, greatest(0, sum(CASE WHEN regexp_matches({S.strip('text')}, '(?i)\\A(?:(?:chapter|book|part|volume)\\b.*|[ivxlcdm]+\\.?|[0-9]+\\.?)\\z') THEN 1 ELSE 0 END)
      OVER (PARTITION BY book_id ORDER BY seq) - 1)::BIGINT AS part FROM para""",
)
def chapter_reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """The number of each paragraph's part, counted from headings alone."""
    return chapters_from_headings(_paragraphs(spark, folder)).select("book_id", "seq", "part")


def _talking(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs in scenes with ``talks`` and ``speaker``, the last name tagged in it."""
    paras = _paragraphs(spark, folder)
    talk = R.tagged(segments(paras)).groupBy("book_id", "seq").agg(F.lit(True).alias("talks"), F.max_by("tagged", F.when(F.col("tagged").isNotNull(), F.col("n"))).alias("speaker"))
    # Joined before the scenes are laid out: both sides still lie as the paragraphs do.
    return with_scenes(paras.join(talk, ["book_id", "seq"], "left").withColumn("talks", F.coalesce("talks", F.lit(False))))


_TURNS = f"""{S.SEGMENTS.replace(S.PARAGRAPHS, _SCENED)},
talk AS (SELECT DISTINCT book_id, seq FROM seg WHERE kind = 'DIALOGUE'),
numbered AS (SELECT s.*, t.seq IS NOT NULL AS talks, row_number() OVER (PARTITION BY s.book_id, scene_start ORDER BY s.seq) AS i FROM scened s LEFT JOIN talk t ON s.book_id = t.book_id AND s.seq = t.seq),
turned AS (SELECT *, i = 1 OR (NOT talks AND i - coalesce(max(CASE WHEN talks THEN i END) OVER (PARTITION BY book_id, scene_start ORDER BY seq), 0) > 2) AS boundary FROM numbered)"""


@CAST.add("turn_boundaries", f"WITH {_TURNS} SELECT book_id, scene_start, seq, boundary FROM turned")
def turn_boundaries_query(spark: SparkSession, folder: str) -> DataFrame:
    """Where an exchange may be cut."""
    return turn_boundaries(_talking(spark, folder), F.col("talks")).select("book_id", "scene_start", "seq", "boundary")


_SPLIT = f"""{_TURNS},
spoke AS (SELECT book_id, seq, arg_max({S.tag_name('before', 'after')}, n) FILTER ({S.tag_name('before', 'after')} IS NOT NULL) AS speaker FROM seg WHERE kind = 'DIALOGUE' GROUP BY ALL),
whole AS (SELECT t.book_id, t.scene_start, list(t.seq ORDER BY t.seq) AS seqs, list(boundary ORDER BY t.seq) AS turns, list(talks ORDER BY t.seq) AS talks, list(speaker ORDER BY t.seq) AS who,
  list(spent ORDER BY t.seq) AS spent, count(*) AS size FROM (SELECT *, sum(ceil(length(text) / 4)) OVER (PARTITION BY book_id, scene_start ORDER BY seq)::BIGINT AS spent FROM turned) t LEFT JOIN spoke USING (book_id, seq) GROUP BY ALL),
cuts AS (
  SELECT book_id, scene_start, 0::BIGINT AS low, NULL::BIGINT AS before, true AS clean FROM whole
  UNION ALL
  SELECT book_id, scene_start, coalesce(turn, quiet, stop), low, turn IS NOT NULL OR quiet IS NOT NULL FROM (
    SELECT *, list_max(list_filter(range(low + 1, stop + 1), lambda i: turns[i + 1])) AS turn, list_max(list_filter(range(low + 1, stop + 1), lambda i: NOT talks[i + 1])) AS quiet FROM (
      SELECT c.book_id, c.scene_start, low, turns, talks, size, greatest(low + 1, len(list_filter(spent, lambda s: s <= CASE WHEN low = 0 THEN 0 ELSE spent[low] END + 2048))) AS stop FROM cuts c JOIN whole w ON c.book_id = w.book_id AND c.scene_start = w.scene_start)
    WHERE stop < size)),
bounds AS (SELECT *, lead(low) OVER (PARTITION BY book_id, scene_start ORDER BY low) AS high FROM cuts)"""


@CAST.add(
    "scene_split",
    f"""WITH RECURSIVE {_SPLIT} SELECT b.book_id, b.scene_start, seqs[low + 1] AS piece_start, CASE WHEN high IS NULL THEN scene_end ELSE seqs[high + 1] END::INT AS piece_end,
    list_filter(who[before + 1:low], lambda s: s IS NOT NULL)[-1] AS carried_speaker, clean AS at_turn_boundary FROM bounds b JOIN whole w ON b.book_id = w.book_id AND b.scene_start = w.scene_start JOIN scene s ON b.book_id = s.book_id AND b.scene_start = s.scene_start""",
)
def scene_split(spark: SparkSession, folder: str) -> DataFrame:
    """Scenes cut to 2,048 estimated tokens."""
    turned = turn_boundaries(_talking(spark, folder).withColumn("cost", estimated_tokens(F.col("text"))), F.col("talks"))
    return split_scenes(turned, 2048)


@CAST.add(
    "scene_texts",
    f"WITH {_SCENED} SELECT book_id, scene_start, array_to_string(list(text ORDER BY seq), chr(10)) AS scene_text FROM scened GROUP BY ALL",
)
def scene_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every scene."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return with_scenes(_paragraphs(spark, folder)).groupBy("book_id", "scene_at", "scene_start").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("scene_text")).drop("scene_at")


_ROSTER = f"""{S.SEGMENTS},
said AS (SELECT *, {S.tag_name('before', 'after')} AS tagged FROM seg WHERE kind = 'DIALOGUE'),
tags AS (SELECT book_id, tagged AS name, count(*) AS n_tags FROM said WHERE tagged IS NOT NULL GROUP BY ALL),
around AS (SELECT book_id, unnest([{S.plain_sentences(S.without_quoted('before'))}[-1], {S.plain_sentences(S.without_quoted('after'))}[1]]) AS s FROM said WHERE tagged IS NULL),
near AS (SELECT book_id, name, count(*) AS n_near FROM (SELECT book_id, unnest({S.names_in('s')}) AS name FROM around WHERE s IS NOT NULL)
  WHERE (book_id, name) NOT IN (SELECT (book_id, name) FROM tags) GROUP BY ALL)"""

_VOTES = f"""{_ROSTER},
narration AS (SELECT book_id, seq, array_to_string(list(run ORDER BY n), ' ') AS t FROM seg WHERE kind = 'NARRATION' GROUP BY ALL),
sent AS (SELECT book_id, seq, i, s[i] AS sentence FROM (SELECT book_id, seq, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT book_id, seq, {S.plain_sentences('t')} AS s FROM narration))),
named AS (SELECT *, {S.names_in('sentence')} AS names, {S.pronoun_gender('sentence')} AS gender FROM sent),
pend AS (SELECT *, last_value(CASE WHEN len(names) = 1 THEN names[1] WHEN len(names) > 1 THEN '' END IGNORE NULLS)
  OVER (PARTITION BY book_id ORDER BY seq, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending FROM named),
marked AS (SELECT *, regexp_replace(sentence, CASE gender WHEN 'FEMALE' THEN {S.text(S.FEMALE)} ELSE {S.text(S.MALE)} END || '[\\s\\S]*', '') AS mark FROM pend WHERE gender IS NOT NULL),
held AS (SELECT *, list_filter(list_transform(list_distinct(names), lambda x: {{'rest': length(mark) - length(x) + 1 - (length(mark) - length(x) + 2 - instr(reverse(mark), reverse(x))) , 'name': x}}), lambda y: contains(mark, y.name)) AS near_names FROM marked),
vote AS (SELECT book_id, gender, len(names) <= 1 AS strong, CASE WHEN len(names) = 1 THEN names[1] WHEN len(names) = 0 THEN nullif(pending, '') ELSE list_sort(near_names)[1].name END AS name FROM held)"""


@CAST.add("roster_tags", f"WITH {_ROSTER} SELECT * FROM tags")
def roster_tags(spark: SparkSession, folder: str) -> DataFrame:
    """How often each name is tagged as a speaker."""
    return R.tag_counts(R.quotations(_segments(spark, folder)))


@CAST.add("roster_adjacency", f"WITH {_ROSTER} SELECT * FROM near")
def roster_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    """How often each untagged name stands near a quotation."""
    return R.near_counts(checkpointed(R.quotations(_segments(spark, folder))))


@CAST.add("roster_votes", f"WITH {_VOTES} SELECT book_id, name, gender, strong, count(*) AS votes FROM vote WHERE name IS NOT NULL GROUP BY ALL")
def roster_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Pronouns' votes on each name's gender."""
    return R.gender_votes(_segments(spark, folder)).groupBy("book_id", "name", "gender", "strong").agg(F.count("*").alias("votes"))


_GENDERS = f"""{_VOTES},
tally AS (SELECT book_id, name, strong, count_if(gender = 'FEMALE') AS f, count_if(gender = 'MALE') AS m FROM vote WHERE name IS NOT NULL GROUP BY ALL),
best AS (SELECT *, greatest(f, m) AS b, greatest(f, m) / (f + m) AS share, CASE WHEN f > m THEN 'FEMALE' WHEN m > f THEN 'MALE' END AS gender FROM tally),
titled AS (SELECT book_id, name, g AS gender FROM (SELECT book_id, name, {S.title_gender('name')} AS g FROM (SELECT book_id, name FROM tags UNION ALL SELECT book_id, name FROM near)) WHERE g IS NOT NULL),
voted AS (SELECT book_id, name, gender FROM best WHERE strong AND b >= 1 AND share >= 0.6),
guessed AS (SELECT book_id, name, gender FROM best WHERE NOT strong AND b >= 3 AND share >= 0.75),
gendered AS (SELECT * FROM (SELECT k.book_id, k.name, coalesce(t.gender, v.gender, g.gender) AS gender, CASE WHEN t.gender IS NOT NULL THEN 'title' WHEN v.gender IS NOT NULL THEN 'voted' ELSE 'guessed' END AS rule
  FROM (SELECT book_id, name FROM titled UNION SELECT book_id, name FROM voted UNION SELECT book_id, name FROM guessed) k
  LEFT JOIN titled t USING (book_id, name) LEFT JOIN voted v USING (book_id, name) LEFT JOIN guessed g USING (book_id, name)) WHERE gender IS NOT NULL)"""


@CAST.add("roster_genders", f"WITH {_GENDERS} SELECT * FROM gendered")
def roster_genders(spark: SparkSession, folder: str) -> DataFrame:
    """Each name's gender and the rule that told it."""
    rows = checkpointed(R.read_once(_segments(spark, folder)))
    return R.genders(rows, rows.where("kind = 'DIALOGUE'").select("book_id", "seq", "n", "tagged", "near"))


@CAST.add(
    "roster_manifest",
    f"""WITH {_GENDERS}, cast_of AS (SELECT book_id, name, n_tags AS lines, 1.0::DOUBLE AS confidence FROM tags UNION ALL SELECT book_id, name, n_near, 0.6::DOUBLE FROM near WHERE n_near >= 8)
    SELECT c.book_id, c.name, coalesce(g.gender, 'UNKNOWN') AS gender, c.confidence, c.lines FROM cast_of c LEFT JOIN gendered g USING (book_id, name)""",
)
def roster_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The cast of every book from its text."""
    return R.roster(_segments(spark, folder))
