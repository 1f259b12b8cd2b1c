"""Queries on casts and conventions of a corpus: aliases, enrichment, conformance, mentions, chains of references."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomtext.functions.text import WHITE, WORDLIKE, leaves_quotation_open, opens_quotation, word_set
from loomtext.operators.ordered import neighbour
from loomtext.operators.scoring import ratio
from loomtext.operators.segments import paragraphs, segments
from loomtext.plans import sqltext as S
from loomtext.plans.registry import Registry
from loomtext.plans.speech import _RULES, _lines
from loomtext.session import checkpointed
from loomtext.sources.tables import table

CORPUS = Registry()


def _aliases(spark: SparkSession, folder: str) -> DataFrame:
    """``book_id``, ``char_id``, ``name`` of display names and aliases."""
    rows = table(spark, folder, "manifest_characters")
    names = F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return rows.select("book_id", "char_id", F.explode(F.array_distinct(names)).alias("name")).where("name IS NOT NULL")


_ALIASES = """al AS (SELECT book_id, char_id, name FROM (SELECT book_id, char_id, unnest(list_distinct(list_concat([display_name], coalesce(aliases, [])))) AS name FROM manifest_characters) WHERE name IS NOT NULL)"""
_WORDS = "list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z ]', ' ', 'g'), ' +'), lambda w: w <> '')))"


@CORPUS.add("alias_unique_owner", f"WITH {_ALIASES} SELECT book_id, lower(name) AS alias, min(char_id) AS owner FROM al GROUP BY ALL HAVING count(DISTINCT char_id) = 1")
def alias_unique_owner(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases that one character of a book alone goes by."""
    owned = _aliases(spark, folder).groupBy("book_id", F.lower("name").alias("alias")).agg(F.min("char_id").alias("owner"), F.max("char_id").alias("last"))
    return owned.where("owner = last").drop("last")


@CORPUS.add(
    "alias_identity",
    f"""WITH {_ALIASES}, k AS (SELECT book_id, char_id, array_to_string({_WORDS.format(x='name')}, ' ') AS key FROM al),
    o AS (SELECT book_id, key, min(char_id) AS owner FROM k WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT char_id) = 1),
    p AS (SELECT DISTINCT book_id, n, array_to_string({_WORDS.format(x='n')}, ' ') AS key FROM (SELECT book_id, unnest(aliases) AS n FROM manifest_characters) WHERE n IS NOT NULL)
    SELECT p.book_id, n AS said, owner FROM p JOIN o USING (book_id, key)""",
)
def alias_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Who each alias stands for, by its words in any order, where they stand for one character."""
    key = F.array_join(word_set(F.col("name")), " ")
    owners = _aliases(spark, folder).select("book_id", "char_id", key.alias("key")).where("key <> ''").groupBy("book_id", "key").agg(F.min("char_id").alias("owner"), F.max("char_id").alias("last")).where("owner = last")
    said = table(spark, folder, "manifest_characters").select("book_id", F.explode("aliases").alias("name")).where("name IS NOT NULL").distinct().withColumn("key", key)
    return said.join(owners, ["book_id", "key"]).select("book_id", F.col("name").alias("said"), "owner")


_SUBSET = f"""w AS (SELECT rec_id, book_id, display_name AS name, {_WORDS.format(x='display_name')} AS words FROM manifest_characters WHERE display_name IS NOT NULL)"""


@CORPUS.add(
    "name_subset_match",
    f"""WITH {_SUBSET}, d AS (SELECT DISTINCT book_id, words FROM w WHERE len(words) > 0)
    SELECT a.book_id, array_to_string(a.words, ' ') AS small_words, array_to_string(b.words, ' ') AS large_words FROM d a JOIN d b ON a.book_id = b.book_id AND len(a.words) < len(b.words) AND len(list_intersect(a.words, b.words)) = len(a.words)""",
)
def name_subset_match(spark: SparkSession, folder: str) -> DataFrame:
    """Names of a book whose words are all among another's.

    The pairs meet through the smaller name's rarest word, of which every superset has one.
    """
    names = table(spark, folder, "manifest_characters").where("display_name IS NOT NULL").select("book_id", word_set(F.col("display_name")).alias("words")).distinct().where(F.size("words") > 0)
    by_word = names.select("book_id", "words", F.explode("words").alias("w"))
    count = by_word.groupBy("book_id", "w").agg(F.count("*").alias("n"))
    rarest = by_word.join(count, ["book_id", "w"]).groupBy("book_id", "words").agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    met = rarest.join(by_word.withColumnRenamed("words", "large"), ["book_id", "w"])
    met = met.where((F.size("words") < F.size("large")) & (F.size(F.array_except("words", "large")) == 0))
    return met.select("book_id", F.array_join("words", " ").alias("small_words"), F.array_join("large", " ").alias("large_words"))


@CORPUS.add(
    "enrichment_fold",
    """WITH m AS (SELECT *, row_number() OVER (PARTITION BY book_id, char_id ORDER BY rec_id) AS k FROM manifest_characters),
    t AS (SELECT book_id, char_id, trait, min((k, i)) AS o FROM (SELECT book_id, char_id, k, unnest(generate_series(1, len(traits))) AS i, traits FROM m), LATERAL (SELECT traits[i] AS trait) GROUP BY ALL),
    tr AS (SELECT book_id, char_id, list(trait ORDER BY o)[1:3] AS traits FROM t GROUP BY ALL)
    SELECT m.book_id, m.char_id, count(*) AS mentions, coalesce(arg_min(upper(gender), k) FILTER (upper(gender) IN ('MALE', 'FEMALE', 'NEUTRAL')), 'UNKNOWN') AS gender,
      coalesce(arg_min(upper(age_band), k) FILTER (upper(age_band) IN ('CHILD', 'TEEN', 'ADULT', 'ELDER')), 'UNKNOWN') AS age_band, coalesce(any_value(tr.traits), []) AS traits
    FROM m LEFT JOIN tr ON m.book_id = tr.book_id AND m.char_id = tr.char_id GROUP BY ALL""",
)
def enrichment_fold(spark: SparkSession, folder: str) -> DataFrame:
    """What the records of a character add up to, in order: mentions, the first known gender and age, the first three traits."""
    rows = table(spark, folder, "manifest_characters")
    known = lambda c, values: F.min_by(F.upper(c), F.when(F.upper(c).isin(values), F.col("rec_id")))
    first = lambda c, values: F.coalesce(F.when(known(c, values).isin(values), known(c, values)), F.lit("UNKNOWN"))
    # The first place of each trait is enough, so no list of all records is built.
    traits = rows.select("book_id", "char_id", "rec_id", F.posexplode("traits").alias("i", "trait")).groupBy("book_id", "char_id", "trait").agg(F.min(F.struct("rec_id", "i")).alias("o"))
    rank = F.row_number().over(Window.partitionBy("book_id", "char_id").orderBy("o"))
    three = traits.withColumn("k", rank).where("k <= 3").groupBy("book_id", "char_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "trait"))), lambda x: x["trait"]).alias("traits"))
    folded = rows.groupBy("book_id", "char_id").agg(
        F.count("*").alias("mentions"), first("gender", ["MALE", "FEMALE", "NEUTRAL"]).alias("gender"), first("age_band", ["CHILD", "TEEN", "ADULT", "ELDER"]).alias("age_band")
    )
    return folded.join(three, ["book_id", "char_id"], "left").select("book_id", "char_id", "mentions", "gender", "age_band", F.coalesce("traits", F.array().cast("array<string>")).alias("traits"))


@CORPUS.add(
    "canonical_id_join",
    f"""WITH {_ALIASES}, e AS (SELECT book_id, lower(name) AS known, min(char_id) AS id FROM al WHERE name <> '' GROUP BY ALL),
    s AS (SELECT DISTINCT book_id, lower(speaker) AS said FROM (SELECT book_id, unnest(cast_names) AS speaker FROM documents WHERE book_id IS NOT NULL) WHERE speaker IS NOT NULL AND speaker <> ''),
    one AS (SELECT s.book_id, said, arg_max(id, (length(known), known)) AS id FROM s JOIN e ON s.book_id = e.book_id AND suffix(said, known) GROUP BY ALL)
    SELECT * FROM one UNION ALL SELECT s.book_id, said, arg_max(id, (length(known), known)) AS id FROM s ANTI JOIN one USING (book_id, said) JOIN e ON s.book_id = e.book_id AND suffix(known, said) GROUP BY ALL""",
)
def canonical_id_join(spark: SparkSession, folder: str) -> DataFrame:
    """Names of documents with their character: the one of that name, else of the longest name they end with, else of the longest name that ends with them."""
    known = _aliases(spark, folder).where("name <> ''").groupBy("book_id", F.lower("name").alias("known")).agg(F.min("char_id").alias("id"))
    said = table(spark, folder, "documents").where("book_id IS NOT NULL").select("book_id", F.explode("cast_names").alias("n")).where("n IS NOT NULL AND n <> ''")
    said = said.select("book_id", F.lower("n").alias("said")).distinct()
    longest = F.max_by("id", F.struct(F.length("known"), "known")).alias("id")
    # A name equal to the one said is longer than any that it only ends with.
    first = _ending_with(said, "said", known, "known").groupBy("book_id", "said").agg(longest)
    rest = said.join(first, ["book_id", "said"], "left_anti")
    return first.unionByName(_ending_with(known, "known", rest, "said").groupBy("book_id", "said").agg(longest))


def _ending_with(whole: DataFrame, text: str, ends: DataFrame, ending: str) -> DataFrame:
    """Rows of ``whole`` and ``ends`` of one book whose ``text`` ends with ``ending``: texts are cut at the lengths that endings of their book have, and joined by equality.

    The planner sizes the cut texts as if each had one ending, so that they would pass for small enough to be broadcast; the hint keeps both sides in the shuffle.
    """
    lengths = ends.groupBy("book_id").agg(F.collect_set(F.length(ending)).alias("_lengths"))
    fitting = F.filter("_lengths", lambda n: n <= F.length(text))
    cut = whole.join(lengths.hint("merge"), "book_id").withColumn("_n", F.explode(fitting)).withColumn(ending, F.substr(text, F.length(text) - F.col("_n") + 1, F.col("_n"))).drop("_n", "_lengths")
    return cut.join(ends.hint("merge"), ["book_id", ending])


@CORPUS.add(
    "manifest_merge",
    f"""WITH f AS (SELECT book_id, char_id, count(*) AS mentions FROM manifest_characters GROUP BY ALL), {_RULES}, sp AS (SELECT book_id, speaker_id AS char_id, count(*) AS lines FROM lines WHERE speaker_id IS NOT NULL GROUP BY ALL)
    SELECT coalesce(f.book_id, sp.book_id) AS book_id, coalesce(f.char_id, sp.char_id) AS char_id, coalesce(lines, 0)::BIGINT AS lines, coalesce(mentions, 0)::BIGINT AS mentions, (CASE WHEN lines IS NOT NULL THEN 1.0 ELSE 0.4 END)::DOUBLE AS confidence
    FROM f FULL JOIN sp ON f.book_id = sp.book_id AND f.char_id = sp.char_id WHERE lines IS NOT NULL OR mentions >= 1""",
)
def manifest_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Characters from records and from attributed lines in one cast."""
    noted = table(spark, folder, "manifest_characters").groupBy("book_id", "char_id").agg(F.count("*").alias("mentions"))
    spoken = _lines(spark, folder).where("speaker_id IS NOT NULL").groupBy("book_id", F.col("speaker_id").alias("char_id")).agg(F.count("*").alias("lines"))
    both = noted.join(spoken, ["book_id", "char_id"], "full")
    return both.select("book_id", "char_id", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("mentions", F.lit(0)).alias("mentions"), F.when(F.col("lines").isNotNull(), 1.0).otherwise(0.4).alias("confidence"))


_TURNS = f"""{_RULES}, t AS (SELECT book_id, chapter, seq, arg_max(speaker_id, n) AS who, count(*) AS quotes, count(DISTINCT speaker_id) AS speakers FROM lines WHERE kind = 'DIALOGUE' AND speaker_id IS NOT NULL GROUP BY ALL),
o AS (SELECT *, lag(who) OVER w AS a, lag(who, 2) OVER w AS b, lag(seq) OVER w AS last FROM t WINDOW w AS (PARTITION BY book_id, chapter ORDER BY seq))"""


@CORPUS.add(
    "conformance",
    f"""WITH {_TURNS} SELECT count(*) FILTER (WHERE quotes > 1) AS several_quotes, count(*) FILTER (WHERE quotes > 1 AND speakers = 1) AS one_speaker, count(*) FILTER (WHERE a IS NOT NULL AND seq - last = 1) AS adjacent,
    count(*) FILTER (WHERE a IS NOT NULL AND seq - last = 1 AND a <> who) AS changed, count(*) FILTER (WHERE b IS NOT NULL AND a <> b) AS pairs, count(*) FILTER (WHERE b IS NOT NULL AND a <> b AND who = b) AS returned FROM o""",
)
def conformance(spark: SparkSession, folder: str) -> DataFrame:
    """How often the conventions of dialogue hold: one speaker in a paragraph, a change between paragraphs, a return after another."""
    told = _lines(spark, folder).where("kind = 'DIALOGUE' AND speaker_id IS NOT NULL")
    turns = told.groupBy("book_id", "chapter", "seq").agg(F.max_by("speaker_id", "n").alias("who"), F.count("*").alias("quotes"), F.count_distinct("speaker_id").alias("speakers"))
    keys = ["book_id", "chapter"]
    before = neighbour(turns, keys, "seq", F.struct(F.col("who").alias("who"), F.col("seq").alias("seq")), "p", step=-1).withColumns({"a": F.col("p.who"), "last": F.col("p.seq")})
    two = neighbour(before, keys, "seq", F.col("a"), "b", step=-1)
    several, close = F.col("quotes") > 1, F.col("a").isNotNull() & (F.col("seq") - F.col("last") == 1)
    pair = F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    return two.agg(
        F.count_if(several).alias("several_quotes"),
        F.count_if(several & (F.col("speakers") == 1)).alias("one_speaker"),
        F.count_if(close).alias("adjacent"),
        F.count_if(close & (F.col("a") != F.col("who"))).alias("changed"),
        F.count_if(pair).alias("pairs"),
        F.count_if(pair & (F.col("who") == F.col("b"))).alias("returned"),
    )


@CORPUS.add(
    "continued_quotations",
    f"""WITH {S.PARAGRAPHS}, o AS (SELECT *, lag(text) OVER (PARTITION BY book_id, chapter ORDER BY seq) AS p FROM para)
    SELECT book_id, seq FROM o WHERE p IS NOT NULL AND ((length(p) - length(replace(p, '"', ''))) % 2 = 1 OR length(replace(p, '”', '')) > length(replace(p, '“', ''))) AND text[1] IN ('"', '“', '«')""",
)
def continued_quotations(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that open a quotation behind one that left its own open."""
    paras = paragraphs(table(spark, folder, "entries"))
    before = neighbour(paras, ["book_id", "chapter"], "seq", leaves_quotation_open(F.col("text")), "left_open", step=-1)
    return before.where(F.col("left_open") & opens_quotation(F.col("text"))).select("book_id", "seq")


@CORPUS.add(
    "cast_score",
    f"""WITH {_RULES}, found AS (SELECT DISTINCT book_id, lower(tag) AS name FROM rd WHERE tag IS NOT NULL),
    g AS (SELECT f.book_id, f.name, c.char_id FROM found f LEFT JOIN castn c ON f.book_id = c.book_id AND f.name = c.name), e AS (SELECT book_id, count(DISTINCT char_id) AS expected FROM manifest_characters GROUP BY 1)
    SELECT g.book_id, count(*) AS found, count(char_id) AS real_names, count(*) - count(char_id) AS junk, any_value(expected) AS expected, count(DISTINCT char_id) AS recalled,
    round(count(char_id) / count(*), 6) AS precision, round(count(DISTINCT char_id) / any_value(expected), 6) AS recall FROM g JOIN e ON g.book_id = e.book_id GROUP BY 1""",
)
def cast_score(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged names of each book against its cast: found, real, junk, and how many characters they recall."""
    from loomtext.operators.attribution import cast_names
    from loomtext.operators.roster import quotations

    characters = table(spark, folder, "manifest_characters")
    found = quotations(segments(paragraphs(table(spark, folder, "entries")))).where("tagged IS NOT NULL").select("book_id", F.lower("tagged").alias("name")).distinct()
    held = found.join(cast_names(characters), ["book_id", "name"], "left")
    expected = characters.groupBy("book_id").agg(F.count_distinct("char_id").alias("expected"))
    n, real, recalled = F.count("*"), F.count("char_id"), F.count_distinct("char_id")
    counts = held.groupBy("book_id").agg(n.alias("found"), real.alias("real_names"), (n - real).alias("junk"), recalled.alias("recalled")).join(expected, "book_id")
    return counts.select("book_id", "found", "real_names", "junk", "expected", "recalled", ratio(F.col("real_names"), F.col("found")).alias("precision"), ratio(F.col("recalled"), F.col("expected")).alias("recall"))


_LANGS = "SELECT book_id, lang, (lang IS DISTINCT FROM 'en' OR author IS NULL) AS held_out FROM books"


@CORPUS.add(
    "headline_gap",
    f"""WITH {_RULES}, h AS ({_LANGS}), r AS (SELECT held_out, count(*) AS quotes, count(speaker_id) AS answered FROM lines l JOIN h USING (book_id) WHERE kind = 'DIALOGUE' GROUP BY 1)
    SELECT round(max(answered / quotes) FILTER (NOT held_out), 6) AS headline, round(max(answered / quotes) FILTER (held_out), 6) AS held_out, round(max(answered / quotes) FILTER (NOT held_out) - max(answered / quotes) FILTER (held_out), 6) AS gap FROM r""",
)
def headline_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of the rules on the books that count and on those held out, and the gap."""
    books = table(spark, folder, "books").select("book_id", (~F.col("lang").eqNullSafe("en") | F.col("author").isNull()).alias("out"))
    told = _lines(spark, folder).where("kind = 'DIALOGUE'").join(books, "book_id")
    rate = lambda c: F.count(F.when(c, F.col("speaker_id"))) / F.count(F.when(c, F.lit(1)))
    both = told.agg(rate(~F.col("out")).alias("a"), rate(F.col("out")).alias("b"))
    return both.select(F.round("a", 6).alias("headline"), F.round("b", 6).alias("held_out"), F.round(F.col("a") - F.col("b"), 6).alias("gap"))


@CORPUS.add(
    "mistake_sample",
    f"""WITH {_RULES} SELECT book_id, seq, n, evidence FROM lines WHERE kind = 'DIALOGUE' AND tier = 'NONE' QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY seq, n) <= 12""",
)
def mistake_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The first twelve unresolved quotations of every book: a report."""
    missed = _lines(spark, folder).where("kind = 'DIALOGUE' AND tier = 'NONE'").select("book_id", "seq", "n", "evidence")
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("seq", "n"))
    return missed.withColumn("k", rank).where("k <= 12").drop("k")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"({WORDLIKE}+)"), F.lit(1))


@CORPUS.add(
    "alias_mentions",
    f"""WITH {_ALIASES}, n AS (SELECT DISTINCT book_id, array_to_string(regexp_extract_all(lower(name), '([\\pL\\p{{Nd}}]+)', 1), ' ') AS name FROM al WHERE name IS NOT NULL),
    ks AS (SELECT DISTINCT book_id, len(string_split(name, ' ')) AS k FROM n WHERE name <> ''), {S.PARAGRAPHS},
    w AS (SELECT book_id, seq, regexp_extract_all(lower(text), '([\\pL\\p{{Nd}}]+)', 1) AS w FROM para),
    g AS (SELECT book_id, seq, k, i, array_to_string(w[i:i + k - 1], ' ') AS name FROM (SELECT w.*, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w JOIN ks USING (book_id) WHERE len(w) >= k)),
    m AS (SELECT book_id, seq, list({{'k': k, 'i': i, 'name': name, 'taken': []::BIGINT[], 'kept': []::VARCHAR[]}} ORDER BY k DESC, i) AS m FROM g JOIN n USING (book_id, name) GROUP BY ALL),
    r AS (SELECT book_id, list_reduce(list_prepend({{'k': 0::BIGINT, 'i': 0::BIGINT, 'name': '', 'taken': []::BIGINT[], 'kept': []::VARCHAR[]}}, m), lambda s, x: CASE WHEN list_has_any(s.taken, range(x.i, x.i + x.k)) THEN s
      ELSE {{'k': x.k, 'i': x.i, 'name': x.name, 'taken': list_concat(s.taken, range(x.i, x.i + x.k)), 'kept': list_append(s.kept, x.name)}} END).kept AS kept FROM m)
    SELECT book_id, name, count(*) AS mentions FROM (SELECT book_id, unnest(kept) AS name FROM r) GROUP BY ALL""",
)
def alias_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """How often each name or alias is mentioned in its book, by its words in lower case; longer mentions come first, and no word counts twice."""
    name = F.array_join(_words(F.lower("name")), " ")
    names = _aliases(spark, folder).select("book_id", name.alias("name")).where("name <> ''").distinct()
    sizes = names.groupBy("book_id").agg(F.collect_set(F.size(F.split("name", " "))).alias("sizes"))
    words = paragraphs(table(spark, folder, "entries")).select("book_id", "seq", _words(F.lower("text")).alias("w"))
    at = words.join(sizes, "book_id").select("book_id", "seq", "w", F.explode("sizes").alias("k")).where(F.size("w") >= F.col("k"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("w", i, F.col("k")), " ").alias("name")))
    met = at.select("book_id", "seq", "k", F.inline(grams)).join(names, ["book_id", "name"])
    found = met.groupBy("book_id", "seq").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("less"), "i", "name"))).alias("m"))
    kept = found.select("book_id", F.explode(_apart("m.less", "m.i", "m.name")).alias("name"))
    return kept.groupBy("book_id", "name").agg(F.count("*").alias("mentions"))


@F.pandas_udf(ArrayType(StringType()))
def _apart(less: pd.Series, at: pd.Series, names: pd.Series) -> pd.Series:
    """The names of a paragraph's mentions, the longest first, without those that share a word with one before."""

    def kept(sizes: Iterable[int], places: Iterable[int], said: Iterable[str]) -> list[str]:
        taken: set[int] = set()
        out = []
        for k, i, name in zip(sizes, places, said):
            own = range(i, i - k)
            if taken.isdisjoint(own):
                taken.update(own)
                out.append(name)
        return out

    return pd.Series([kept(*m) for m in zip(less, at, names)])


@CORPUS.add(
    "names_in_documents",
    """WITH d AS (SELECT doc_id, text, unnest(list_distinct(cast_names)) AS name FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS listed, count(*) FILTER (WHERE contains(lower(text), lower(name))) AS present FROM d WHERE name IS NOT NULL GROUP BY 1""",
)
def names_in_documents(spark: SparkSession, folder: str) -> DataFrame:
    """How many of each document's cast occur in its text."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.lower("text").alias("t"), F.array_compact(F.array_distinct("cast_names")).alias("c")).where(F.size("c") > 0)
    return rows.select("doc_id", F.size("c").cast("bigint").alias("listed"), F.size(F.filter("c", lambda n: F.contains("t", F.lower(n)))).cast("bigint").alias("present"))


@CORPUS.add(
    "reference_chains",
    """WITH RECURSIVE q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey // 2 END AS up FROM orders),
    c AS (SELECT id, up AS pos, 0 AS steps FROM q UNION ALL SELECT c.id, q.up, c.steps + 1 FROM c JOIN q ON c.pos = q.id WHERE q.up IS NOT NULL)
    SELECT id, max(steps)::INT AS steps, arg_max(pos, steps)::BIGINT AS root FROM c GROUP BY 1""",
)
def reference_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Where each row's chain of references ends, and in how many steps."""
    links = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(F.floor(F.col("o_orderkey") / 2)).alias("up"))
    return chain_ends(links)


def chain_ends(links: DataFrame) -> DataFrame:
    """``id``, ``steps``, ``root``: where the chain that begins with each row's link ends, and how many links on that is.

    ``links``: ``id``, once each, and ``up``, null where a chain ends. A chain that runs into a circle ends at the place it
    would come to a second time.
    """
    hop = links.where("up IS NOT NULL").select(F.col("id").alias("at"), F.col("up").alias("far"), F.lit(1).cast("bigint").alias("went"))
    way, moving = _doubled(hop)
    if moving.isEmpty():
        return _ended(links, way)
    # So many steps on, all that still moves is on its circle, and each place of a circle is someone's.
    circle = checkpointed(moving.select(F.col("far").alias("at")).distinct())
    least, _ = _doubled(hop.join(circle, "at", "left_semi"), F.least("at", "far"))
    around = least.join(least.groupBy("least").agg(F.count("*").alias("around")), "least").select(F.col("at").alias("root"), "around")
    # Outside of the circles the links end; where they end at one, it is gone around once, and to one short of that from within.
    way, _ = _doubled(hop.join(circle, "at", "left_anti"))
    inside = links.join(circle, links["id"] == circle["at"], "left_semi").select("id", F.lit(-1).alias("steps"), F.col("id").alias("root"))
    outside = _ended(links.join(circle, links["id"] == circle["at"], "left_anti"), way)
    return inside.unionByName(outside).join(around, "root", "left").select("id", (F.col("steps") + F.coalesce("around", F.lit(0))).cast("int").alias("steps"), "root")


def _ended(links: DataFrame, way: DataFrame) -> DataFrame:
    return links.join(way, links["up"] == way["at"], "left").select("id", F.coalesce("went", F.lit(0)).cast("int").alias("steps"), F.coalesce("far", "up").alias("root"))


def _doubled(hop: DataFrame, mark: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``hop`` (``at``, ``far``, ``went``) followed to where links end, each round twice as far; and those of its rows that never end.

    With ``mark``, ``least`` has the smallest place on the way.
    """
    way = checkpointed(hop.withColumn("least", F.col("at") if mark is None else mark))
    total, reach = way.count(), 1
    while True:
        on = way.select(F.col("at").alias("far"), F.col("far").alias("_far"), F.col("went").alias("_went"), F.col("least").alias("_least"))
        moving = way.join(on.select("far"), "far", "left_semi")
        if reach > total or moving.isEmpty():
            return way, moving
        way = checkpointed(way.join(on, "far", "left").select("at", F.coalesce("_far", "far").alias("far"), (F.col("went") + F.coalesce("_went", F.lit(0))).alias("went"), F.least("least", "_least").alias("least")))
        reach *= 2


@CORPUS.add(
    "marked_quotations",
    f"""WITH {S.SEGMENTS} SELECT book_id, seq, array_to_string(list(CASE WHEN kind = 'DIALOGUE' THEN '[Q' || n || ': ' || run || ']' ELSE run END ORDER BY n), ' ') AS marked FROM seg GROUP BY ALL""",
)
def marked_quotations(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs with their quotations numbered, as a model would be asked."""
    runs = segments(paragraphs(table(spark, folder, "entries")))
    piece = F.when(F.col("kind") == "DIALOGUE", F.concat(F.lit("[Q"), F.col("n").cast("string"), F.lit(": "), F.col("run"), F.lit("]"))).otherwise(F.col("run"))
    rows = F.array_sort(F.collect_list(F.struct("n", piece.alias("p"))))
    return runs.groupBy("book_id", "seq").agg(F.array_join(F.transform(rows, lambda r: r["p"]), " ").alias("marked"))


@CORPUS.add(
    "answer_grammar",
    """SELECT book_id, 'root ::= ' || array_to_string(list_transform(list(DISTINCT char_id ORDER BY char_id), lambda c: '"' || c || '"'), ' | ') AS grammar FROM manifest_characters WHERE char_id IS NOT NULL GROUP BY 1""",
)
def answer_grammar(spark: SparkSession, folder: str) -> DataFrame:
    """The grammar of a book's possible answers."""
    ids = F.array_sort(F.collect_set("char_id"))
    quoted = F.transform(ids, lambda c: F.concat(F.lit('"'), c, F.lit('"')))
    return table(spark, folder, "manifest_characters").where("char_id IS NOT NULL").groupBy("book_id").agg(F.concat(F.lit("root ::= "), F.array_join(quoted, " | ")).alias("grammar"))


@CORPUS.add(
    "recent_speakers",
    f"""WITH {_RULES}, s AS (SELECT book_id, chapter, seq, n, speaker_id FROM lines WHERE speaker_id IS NOT NULL),
    l AS (SELECT book_id, chapter, speaker_id, max((seq, n)) AS last FROM s GROUP BY ALL)
    SELECT book_id, chapter, list(speaker_id ORDER BY last DESC)[1:4] AS recent FROM l GROUP BY ALL""",
)
def recent_speakers(spark: SparkSession, folder: str) -> DataFrame:
    """The last four speakers of each chapter, the latest first."""
    last = _lines(spark, folder).where("speaker_id IS NOT NULL").groupBy("book_id", "chapter", "speaker_id").agg(F.max(F.struct("seq", "n")).alias("last"))
    rank = F.row_number().over(Window.partitionBy("book_id", "chapter").orderBy(F.desc("last")))
    four = last.withColumn("k", rank).where("k <= 4")
    return four.groupBy("book_id", "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "speaker_id"))), lambda x: x["speaker_id"]).alias("recent"))


@CORPUS.add(
    "listen_pieces",
    f"""WITH {S.SEGMENTS} SELECT book_id, seq, n, kind, run_start::INT AS run_start, (run_start + length(run))::INT AS run_end FROM seg WHERE regexp_matches(run, '[\\pL\\p{{Nd}}]')""",
)
def listen_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with a word in them, and their places."""
    runs = segments(paragraphs(table(spark, folder, "entries"))).where(F.col("run").rlike(WORDLIKE))
    return runs.select("book_id", "seq", "n", "kind", "run_start", (F.col("run_start") + F.length("run")).alias("run_end"))


@CORPUS.add(
    "structured_answers",
    """SELECT event_id, TRY_CAST(props->>'k' AS BIGINT) AS k FROM events WHERE props IS NOT NULL""",
)
def structured_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers in JSON held against their shape; what does not fit it is null."""
    return table(spark, folder, "events").where("props IS NOT NULL").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@CORPUS.add(
    "blank_paragraphs",
    f"SELECT chapter, count(*) AS n FROM entries WHERE text IS NULL OR regexp_full_match(text, '{S.WHITE}*') GROUP BY 1",
)
def blank_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Entries without text, by chapter."""
    return table(spark, folder, "entries").where(F.col("text").isNull() | F.col("text").rlike(rf"\A{WHITE}*\z")).groupBy("chapter").agg(F.count("*").alias("n"))
