"""The cast of a book from its text: who is tagged, who stands near quotations, and of which gender."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.names import names_in, nearest_name, pronoun_gender, tag_name, title_gender, without_quoted
from loomtext.functions.text import plain_sentences
from loomtext.operators.ordered import last_known
from loomtext.session import checkpointed

#: How often a name must stand near quotations, and what a gender needs: votes and share, of its own and of shared sentences.
NEAR_LEAST = 8
VOTES_LEAST, VOTES_SHARE = 1, 0.6
SHARED_LEAST, SHARED_SHARE = 3, 0.75


def tagged(segs: DataFrame) -> DataFrame:
    """Dialogue runs with ``tagged``, the name of their speech tag."""
    return segs.where("kind = 'DIALOGUE'").withColumn("tagged", tag_name(F.col("before"), F.col("after")))


def read_once(segs: DataFrame) -> DataFrame:
    """All that the cast is told by: of each quotation its ``tagged`` name and, if it has none, the names ``near`` it, in the sentence before and after; of narration the ``run``."""
    said = F.col("kind") == "DIALOGUE"
    before = F.try_element_at(plain_sentences(without_quoted(F.col("before"))), F.lit(-1))
    after = F.try_element_at(plain_sentences(without_quoted(F.col("after"))), F.lit(1))
    none = F.array().cast("array<string>")
    near = F.concat(F.coalesce(names_in(before), none), F.coalesce(names_in(after), none))
    rows = segs.withColumn("tagged", F.when(said, tag_name(F.col("before"), F.col("after"))))
    return rows.select("book_id", "seq", "n", "kind", F.when(~said, F.col("run")).alias("run"), "tagged", F.when(said & F.col("tagged").isNull(), near).otherwise(none).alias("near"))


def quotations(segs: DataFrame) -> DataFrame:
    """Each quotation's ``tagged`` name and, if it has none, the names ``near`` it."""
    return _said(read_once(segs))


def _said(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'DIALOGUE'").select("book_id", "seq", "n", "tagged", "near")


def tag_counts(quotes: DataFrame) -> DataFrame:
    return quotes.where("tagged IS NOT NULL").groupBy("book_id", F.col("tagged").alias("name")).agg(F.count("*").alias("n_tags"))


def near_counts(quotes: DataFrame) -> DataFrame:
    """Names near untagged quotations, without those that are ever tagged."""
    counts = quotes.select("book_id", F.explode("near").alias("name")).groupBy("book_id", "name").agg(F.count("*").alias("n_near"))
    return counts.join(tag_counts(quotes), ["book_id", "name"], "left_anti")


def narration_sentences(segs: DataFrame) -> DataFrame:
    """Sentences of each paragraph's narration, its runs joined by a space: ``seq``, ``i``, ``sentence``, ``names``, ``gender``."""
    runs = segs.where("kind = 'NARRATION'").groupBy("book_id", "seq").agg(F.sort_array(F.collect_list(F.struct("n", "run"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["run"]), " ")
    return runs.select("book_id", "seq", F.posexplode(plain_sentences(text)).alias("i", "sentence")).select(
        "book_id", "seq", "i", "sentence", names_in(F.col("sentence")).alias("names"), pronoun_gender(F.col("sentence")).alias("gender")
    )


def gender_votes(segs: DataFrame) -> DataFrame:
    """Votes ``(book_id, name, gender, strong)`` of pronouns.

    A sentence with one name and pronouns of one gender votes for it. A sentence without a name votes for the
    name pending from before: the last one that stood alone in a sentence, unless a sentence with several came since.
    Several names with a pronoun give a weak vote to the one nearest before it.
    """
    said = narration_sentences(segs)
    several = F.size("names") > 1
    event = F.when(F.size("names") == 1, F.col("names")[0]).when(several, F.lit(""))
    said = last_known(said, ["book_id"], "seq", event, "pending", then=["i"])
    told = said.where("gender IS NOT NULL")
    own = F.when(F.size("names") == 1, F.col("names")[0]).when((F.size("names") == 0) & (F.col("pending") != ""), F.col("pending"))
    weak = F.when(several, nearest_name(F.col("sentence"), F.col("names"), F.col("gender")))
    return told.select("book_id", F.coalesce(own, weak).alias("name"), "gender", own.isNotNull().alias("strong")).where("name IS NOT NULL")


def genders(segs: DataFrame, quotes: DataFrame) -> DataFrame:
    """``book_id``, ``name``, ``gender``, ``rule``: by title, else by votes, else by shared sentences."""
    counted = (
        gender_votes(segs)
        .groupBy("book_id", "name", "strong")
        .agg(F.count_if(F.col("gender") == "FEMALE").alias("f"), F.count_if(F.col("gender") == "MALE").alias("m"))
        .withColumn("best", F.greatest("f", "m"))
        .withColumn("share", F.col("best") / (F.col("f") + F.col("m")))
        .withColumn("gender", F.when(F.col("f") > F.col("m"), "FEMALE").when(F.col("m") > F.col("f"), "MALE"))
    )
    voted = counted.where(F.col("strong") & (F.col("best") >= VOTES_LEAST) & (F.col("share") >= VOTES_SHARE)).select("book_id", "name", F.col("gender").alias("voted"))
    guessed = counted.where(~F.col("strong") & (F.col("best") >= SHARED_LEAST) & (F.col("share") >= SHARED_SHARE)).select("book_id", "name", F.col("gender").alias("guessed"))
    named = tag_counts(quotes).select("book_id", "name").unionByName(near_counts(quotes).select("book_id", "name"))
    titled = named.withColumn("titled", title_gender(F.col("name"))).where("titled IS NOT NULL")
    return (
        titled.join(voted, ["book_id", "name"], "full")
        .join(guessed, ["book_id", "name"], "full")
        .select(
            "book_id",
            "name",
            F.coalesce("titled", "voted", "guessed").alias("gender"),
            F.when(F.col("titled").isNotNull(), "title").when(F.col("voted").isNotNull(), "voted").otherwise("guessed").alias("rule"),
        )
        .where("gender IS NOT NULL")
    )


def roster(segs: DataFrame) -> DataFrame:
    """The cast: tagged names, and names near quotations often enough, with gender, confidence and number of lines."""
    # Its text is read once: what is kept of it tells tags, names near by and genders.
    rows = checkpointed(read_once(segs))
    quotes = _said(rows)
    tags = tag_counts(quotes).withColumnRenamed("n_tags", "lines").withColumn("confidence", F.lit(1.0))
    near = near_counts(quotes).where(F.col("n_near") >= NEAR_LEAST).withColumnRenamed("n_near", "lines").withColumn("confidence", F.lit(0.6))
    cast = tags.unionByName(near)
    return cast.join(genders(rows, quotes).drop("rule"), ["book_id", "name"], "left").select(
        "book_id", "name", F.coalesce("gender", F.lit("UNKNOWN")).alias("gender"), "confidence", "lines"
    )
