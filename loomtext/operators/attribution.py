"""Who speaks: rules on speech tags, pronouns and action beats, gates on a model's answers, composition of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.names import names_in, tag_name, tag_pronoun
from loomtext.functions.text import plain_sentences

DIRECT_TAG, PRONOUN_TAG, ACTION_BEAT = 0.95, 0.85, 0.75
#: A model's answer counts from the first of these on; below the second the narrator speaks.
ANSWER_LEAST, NARRATOR_LEAST = 0.65, 0.40


def cast_names(characters: DataFrame) -> DataFrame:
    """``book_id``, lower-case ``name``, ``char_id`` of display names and aliases; a name of several characters stands for the first record."""
    names = F.filter(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: n.isNotNull() & (n != ""))
    return (
        characters.select("book_id", "char_id", "rec_id", F.posexplode(names).alias("i", "name"))
        .groupBy("book_id", F.lower("name").alias("name"))
        .agg(F.min_by("char_id", F.struct("rec_id", "i")).alias("char_id"))
    )


def only_of_gender(characters: DataFrame) -> DataFrame:
    """``book_id``, ``gender``, ``char_id`` where a book has one character of the gender."""
    told = characters.select("book_id", F.upper("gender").alias("gender"), "char_id").where("gender IN ('FEMALE', 'MALE')")
    return told.groupBy("book_id", "gender").agg(F.count("*").alias("n"), F.min("char_id").alias("char_id")).where("n = 1").drop("n")


def known_names(lookups: DataFrame, cast: DataFrame) -> DataFrame:
    """``book_id``, ``folded``, ``char_id``: for each looked-up name the longest name of the cast that it equals or ends with.

    Every ending that some name of the book is long enough for is joined by equality.
    """
    longest = cast.groupBy("book_id").agg(F.max(F.length("name")).alias("longest"))
    endings = (
        lookups.select("book_id", "folded").distinct().join(longest, "book_id")
        .select("book_id", "folded", F.explode(F.sequence(F.greatest(F.lit(1), F.length("folded") - F.col("longest") + 1), F.length("folded"))).alias("at"))
        .select("book_id", "folded", F.substr("folded", F.col("at"), F.length("folded")).alias("name"))
    )
    return endings.join(cast, ["book_id", "name"]).groupBy("book_id", "folded").agg(F.max_by("char_id", F.length("name")).alias("char_id"))


def by_rules(segs: DataFrame, characters: DataFrame, pronouns: bool = True, beats: bool = True) -> DataFrame:
    """``segs`` with ``speaker_id``, ``confidence``, ``tier`` and ``evidence``.

    The first that applies: narration; a speech tag with a name, known or not; a speech tag with a pronoun, answered if
    the book has one character of its gender; an action beat, the first known name in the sentence before. A row
    without a speaker has confidence 0.
    """
    cast = cast_names(characters)
    beat = F.try_element_at(plain_sentences(F.col("before")), F.lit(-1))
    dialogue = F.col("kind") == "DIALOGUE"
    read = segs.select(
        "*",
        F.when(dialogue, tag_name(F.col("before"), F.col("after"))).alias("_tag"),
        F.when(dialogue, tag_pronoun(F.col("before"), F.col("after"))).alias("_pronoun"),
        F.when(dialogue & F.lit(beats), names_in(beat)).alias("_beat"),
    )
    place = ["book_id", "seq", "n"]
    asked = read.where(dialogue).select(
        *place,
        F.posexplode_outer(F.when(F.col("_tag").isNotNull(), F.array("_tag")).when(F.col("_pronoun").isNull(), F.col("_beat"))).alias("i", "name"),
    ).where("name IS NOT NULL").withColumn("folded", F.lower("name"))
    answered = asked.join(known_names(asked, cast), ["book_id", "folded"]).groupBy(*place).agg(F.min_by("char_id", "i").alias("_known"))
    only = only_of_gender(characters).select("book_id", F.when(F.col("gender") == "FEMALE", "she").otherwise("he").alias("_pronoun"), F.col("char_id").alias("_only"))
    joined = read.join(answered, place, "left").join(only, ["book_id", "_pronoun"], "left")
    tag, pronoun, known = F.col("_tag"), F.col("_pronoun"), F.col("_known")
    only_one = F.col("_only") if pronouns else F.lit(None).cast("string")

    def rule(narration: Column, named: Column, unknown: Column, single: Column, referred: Column, acted: Column, bare: Column) -> Column:
        return (
            F.when(~dialogue, narration)
            .when(tag.isNotNull() & known.isNotNull(), named)
            .when(tag.isNotNull(), unknown)
            .when(pronoun.isNotNull() & only_one.isNotNull(), single)
            .when(pronoun.isNotNull(), referred)
            .when(known.isNotNull(), acted)
            .otherwise(bare)
        )

    nobody = F.lit(None).cast("string")
    none, rules = F.lit("NONE"), F.lit("HEURISTIC")
    zero = F.lit(0.0)
    return joined.select(
        *segs.columns,
        rule(nobody, known, nobody, only_one, nobody, known, nobody).alias("speaker_id"),
        rule(zero, F.lit(DIRECT_TAG), zero, F.lit(PRONOUN_TAG), zero, F.lit(ACTION_BEAT), zero).alias("confidence"),
        rule(F.lit("NARRATOR"), rules, none, rules, none, rules, none).alias("tier"),
        rule(
            F.lit("narration"),
            F.lit("speech tag"),
            F.concat(F.lit("tag names "), tag, F.lit(", not in cast")),
            F.lit("pronoun tag, one candidate"),
            F.lit("pronoun speech tag"),
            F.lit("action beat"),
            F.lit("no tag"),
        ).alias("evidence"),
    )


def demoted(lines: DataFrame) -> DataFrame:
    """Unresolved lines go to the narrator."""
    open_line = F.col("tier") == "NONE"
    return lines.withColumn("tier", F.when(open_line, "NARRATOR").otherwise(F.col("tier")))


def gated(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """Unresolved lines with a model's answers ``(book_id, seq, n, answer, score)``.

    No answer named: the narrator. A sure answer from the cast stands. One that is not sure but not poor either goes to
    ``inferred`` (see :func:`two_party`), else to the narrator. Only lines of tier NONE are asked.
    """
    asked = lines.where("tier = 'NONE'").join(answers, ["book_id", "seq", "n"], "left")
    named = F.col("answer").isNotNull()
    sure = named & (F.col("score") >= ANSWER_LEAST)
    fair = F.coalesce(F.col("score") >= NARRATOR_LEAST, F.lit(True))
    answered = asked.withColumn("speaker_id", F.when(sure, F.col("answer")).otherwise(F.when(fair, F.col("inferred"))))
    answered = answered.withColumn("tier", F.when(sure, "SLM").when(F.col("speaker_id").isNotNull(), "SCENE").otherwise("NARRATOR"))
    answered = answered.withColumn(
        "confidence", F.when(sure, F.col("score")).when(F.col("speaker_id").isNotNull(), F.coalesce("score", F.lit(NARRATOR_LEAST))).otherwise(0.0)
    ).withColumn("evidence", F.when(F.col("tier") == "SLM", "model").when(F.col("tier") == "SCENE", "two speakers").otherwise("nobody"))
    return lines.where("tier <> 'NONE'").unionByName(answered.select(*lines.columns))


def two_party(lines: DataFrame, scene: list[str]) -> DataFrame:
    """``lines`` with ``inferred``: in a scene of exactly two known speakers the one who did not speak last before, else who does not speak first after."""
    order = ["seq", "n"]
    whole = Window.partitionBy(*scene)
    before = Window.partitionBy(*scene).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*scene).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    who = F.array_sort(F.collect_set("speaker_id").over(whole))
    last, first = F.last("speaker_id", ignorenulls=True).over(before), F.first("speaker_id", ignorenulls=True).over(after)
    marked = lines.select("*", who.alias("_who"), F.coalesce(last, first).alias("_near"))
    other = F.when(F.col("_near") == F.col("_who")[0], F.col("_who")[1]).otherwise(F.col("_who")[0])
    open_line = F.col("speaker_id").isNull() & (F.col("kind") == "DIALOGUE") & (F.size("_who") == 2)
    return marked.withColumn("inferred", F.when(open_line, other)).drop("_who", "_near")


def first_answer(*answers: DataFrame) -> DataFrame:
    """Answers ``(book_id, seq, n, speaker_id, evidence)`` of several candidates: the first one's where it has a speaker, else the next one's."""
    place = ["book_id", "seq", "n"]
    out = answers[0].select(*place, "speaker_id", "evidence")
    for more in answers[1:]:
        next_one = more.select(*place, F.col("speaker_id").alias("_s"), F.col("evidence").alias("_e"))
        declined = F.col("speaker_id").isNull() & F.col("_s").isNotNull()
        out = out.join(next_one, place, "full").select(
            *place, F.coalesce("speaker_id", "_s").alias("speaker_id"), F.when(declined | F.col("evidence").isNull(), F.col("_e")).otherwise(F.col("evidence")).alias("evidence")
        )
    return out
