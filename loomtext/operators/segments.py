"""Paragraphs of a book and their runs of narration and dialogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import WHITE, is_blank, let, strip

#: Runs of a paragraph: a quotation up to its own closing mark or the end, or what lies between.
#: A straight quote behind a letter or digit opens nothing. The possessive loop keeps long runs off the stack.
RUNS = r'("[^"]*(?:"|\z)|“[^”]*(?:”|\z)|«[^»]*(?:»|\z)|(?:[\p{L}\p{Nd}]"|[^"“«])++)'
OPENERS = ['"', "“", "«"]
DASHES = ["—", "―"]


def paragraphs(entries: DataFrame) -> DataFrame:
    """``book_id``, ``chapter``, ``seq``, stripped ``text`` and ``lead`` (the white space cut off in front) of each entry that is not blank; of reloaded rows the one with the least ``entry_id``.

    Rows with a null book or place belong to no book and are left out.
    """
    return (
        entries.where("book_id IS NOT NULL AND seq IS NOT NULL AND text IS NOT NULL")
        .groupBy("book_id", "seq")
        .agg(F.min(F.struct("entry_id", "chapter", "text")).alias("e"))
        .select("book_id", "e.chapter", "seq", strip(F.col("e.text")).alias("text"), F.length(F.regexp_extract("e.text", f"^{WHITE}*", 0)).alias("lead"))
        .where(F.col("text") != "")
    )


def segments(paras: DataFrame) -> DataFrame:
    """Each paragraph's runs: ``n``, ``kind`` (``NARRATION`` or ``DIALOGUE``), stripped ``run``, the text ``before`` and ``after`` it, and ``run_start``, its place in the stripped text.

    A paragraph that opens with a long dash is dialogue up to the next one, the rest narration. Blank runs are
    dropped but keep their number. All columns of ``paras`` but ``text`` are carried.
    """
    text = F.col("text")
    dashed = F.substring(text, 1, 1).isin(DASHES)
    speech = F.regexp_extract(text, r"^([—―][^—―]*)", 1)
    rest = F.substr(text, F.length(speech) + 1, F.length(text))
    dashed_runs = F.array(
        F.struct(F.lit("DIALOGUE").alias("kind"), speech.alias("run"), F.lit("").alias("before"), rest.alias("after")),
        F.struct(F.lit("NARRATION").alias("kind"), rest.alias("run"), speech.alias("before"), F.lit("").alias("after")),
    )
    quoted_runs = let(
        F.regexp_extract_all(text, F.lit(RUNS), F.lit(1)),
        lambda runs: F.transform(
            runs,
            lambda r, i: F.struct(
                F.when(F.substring(r, 1, 1).isin(OPENERS), "DIALOGUE").otherwise("NARRATION").alias("kind"),
                r.alias("run"),
                F.array_join(F.slice(runs, 1, i), "").alias("before"),
                F.array_join(F.slice(runs, i + 2, F.size(runs)), "").alias("after"),
            ),
        ),
    )
    kept = [c for c in paras.columns if c != "text"]
    return (
        paras.select(*kept, F.posexplode(F.when(dashed, dashed_runs).otherwise(quoted_runs)).alias("n", "r"))
        .select(
            *kept,
            "n",
            "r.kind",
            strip(F.col("r.run")).alias("run"),
            "r.before",
            "r.after",
            (F.length("r.before") + F.length(F.regexp_extract("r.run", f"^{WHITE}*", 0))).alias("run_start"),
        )
        .where(~is_blank(F.col("run")))
    )
