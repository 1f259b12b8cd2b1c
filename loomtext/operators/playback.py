"""What a player does with a text that is read aloud: events, prefetching, fallback, answers of a model in a strict shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import WHITE
from loomtext.operators.ordered import last_known, neighbour

#: Sentences that are synthesized ahead of the one that is heard.
AHEAD = 2


def utterance_events(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``i``, ``event``, ``from_char``, ``to_char``: ``started``, a ``range`` for each word, ``audio``, ``done`` of every text, in order.

    A text without words has no audio; a null text has no events.
    """
    words = F.filter(F.split(F.col(text), f"{WHITE}"), lambda w: w != "")
    event = lambda name, a, b: F.struct(F.lit(name).alias("event"), a.cast("int").alias("from_char"), b.cast("int").alias("to_char"))
    none = F.lit(None)

    def place(found: Column, word: Column) -> Column:
        since = F.coalesce(F.try_element_at(found, F.lit(-1))["to_char"], F.lit(0))
        at = F.call_function("locate", word, F.col(text), since + 1) - 1
        return F.concat(found, F.array(event("range", at, at + F.length(word))))

    empty = F.array().cast("array<struct<event:string,from_char:int,to_char:int>>")
    ranges = F.aggregate(words, empty, place)
    sound = F.when(F.size(words) > 0, F.array(event("audio", none, none))).otherwise(empty)
    steps = F.concat(F.array(event("started", none, none)), ranges, sound, F.array(event("done", none, none)))
    rows = chunks.where(F.col(text).isNotNull()).select(key, F.posexplode(steps).alias("i", "e"))
    return rows.select(key, "i", "e.event", "e.from_char", "e.to_char")


def prefetched(steps: DataFrame, keys: Sequence[str], order: str, place: str, ahead: int = AHEAD) -> DataFrame:
    """``steps`` with ``loads`` and ``drops``: how many sentences of the window from the current one to ``ahead`` behind it are new, and how many fell out.

    A step forward of up to ``ahead`` keeps what the windows share; any other step is a seek that starts a new ``epoch``: all of the
    old window is dropped. Each sentence is made once while it stays in the window.
    """
    before = neighbour(steps, keys, order, F.col(place), "_last", step=-1)
    went = F.col(place) - F.col("_last")
    kept = F.when(went.between(0, ahead), ahead + 1 - went).otherwise(0)
    return before.withColumns(
        {
            "loads": (ahead + 1 - F.coalesce(kept, F.lit(0))).cast("int"),
            "drops": F.when(F.col("_last").isNull(), 0).otherwise(ahead + 1 - kept).cast("int"),
            "seek": F.coalesce(~went.between(0, ahead), F.lit(True)),
        }
    ).drop("_last")


def with_fallback(steps: DataFrame, keys: Sequence[str], order: str, primary: Column, local: Column) -> DataFrame:
    """``steps`` with ``value`` (the primary one, else the local one), ``source``, and ``announced``: true for the first of ``keys`` that falls back after one that did not, or at the start."""
    rows = steps.withColumns({"value": F.coalesce(primary, local), "source": F.when(primary.isNotNull(), "primary").otherwise("local")})
    marked = last_known(rows, keys, order, F.col("source"), "_was")
    return marked.withColumn("announced", (F.col("source") == "local") & ~F.col("_was").eqNullSafe("local")).drop("_was")


ANSWERS = "answers array<struct<index int, speaker string, confidence double>>"


def strict_answers(reply: Column, asked: Column) -> Column:
    """The answers of a reply in JSON if it has the shape exactly: as many as were asked, each with an index and a speaker; else null."""
    listed = F.from_json(reply, ANSWERS)["answers"]
    whole = (F.size(listed) == asked) & F.forall(listed, lambda a: a["index"].isNotNull() & a["speaker"].isNotNull() & F.coalesce(a["confidence"].between(0, 1), F.lit(False)))
    return F.when(whole, listed)


def completed(reply: Column, again: Column, asked: Column) -> Column:
    """``answers`` and ``attempt`` (1 or 2) of the first of two replies that has the shape; null if neither has: a raw reply never passes."""
    first, second = strict_answers(reply, asked), strict_answers(again, asked)
    return F.when(first.isNotNull(), F.struct(first.alias("answers"), F.lit(1).alias("attempt"))).when(second.isNotNull(), F.struct(second.alias("answers"), F.lit(2).alias("attempt")))


def mean_opinion(score: Column, bar: float = 3.5) -> Column:
    """The mean opinion score of a group, and whether it reaches the bar."""
    mean = F.round(F.avg(score), 4)
    return F.struct(mean.alias("mean"), (mean >= bar).alias("passes"))


def drain_per_hour(first: Column, last: Column, minutes: Column) -> Column:
    """The loss of charge in percent an hour between two readings; null without time between them."""
    return F.when(minutes > 0, F.round((first - last) * 60 / minutes, 4))


def spread_ids(place: Column, count: Column, low: int = 100, high: int = 880) -> Column:
    """The id of the member at ``place`` (0-based) of a cast of ``count``, evenly spaced from ``low`` on."""
    step = F.floor(F.lit(high - low) / F.greatest(count, F.lit(1)))
    return (F.lit(low) + place * step).cast("int")
