"""Scenes of a book, its turn boundaries, and scenes split to a budget."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import is_heading, is_scene_break
from loomtext.operators.ordered import BLOCK, running_sum

#: Paragraphs after which a scene is cut in any case, and paragraphs without dialogue that end an exchange.
MOST_PARAGRAPHS = 400
MOST_GAP = 2


def with_scenes(paras: DataFrame, most: int = MOST_PARAGRAPHS, block: int = BLOCK) -> DataFrame:
    """``paras`` with ``scene_start``, the ``seq`` of the first paragraph of its scene, ``scene_at``, the place of that one among all of the book, and ``next_seq``, that of the next paragraph.

    A scene ends where the chapter changes, behind a break paragraph that no further break follows, and after ``most``
    paragraphs. A scene thus never holds more rows than ``most``; a book may hold any number: the paragraphs are laid out once,
    by blocks of places, and blocks pass on to each other one row each; they are left as they lie by ``book_id`` and ``scene_at``.
    """
    flags = F.struct(F.col("chapter").alias("chapter"), is_scene_break(F.col("text")).alias("broke"))
    rows = paras.withColumn("_block", F.floor(F.col("seq") / block)).withColumn("_f", flags)
    keys = ["book_id", "_block"]
    inside = Window.partitionBy(*keys).orderBy("seq")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_i": F.row_number().over(inside), "_before": F.lag("_f").over(inside), "_after": F.lead("seq").over(inside)})

    def opens(before: Column, here: Column) -> Column:
        return before.isNull() | ~before["chapter"].eqNullSafe(here["chapter"]) | (before["broke"] & ~here["broke"])

    # What a block tells the others: its rows, its ends, and where its last scene opens, the first row set aside.
    rows = rows.withColumn("_opened", F.when((F.col("_i") > 1) & opens(F.col("_before"), F.col("_f")), F.col("_i")))
    told = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by("_f", "seq").alias("first"), F.max_by("_f", "seq").alias("last"), F.min("seq").alias("from_seq"), F.max("_opened").alias("opened")
    )
    across = Window.partitionBy("book_id").orderBy("_block")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumns(
        {"_base": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "_heads": opens(F.lag("last").over(across), F.col("first")), "_follows": F.lead("from_seq").over(across)}
    )
    opened_at = F.col("_base") + F.coalesce("opened", F.when(F.col("_heads"), 1))
    told = told.withColumn("_since", F.last(opened_at, ignorenulls=True).over(earlier)).select(*keys, "_base", "_heads", "_follows", "_since")
    rows = rows.join(told, keys)
    opened = F.coalesce("_opened", F.when((F.col("_i") == 1) & F.col("_heads"), 1))
    since = F.coalesce(F.col("_base") + F.last(opened, ignorenulls=True).over(upto), F.col("_since"))
    at = F.col("_base") + F.col("_i")
    rows = rows.withColumns({"scene_at": at - (at - since) % most, "next_seq": F.coalesce("_after", "_follows")})
    return rows.withColumn("scene_start", F.min("seq").over(Window.partitionBy("book_id", "scene_at"))).select(*paras.columns, "scene_at", "scene_start", "next_seq")


def scenes(paras: DataFrame, most: int = MOST_PARAGRAPHS) -> DataFrame:
    """``book_id``, ``scene_start``, ``scene_end`` (exclusive), ``paragraphs``; the scenes of a book follow each other without a hole."""
    end = F.coalesce(F.max_by("next_seq", "seq"), F.max("seq") + 1)
    grouped = with_scenes(paras, most).groupBy("book_id", "scene_at").agg(F.min("seq").alias("scene_start"), end.alias("scene_end"), F.count("*").alias("paragraphs"))
    return grouped.drop("scene_at")


def chapters_from_headings(paras: DataFrame) -> DataFrame:
    """``paras`` with ``part``: how many headings came before this paragraph's own, never below 0."""
    counted = running_sum(paras, ["book_id"], "seq", is_heading(F.col("text")).cast("int"), "_seen")
    return counted.withColumn("part", F.greatest(F.lit(0).cast("bigint"), F.col("_seen") - 1)).drop("_seen")


def turn_boundaries(in_scenes: DataFrame, has_dialogue: Column, most_gap: int = MOST_GAP) -> DataFrame:
    """``in_scenes`` with ``boundary``: the first paragraph of a scene, and each without dialogue behind more than ``most_gap`` others."""
    scene = Window.partitionBy("book_id", "scene_at").orderBy("seq")
    numbered = in_scenes.withColumn("_talks", has_dialogue).withColumn("_i", F.row_number().over(scene))
    spoke = F.coalesce(F.last(F.when(F.col("_talks"), F.col("_i")), ignorenulls=True).over(scene.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return numbered.withColumn("boundary", (F.col("_i") == 1) | (~F.col("_talks") & (F.col("_i") - spoke > most_gap))).drop("_talks", "_i")


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    carried: str | None
    at_turn: bool


def _latest(holds: Sequence[bool]) -> list[int]:
    """For each place from 0 to the end of the list the last one up to it that holds; -1 without one."""
    return list(accumulate((i if h else -1 for i, h in enumerate(holds)), max))


def split_scene(seqs: Sequence[int], end: int, cost: Sequence[int], boundary: Sequence[bool], talks: Sequence[bool], speaker: Sequence[str | None], budget: int) -> Iterator[Piece]:
    """The pieces of one scene within ``budget``.

    Each takes as many paragraphs as the budget holds, at least one, and then backs up to a turn boundary,
    else to a paragraph without dialogue; with neither it is cut where the budget ends, and the next piece is
    marked as opening in the middle of an exchange. A piece carries the last speaker of the one before. Costs are summed up
    once and searched by halving; the places to back up to are known for all paragraphs beforehand.
    """
    n = len(seqs)
    spent = [0, *accumulate(cost)]
    turn, quiet, told = _latest(boundary), _latest([not t for t in talks]), _latest([s is not None for s in speaker])
    pieces = [(0, True)]
    while (stop := max(pieces[-1][0] + 1, bisect_right(spent, spent[pieces[-1][0]] + budget) - 1)) < n:
        low = pieces[-1][0]
        back = next((places[stop] for places in (turn, quiet) if places[stop] > low), None)
        pieces.append((stop if back is None else back, back is not None))
    for i, (low, clean) in enumerate(pieces if n else []):
        before = told[low - 1] if i else -1
        carried = speaker[before] if i and before >= pieces[i - 1][0] else None
        yield Piece(seqs[low], end if i + 1 == len(pieces) else seqs[pieces[i + 1][0]], carried, clean)


def split_scenes(in_scenes: DataFrame, budget: int) -> DataFrame:
    """The pieces of every scene, from columns ``seq``, ``scene_start``, ``next_seq``, ``cost``, ``boundary``, ``talks``, ``speaker``.

    A scene is bounded by its number of paragraphs, so each fits a task.
    """

    def run(scene: pd.DataFrame) -> pd.DataFrame:
        s = scene.sort_values("seq")
        who = [None if pd.isna(x) else x for x in s["speaker"]]
        last = s.iloc[-1]
        end = int(last["seq"] + 1 if pd.isna(last["next_seq"]) else last["next_seq"])
        found = split_scene(s["seq"].tolist(), end, s["cost"].tolist(), s["boundary"].tolist(), s["talks"].tolist(), who, budget)
        first = s.iloc[0]
        return pd.DataFrame(
            [(first["book_id"], first["scene_start"], p.start, p.end, p.carried, p.at_turn) for p in found],
            columns=["book_id", "scene_start", "piece_start", "piece_end", "carried_speaker", "at_turn_boundary"],
        )

    wanted = in_scenes.select("book_id", "scene_at", "scene_start", "seq", "next_seq", "cost", "boundary", "talks", "speaker")
    return wanted.groupBy("book_id", "scene_at").applyInPandas(
        run, "book_id string, scene_start int, piece_start int, piece_end int, carried_speaker string, at_turn_boundary boolean"
    )
