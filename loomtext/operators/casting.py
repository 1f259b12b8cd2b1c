"""Voices for a cast: pools by pitch, targets, blends of two voices, and an assignment without clashes inside a scene."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pitches in hertz, offsets by age, bounds of the pace.
BOUNDARY_HZ, MARGIN_HZ, UNMEASURED_HZ, GUARD_HZ = 145.0, 10.0, 145.0, 25.0
AGE_HZ = {"CHILD": 40.0, "TEEN": 15.0, "ELDER": -10.0}
WORDS_PER_LINE, SLOWEST, FASTEST = 12.0, 0.85, 1.2
LINES_LEAST, RATE_STEP = 3, 0.05


def pools(voices: DataFrame) -> DataFrame:
    """``gender``, ``speaker``, ``f0_hz``, ``place`` (0-based by pitch), ``size`` of the pool; voices of unclear or unmeasured pitch are in none.

    The table of voices is a fixed inventory of a synthesizer, hundreds of rows.
    """
    kept = voices.where("voice IN ('male', 'female') AND f0_hz IS NOT NULL").select(F.upper("voice").alias("gender"), "speaker", "f0_hz", "quality")
    pool = Window.partitionBy("gender")
    return kept.select("*", (F.row_number().over(pool.orderBy("f0_hz", "speaker")) - 1).alias("place"), F.count("*").over(pool).cast("int").alias("size"))


def without_poor(pool: DataFrame) -> DataFrame:
    """A pool without voices of poor quality, unless none else is left."""
    good = F.count_if(~F.col("quality").eqNullSafe("poor")).over(Window.partitionBy("gender"))
    kept = pool.withColumn("_good", good).where((F.col("_good") == 0) | ~F.col("quality").eqNullSafe("poor")).drop("_good", "place", "size")
    w = Window.partitionBy("gender")
    return kept.select("*", (F.row_number().over(w.orderBy("f0_hz", "speaker")) - 1).alias("place"), F.count("*").over(w).cast("int").alias("size"))


def voice_class(f0: Column) -> Column:
    """The sort of voice that a pitch tells."""
    return (
        F.when(f0.isNull() | (f0 <= 0), "unknown").when(f0 < BOUNDARY_HZ - MARGIN_HZ, "male").when(f0 > BOUNDARY_HZ + MARGIN_HZ, "female").otherwise("unclear")
    )


def target_pitch(people: DataFrame, pool: DataFrame) -> DataFrame:
    """``people`` (``gender``, ``age_band``) with ``target_hz``: the median of the gender's pool, else the mean of both medians, moved by age."""
    # Two numbers, from an inventory of fixed size.
    known = {r["gender"]: r["hz"] for r in pool.groupBy("gender").agg(F.median("f0_hz").alias("hz")).collect()}
    middle = sum(known.values()) / len(known) if known else UNMEASURED_HZ
    pitch, offset = F.lit(middle), F.lit(0.0)
    for gender, hz in known.items():
        pitch = F.when(F.col("gender") == gender, hz).otherwise(pitch)
    for age, hz in AGE_HZ.items():
        offset = F.when(F.col("age_band") == age, hz).otherwise(offset)
    return people.withColumn("target_hz", pitch + offset)


def pace(words_per_line: Column) -> Column:
    """How much longer than usual to speak, from the words of a line."""
    return F.greatest(F.lit(SLOWEST), F.least(F.lit(FASTEST), words_per_line / WORDS_PER_LINE))


def blend_plan(people: DataFrame, pool: DataFrame) -> DataFrame:
    """``people`` (``gender``, ``target_hz``) with ``parent_a``, ``parent_b``, ``fraction``: the two voices of the pool around the target, or the nearest one.

    Only the distinct pairs of gender and target, few for any number of people, meet the pool.
    """
    targets = people.where("target_hz IS NOT NULL").select("gender", "target_hz").distinct()
    met = targets.join(F.broadcast(pool.select("gender", "speaker", "f0_hz", "place")), "gender")
    f0, target = F.col("f0_hz"), F.col("target_hz")
    here = F.struct("f0_hz", "place", "speaker")
    around = met.groupBy("gender", "target_hz").agg(
        F.max(F.when(f0 < target, here)).alias("lo"), F.min(F.when(f0 >= target, here)).alias("hi"), F.min(F.struct(F.abs(f0 - target), "place", "speaker")).alias("near"), F.max("f0_hz").alias("top")
    )
    inside = F.col("lo").isNotNull() & F.col("hi").isNotNull() & (target < F.col("top"))
    plan = around.select(
        "gender",
        "target_hz",
        F.when(inside, F.col("lo.speaker")).otherwise(F.col("near.speaker")).alias("parent_a"),
        F.when(inside, F.col("hi.speaker")).otherwise(F.col("near.speaker")).alias("parent_b"),
        F.when(inside, (target - F.col("lo.f0_hz")) / (F.col("hi.f0_hz") - F.col("lo.f0_hz"))).otherwise(0.0).alias("fraction"),
    )
    return people.join(plan, ["gender", "target_hz"], "left")


def blend(a: Column, b: Column, fraction: Column) -> Column:
    """The mixture of two vectors of one length."""
    return F.zip_with(a, b, lambda x, y: x * (1 - fraction) + y * fraction)


def spread_place(nth: Column, of: Column, size: Column) -> Column:
    """Which of ``size`` places the ``nth`` of ``of`` takes so that all lie apart."""
    spread = F.floor((nth + 1) / (of + 1) * (size - 1)).cast("int")
    return F.when(size <= 1, 0).when(of <= 1, F.floor(size / 2).cast("int")).otherwise(F.greatest(F.lit(0), F.least(spread, size - 1)))


def conflicts(present: DataFrame, scene: Sequence[str]) -> DataFrame:
    """Ordered pairs ``(book_id, a, b)`` of characters that are present in one scene."""
    here = present.select(*scene, "who").distinct()
    pairs = here.withColumnRenamed("who", "a").join(here.withColumnRenamed("who", "b"), list(scene)).where("a <> b")
    return pairs.select("book_id", "a", "b").distinct()


def _free_rate(used: set[float]) -> float:
    step, rate = 0, 1.0
    while round(rate, 9) in used:
        step += 1
        half = (step + 1) // 2
        rate = 1.0 + (half if step % 2 else -half) * RATE_STEP
    return rate


def assign(people: Iterable[tuple[str, tuple[int, ...]]], neighbours: Mapping[str, set[str]], pinned: Mapping[str, tuple[int, float]] = {}) -> dict[str, tuple[int, float]]:
    """A voice and a rate for each of ``people`` (id and candidate voices, the most important first).

    The n-th of those with the same candidates prefers a place apart from the others, moves outward to the nearest voice
    that no one present with it has, and if all are taken speaks the preferred voice at a free rate. ``pinned`` stay.
    """
    people = list(people)
    of: dict[tuple[int, ...], int] = {}
    for _, voices in people:
        of[voices] = of.get(voices, 0) + 1
    nth: dict[tuple[int, ...], int] = {}
    out = dict(pinned)
    for who, voices in people:
        if who in out:
            continue
        k = nth.get(voices, 0)
        nth[voices] = k + 1
        if not voices:
            out[who] = (0, 1.0)
            continue
        n = len(voices)
        first = 0 if n <= 1 else n // 2 if of[voices] <= 1 else max(0, min(n - 1, int((k + 1) / (of[voices] + 1) * (n - 1))))
        near = [out[x] for x in neighbours.get(who, ()) if x in out]
        busy = {v for v, _ in near}
        place = min((i for i in range(n) if voices[i] not in busy), key=lambda i: (abs(i - first), i < first), default=None)
        if place is not None:
            out[who] = (voices[place], 1.0)
        else:
            out[who] = (voices[first], _free_rate({round(r, 9) for v, r in near if v == voices[first]}))
    return out


def cast_voices(people: DataFrame, edges: DataFrame, pool: DataFrame) -> DataFrame:
    """``book_id``, ``char_id``, ``voice``, ``rate`` of every character of every book.

    ``people``: ``book_id``, ``char_id``, ``gender``, ``line_count``; ``edges``: see :func:`conflicts`. The greedy order makes a
    book's cast one task; a cast is people of one book, not rows of text.
    """
    by_gender = {r["gender"]: tuple(r["v"]) for r in pool.groupBy("gender").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "speaker"))), lambda x: x["speaker"]).alias("v")).collect()}
    fallback = tuple(v for g in sorted(by_gender) for v in by_gender[g])

    def run(key: tuple, cast: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        cast = cast.sort_values(["line_count", "char_id"], ascending=[False, True]).drop_duplicates("char_id")
        near: dict[str, set[str]] = {}
        for a, b in zip(met["a"], met["b"]):
            near.setdefault(a, set()).add(b)
        found = assign([(c, by_gender.get(g) or fallback) for c, g in zip(cast["char_id"], cast["gender"])], near)
        return pd.DataFrame([(key[0], c, *found[c]) for c in cast["char_id"]], columns=["book_id", "char_id", "voice", "rate"])

    cast = people.select("book_id", "char_id", "gender", F.coalesce("line_count", F.lit(0)).alias("line_count"))
    met = edges.select(F.col("book_id").alias("k"), "a", "b")
    return cast.groupBy("book_id").cogroup(met.groupBy("k")).applyInPandas(run, "book_id string, char_id string, voice int, rate double")


def candidates_for(people: DataFrame, pool: DataFrame) -> DataFrame:
    """``people`` with ``candidates``: the voices of the pool of the same ``gender`` and ``age``, else of the same gender, else all.

    ``pool``: ``speaker``, ``gender``, ``age``, a small table; its groups meet people by equal keys. A person without a gender gets all.
    """
    voices = F.array_sort(F.collect_set("speaker"))
    exact = pool.where("gender IS NOT NULL AND age IS NOT NULL").groupBy("gender", "age").agg(voices.alias("_exact"))
    same = pool.where("gender IS NOT NULL").groupBy("gender").agg(voices.alias("_same"))
    every = pool.agg(voices).scalar()
    met = people.join(exact, ["gender", "age"], "left").join(same, "gender", "left")
    return met.withColumn("candidates", F.coalesce("_exact", "_same", every)).drop("_exact", "_same")
