"""Items of varying size in containers of one or several permitted capacities."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import checkpointed

#: Rows of one size that one window partition ranks, and ranks of one size that one join key covers.
RANKED = 100_000


@dataclass
class Run:
    """The items of ``size`` ranked ``rank`` .. ``rank + items - 1`` go, ``each`` to a container, to ``container``, ``container + 1``, ..."""

    size: int
    rank: int
    items: int
    container: int
    each: int


@dataclass
class Bins:
    """``count`` containers from number ``first`` on, all of ``capacity`` with ``room`` left."""

    first: int
    count: int
    capacity: int
    room: int


def _fill(sizes: Sequence[int], counts: Mapping[int, int], top: int, capacity: int) -> tuple[int, int]:
    """How full a container of ``capacity`` gets that takes an item of ``top`` and then always the largest that still fits, and how often that can be done.

    ``sizes`` are those of ``counts`` in rising order.
    """
    room, times = capacity, counts[top]
    i = bisect_right(sizes, top)
    while room and i:
        i = bisect_right(sizes, min(room, sizes[i - 1]), 0, i)
        if not i:
            break
        size = sizes[i - 1]
        n = min(room // size, counts[size])
        if n:
            room -= n * size
            times = min(times, counts[size] // n)
        i -= 1
    return capacity - room, max(1, times)


def total_cost(bins: Sequence[Bins], costs: Mapping[int, float]) -> float:
    return sum(b.count * costs[b.capacity] for b in bins)


def best_fit(counts: Mapping[int, int], costs: Mapping[int, float]) -> tuple[list[Run], list[Bins]]:
    """Variable-capacity best fit, all capacities weighed jointly: the cheapest of the plan over all of them and of the plans with one alone."""
    plans = [_best_fit(counts, costs)]
    if len(costs) > 1:
        most = max(counts, default=0)
        plans += [_best_fit(counts, {c: price}) for c, price in costs.items() if c >= most]
    return min(plans, key=lambda plan: total_cost(plan[1], costs))


def _best_fit(counts: Mapping[int, int], costs: Mapping[int, float]) -> tuple[list[Run], list[Bins]]:
    """Variable-capacity best fit over the number of items of each size, largest size first.

    Each item goes to the open container with the least room that holds it. If none does, a
    capacity is opened: the one with the least cost for each unit of what it would hold, were it filled
    with the items that are left, largest first, and then shrunk (the larger one on a tie); as many of it as can be filled alike. At
    the end every container shrinks to the cheapest capacity that holds its contents. Equal containers are handled together, so
    the work follows the number of distinct sizes, not of items. No size may exceed the largest capacity.
    """
    largest = max(costs)
    if any(s > largest or s < 1 for s in counts):
        raise ValueError("a size must lie between 1 and the largest capacity")
    open_rooms: list[int] = []
    by_room: dict[int, list[Bins]] = {}
    runs: list[Run] = []
    made = 0

    def put(bins: Bins) -> None:
        if bins.room not in by_room:
            by_room[bins.room] = []
            insort(open_rooms, bins.room)
        by_room[bins.room].append(bins)

    rising, ahead = sorted(counts), dict(counts)
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            i = bisect_left(open_rooms, size)
            if i < len(open_rooms):
                room = open_rooms[i]
                group = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    open_rooms.pop(i)
            else:
                if len(costs) == 1:
                    capacity, count = largest, math.ceil(left / (largest // size))
                else:
                    ahead[size] = left
                    tried = []
                    for c in costs:
                        if c >= size:
                            full, times = _fill(rising, ahead, size, c)
                            tried.append((min(costs[d] for d in costs if d >= full) / full, -c, times))
                    _, capacity, count = min(tried)
                    capacity = -capacity
                group = Bins(made, count, capacity, capacity)
                made += group.count
            each = group.room // size
            full = min(group.count, left // each)
            if full:
                runs.append(Run(size, rank, full * each, group.first, each))
                put(Bins(group.first, full, group.capacity, group.room - each * size))
                rank, left = rank + full * each, left - full * each
            rest = group.count - full
            if rest and left:
                # Fewer items are left than one more container takes.
                runs.append(Run(size, rank, left, group.first + full, left))
                put(Bins(group.first + full, 1, group.capacity, group.room - left * size))
                rest, full, left = rest - 1, full + 1, 0
            if rest:
                put(Bins(group.first + full, rest, group.capacity, group.room))
        ahead[size] = 0
    final = []
    for groups in by_room.values():
        for g in groups:
            used = g.capacity - g.room
            capacity = min((c for c in costs if c >= used), key=lambda c: (costs[c], c))
            final.append(Bins(g.first, g.count, capacity, capacity - used))
    return runs, sorted(final, key=lambda g: g.first)


def placements(runs: Sequence[Run], bins: Sequence[Bins]) -> list[tuple[int, int, int, int, int, int, int]]:
    """The runs cut where their containers' final capacity or room changes: size, ranks from and to, first container, items in each, capacity, room."""
    firsts = [b.first for b in bins]
    out = []
    for r in runs:
        at, rank, end = r.container, r.rank, r.rank + r.items
        while rank < end:
            b = bins[bisect_right(firsts, at) - 1]
            stop = min(end, rank + (b.first + b.count - at) * r.each)
            out.append((r.size, rank, stop, at, r.each, b.capacity, b.room))
            at, rank = b.first + b.count, stop
    return out


def pack(items: DataFrame, key: str, size: str, capacities: Sequence[int] = (2048,), costs: Sequence[float] | None = None) -> DataFrame:
    """Containers for all items with a size of at least one.

    An item larger than the largest capacity is split into parts of that capacity and a rest; no
    other item is split. Result, one row for each part: ``key``, ``part``, ``part_start`` and
    ``part_end`` (half-open, in units of size), ``container`` (0-based), ``capacity`` and ``room``
    of that container.

    Only the number of parts of each size, at most as many rows as the largest capacity, reaches the
    driver. The plan made from it comes back as runs of ranks; a size may hold any share of the
    rows, since ranks are taken within hash buckets of it and joined by blocks of ranks. ``costs``
    (default: the capacities) belong to ``capacities``. Null and non-positive sizes get no row,
    repeated rows and keys are items of their own, an empty table gives an empty result, other
    columns are not read.
    """
    spark = items.sparkSession
    price = dict(zip(capacities, costs if costs is not None else capacities))
    top = max(price)
    n = F.col("_n")
    parts = checkpointed(
        items.select(F.col(key).alias("_k"), F.col(size).cast("bigint").alias("_n"))
        .where(n > 0)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {top}"))))
        .withColumn("part_start", F.col("part") * top)
        .withColumn("part_end", F.least(n, F.col("part_start") + top))
        .select("_k", "part", "part_start", "part_end", (F.col("part_end") - F.col("part_start")).cast("int").alias("size"))
    )
    counts = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count("*").alias("n")).collect()}
    runs, bins = best_fit(counts, price)
    buckets = max(16, math.ceil(max(counts.values(), default=0) / RANKED))
    bucketed = parts.withColumn("bucket", F.pmod(F.xxhash64("_k", "part"), F.lit(buckets)).cast("int"))
    offsets = (
        bucketed.groupBy("size", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("offset", F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n"))
        .drop("n")
    )
    ranked = (
        bucketed.withColumn("rank", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("_k", "part")))
        .join(offsets, ["size", "bucket"])
        .withColumn("rank", F.col("offset") + F.col("rank") - 1)
        .withColumn("block", F.expr(f"rank div {RANKED}"))
    )
    plan = (
        spark.createDataFrame(
            placements(runs, bins) or [(0, 0, 1, 0, 1, 0, 0)],
            "size int, low bigint, high bigint, first bigint, each bigint, capacity int, room int",
        )
        .withColumn("block", F.explode(F.sequence(F.expr(f"low div {RANKED}"), F.expr(f"(high - 1) div {RANKED}"))))
    )
    return (
        ranked.join(plan, ["size", "block"])
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("container", F.expr("first + (rank - low) div each"))
        .select(F.col("_k").alias(key), "part", "part_start", "part_end", "container", "capacity", "room")
    )
