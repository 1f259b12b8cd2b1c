"""Streams of chunks and events: sessions, windows, late rows, and state that follows a reader."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.operators.matching import FORGET_AFTER, LOCK_AFTER
from loomtext.operators.turns import Talk, step
from loomtext.session import checkpointed


def sessions(rows: DataFrame, time: str, keys: Sequence[str], gap: str) -> DataFrame:
    """``keys``, ``session_start``, ``session_end`` (the gap included), ``n``: runs of rows that follow each other within ``gap``. Works on streams and tables."""
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def windows(rows: DataFrame, time: str, keys: Sequence[str], length: str, step: str | None = None, late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by ``keys`` and time windows of ``length``, sliding if ``step`` is given; rows later than ``late`` behind the newest are left out of a stream."""
    if late:
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = rows.groupBy(F.window(time, length, step).alias("w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *aggregates)


def once(rows: DataFrame, time: str, keys: Sequence[str], late: str) -> DataFrame:
    """A stream without redelivered rows: of equal ``keys`` within ``late`` the first to arrive."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def joined_streams(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Pairs of two streams with equal ``keys`` where the right row comes at most ``within`` after the left one."""
    a = left.withWatermark(left_time, late).alias("a")
    b = right.withWatermark(right_time, late).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    soon = F.expr(f"b.{right_time} >= a.{left_time} AND b.{right_time} <= a.{left_time} + INTERVAL {within}")
    condition = soon
    for s in same:
        condition = condition & s
    return a.join(b, condition).select("a.*", *[F.col(f"b.{c}").alias(f"right_{c}") for c in right.columns if c not in keys])



def _kept(idle: int | None) -> str:
    """A stream with a limit of time never ends by itself, as it waits for the limit; one over the input that is there has none."""
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(batches))
    return rows.sort_values("at", kind="stable")


def turn_stream(lines: DataFrame, key: str = "session_id", idle: int | None = None) -> DataFrame:
    """Turn-taking on a stream of lines ``key``, ``at``, ``paragraph``, ``kind``, ``speaker``: each with the speaker that is known or found.

    The state of a conversation is six names and a few marks, however long it goes on; one that sends nothing for ``idle`` milliseconds
    is forgotten (default: none is). Lines of one batch are taken in order of ``at``.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        talk = Talk()
        if state.exists:
            turns, *rest = json.loads(state.get[0])
            talk = Talk(tuple(turns), *rest)
        rows = _ordered(batches)
        found = []
        for p, kind, s in zip(rows["paragraph"].tolist(), rows["kind"], rows["speaker"]):
            talk, answer = step(talk, (p, kind, None if pd.isna(s) else s))
            found.append(answer)
        state.update((json.dumps(talk),))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(
            {
                key: k[0],
                "at": rows["at"],
                "speaker": [f[0] if f else (None if pd.isna(s) else s) for f, s in zip(found, rows["speaker"])],
                "evidence": [f[2] if f else None for f in found],
            }
        )

    schema = f"{key} string, at bigint, speaker string, evidence string"
    return lines.groupBy(key).applyInPandasWithState(run, schema, "talk string", "append", _kept(idle))


def lock_stream(hits: DataFrame, key: str = "session_id", lock_after: int = LOCK_AFTER, forget_after: int = FORGET_AFTER, idle: int | None = None) -> DataFrame:
    """Lock-on over a stream of hits ``key``, ``at``, ``books`` (array of the books in which the chunk was found, newest first): ``locked`` after each chunk.

    Until locked each book's run of hits counts; several misses in a row of the locked book free it again. A session that sends nothing
    for ``idle`` milliseconds is forgotten (default: none is).
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        locked, misses, streak = json.loads(state.get[0]) if state.exists else (None, 0, {})
        rows = _ordered(batches)
        out = []
        for books in rows["books"]:
            here = [] if books is None else list(books)
            if locked is not None:
                misses = 0 if locked in here else misses + 1
                if misses >= forget_after:
                    locked, misses, streak = None, 0, {}
            else:
                streak = {b: streak.get(b, 0) + 1 for b in here}
                ready = [b for b in here if streak[b] >= lock_after]
                if ready:
                    locked, misses = ready[0], 0
            out.append(locked)
        state.update((json.dumps([locked, misses, streak]),))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({key: k[0], "at": rows["at"], "locked": out})

    return hits.groupBy(key).applyInPandasWithState(run, f"{key} string, at bigint, locked string", "state string", "append", _kept(idle))


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream gives for the input that is there now, as a table in the checkpoint folder."""
    folder = _shared(spark)
    target = f"{folder}/out"
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", target) if mode == "append" else stream.writeStream.outputMode(mode).foreachBatch(_replacing(target))
    query = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def _replacing(target: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return write


def _shared(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        checkpointed(spark.range(1))
    return f"{context.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def resumable(batches: DataFrame, path: str, state: str, apply: Callable[[DataFrame], DataFrame]) -> None:
    """Runs ``apply`` over a stream's new input and appends its rows to ``path``; a later call goes on where the last one ended, and a batch that is retried is written once."""

    def write(batch: DataFrame, number: int) -> None:
        apply(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    batches.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

