"""Kernels on samples and timings, as array expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomtext.functions.text import WHITE, let

TARGET_DBFS, SILENT_RMS, OVERLAP_MS = -17.0, 1e-9, 40


def rms(pcm: Column) -> Column:
    total = F.aggregate(pcm, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    return F.when(F.size(pcm) > 0, F.sqrt(total / F.size(pcm))).otherwise(0.0)


def dbfs(pcm: Column) -> Column:
    """The level against full scale; null for silence."""
    return let(rms(pcm), lambda r: F.when(r >= SILENT_RMS, 20 * F.log10(r)))


def loudness(pcm: Column, target: float = TARGET_DBFS) -> Column:
    """Samples brought to the target level and clipped; silence stays."""
    gain = F.when(rms(pcm) >= SILENT_RMS, 10 ** (target / 20) / rms(pcm)).otherwise(1.0)
    return let(gain, lambda g: F.transform(pcm, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * g))))


def crossfade(a: Column, b: Column, overlap: Column) -> Column:
    """Two buffers joined with a linear overlap."""
    n = F.least(overlap, F.size(a), F.size(b))

    def mix(k: Column) -> Column:
        tail, head = F.slice(a, F.size(a) - k + 1, k), F.slice(b, 1, k)
        fade = F.transform(
            F.arrays_zip(tail.alias("x"), head.alias("y")), lambda s, i: s["x"] * (1 - (i + 1) / (k + 1)) + s["y"] * ((i + 1) / (k + 1))
        )
        return F.when(k > 0, F.concat(F.slice(a, 1, F.size(a) - k), fade, F.slice(b, k + 1, F.size(b)))).otherwise(F.concat(a, b))

    return let(n, mix)


def stretch(pcm: Column, factor: Column) -> Column:
    """Samples at another rate, by linear interpolation."""
    n = F.greatest(F.lit(1), F.floor(F.size(pcm) / factor).cast("int"))

    def at(i: Column) -> Column:
        return let(
            F.greatest(F.lit(0), F.least((i * factor).cast("int"), F.size(pcm) - 1)),
            lambda k: F.element_at(pcm, k + 1) + (F.element_at(pcm, F.least(k + 2, F.size(pcm))) - F.element_at(pcm, k + 1)) * (i * factor - k),
        )

    return F.when((factor == 1) | (F.size(pcm) == 0), pcm).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))


def pcm16(pcm: Column) -> Column:
    """Samples as 16-bit integers, truncated."""
    return F.transform(pcm, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("int"))


def with_silence(parts: Column, samples: int) -> Column:
    """Buffers one behind the other with a pause of so many samples between."""
    pause = F.array_repeat(F.lit(0.0), samples)
    return F.aggregate(parts, F.array().cast("array<double>"), lambda t, p: F.when(F.size(t) > 0, F.concat(t, pause, p)).otherwise(p))


def waveform_difference(a: Column, b: Column) -> Column:
    """Whether two buffers have the same samples, and the RMS of their difference over the shorter."""
    n = F.least(F.size(a), F.size(b))
    gaps = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x - y)
    return F.struct((F.size(a) == F.size(b)).alias("same_length"), (a == b).alias("identical"), rms(gaps).alias("rms_difference"))


def softmax_best(scores: Column) -> Column:
    """The place of the best score (0-based) and its share under softmax."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("best"), (1 / F.aggregate(weights, F.lit(0.0), lambda t, w: t + w)).alias("share"))


@F.pandas_udf(DoubleType())
def median_pitch(pcm: pd.Series, rate: pd.Series) -> pd.Series:
    """The median pitch in hertz of frames of 40 ms every 20 ms whose autocorrelation peaks between 60 and 400 Hz; null if none does."""

    def one(x: np.ndarray, sr: int) -> float | None:
        x = np.asarray(x, float)
        size, hop, low, high = int(sr * 0.04), int(sr * 0.02), int(sr / 400), int(sr / 60)
        found = []
        for i in range(0, len(x) - size + 1, hop):
            frame = x[i : i + size] - x[i : i + size].mean()
            if np.sqrt((frame**2).mean()) < 0.02:
                continue
            corr = np.correlate(frame, frame, "full")[size - 1 :]
            lag = low + int(np.argmax(corr[low : min(high, size - 1)]))
            if corr[0] > 0 and corr[lag] / corr[0] >= 0.3:
                found.append(sr / lag)
        return float(np.median(found)) if found else None

    return pd.Series([None if x is None else one(x, int(r)) for x, r in zip(pcm, rate)], dtype="float64")


#: A sentence of the timing rule: up to a run of marks with its closing quotes and brackets, or the rest.
TIMED = r"([^.!?]*[.!?]+[\"'”’)\]]*|[^.!?]+$)"


def timings(texts: DataFrame, key: str, text: str, total_ms: Column) -> DataFrame:
    """Estimated times of the words and sentences of each text: ``kind``, ``start_ms``, ``end_ms``, ``char_start``, ``char_end``.

    Each sentence gets the share of the whole that its characters without white space have, each word the share of its
    sentence; the last one ends where the whole does. Blank texts and durations of nothing have no rows. ``key`` must tell
    rows apart.
    """
    rows = texts.select(F.col(key).alias("k"), F.col(text).alias("t"), total_ms.cast("bigint").alias("total")).where("total > 0 AND t IS NOT NULL")
    cut = let(F.regexp_extract_all("t", F.lit(TIMED), F.lit(1)), lambda p: F.transform(p, lambda s, i: F.struct(s.alias("s"), F.length(F.array_join(F.slice(p, 1, i), "")).alias("at"))))
    lead = F.length(F.regexp_extract("s", f"^{WHITE}*", 0))
    bare = F.regexp_replace("s", f"^{WHITE}+|{WHITE}+$", "")
    weight = F.greatest(F.lit(1), F.length(F.regexp_replace("body", WHITE, "")))
    sents = rows.select("k", "total", F.posexplode(cut).alias("i", "c")).select("k", "total", "i", F.col("c.s").alias("s"), F.col("c.at").alias("at"))
    sents = sents.select("k", "total", "i", bare.alias("body"), (F.col("at") + lead).alias("char_start")).where("body <> ''").withColumn("w", weight.cast("bigint"))
    order = Window.partitionBy("k").orderBy("i")
    every = Window.partitionBy("k")
    upto = F.sum("w").over(order)
    sents = sents.select("*", upto.alias("upto"), F.sum("w").over(every).alias("all"))
    sents = sents.select("k", "i", "body", "char_start", F.expr("((upto - w) * total) div all").alias("start_ms"), F.expr("(upto * total) div all").alias("end_ms"))
    spoken = let(
        F.split("body", WHITE),
        lambda p: F.filter(F.transform(p, lambda s, j: F.struct(s.alias("s"), (F.length(F.array_join(F.slice(p, 1, j), "")) + j).alias("at"))), lambda x: x["s"] != ""),
    )
    words = sents.select("k", "i", "char_start", "start_ms", "end_ms", F.posexplode(spoken).alias("j", "c"))
    words = words.withColumn("w", F.length("c.s").cast("bigint"))
    inside = Window.partitionBy("k", "i")
    words = words.select("*", F.sum("w").over(inside.orderBy("j")).alias("upto"), F.sum("w").over(inside).alias("all"))
    timed = words.select(
        "k",
        F.lit("WORD").alias("kind"),
        F.expr("start_ms + ((upto - w) * (end_ms - start_ms)) div all").alias("a"),
        F.expr("start_ms + (upto * (end_ms - start_ms)) div all").alias("b"),
        (F.col("char_start") + F.col("c.at")).alias("c0"),
        (F.col("char_start") + F.col("c.at") + F.length("c.s")).alias("c1"),
    )
    whole = sents.select("k", F.lit("SENTENCE").alias("kind"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), F.col("char_start").alias("c0"), (F.col("char_start") + F.length("body")).alias("c1"))
    return timed.unionByName(whole).select(F.col("k").alias(key), "kind", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), F.col("c0").alias("char_start"), F.col("c1").alias("char_end"))


def sliced(words: DataFrame, key: str, low: Column, high: Column) -> DataFrame:
    """The timings of the words that lie wholly in ``[low, high)``, counted from the first one's start."""
    inside = words.where((F.col("kind") == "WORD") & (F.col("char_start") >= low) & (F.col("char_end") <= high))
    first = F.min("start_ms").over(Window.partitionBy(key))
    return inside.select(key, (F.col("start_ms") - first).alias("start_ms"), (F.col("end_ms") - first).alias("end_ms"), (F.col("char_start") - low).alias("char_start"), (F.col("char_end") - low).alias("char_end"))
