"""Manifests of a book's cast as JSON, and sound as RIFF files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1

VOICE = "speakerId INT, espeakVoice STRING, lengthScale DOUBLE, targetF0Hz DOUBLE, description STRING, source STRING"
CHARACTER = f"id STRING, displayName STRING, aliases ARRAY<STRING>, gender STRING, ageBand STRING, traits ARRAY<STRING>, confidence DOUBLE, firstSeenLocator STRING, lineCount INT, voice STRUCT<{VOICE}>"
MANIFEST = f"schemaVersion INT, bookId STRING, generatedAt BIGINT, narrator STRUCT<{CHARACTER}>, characters ARRAY<STRUCT<{CHARACTER}>>"
_KNOWN = "schemaVersion bookId generatedAt narrator characters".split()


def decoded(df: DataFrame, text: str = "json") -> DataFrame:
    """``df`` with ``manifest`` and ``extras`` (unknown top-level keys with their JSON); a manifest that is not valid is an error that names the field.

    Checked: it is an object, of a version that is known, with book, time and narrator; ids are unique, confidences lie
    between 0 and 1, line counts are not negative. Unknown genders and ages become UNKNOWN.
    """
    m = F.from_json(text, MANIFEST, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(text)
    extras = F.map_from_entries(F.transform(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: ~k.isin(_KNOWN)), lambda k: F.struct(k, F.from_json(text, "map<string,string>")[k])))
    return df.withColumn("manifest", _valid(m, keys)).withColumn("extras", extras)


def _valid(m: Column, keys: Column) -> Column:
    people = F.coalesce(m["characters"], F.slice(F.array(m["narrator"]), 1, 0))
    everyone = F.concat(F.array(m["narrator"]), people)
    ids = F.transform(people, lambda c: c["id"])
    fail = lambda message: F.raise_error(F.lit(message))
    return (
        F.when(keys.isNull(), fail("$: not a JSON object"))
        .when(m["schemaVersion"].isNull(), fail("schemaVersion: missing or not a number"))
        .when(m["schemaVersion"] > VERSION, fail("schemaVersion: newer than this build reads"))
        .when(m["bookId"].isNull(), fail("bookId: missing or not a string"))
        .when(m["generatedAt"].isNull(), fail("generatedAt: missing or not a number"))
        .when(m["narrator"].isNull(), fail("narrator: missing"))
        .when(F.size(ids) != F.size(F.array_distinct(ids)), fail("characters[].id: duplicate id"))
        .when(F.exists(everyone, lambda c: c["id"].isNull()), fail("characters[].id: missing or not a string"))
        .when(F.exists(everyone, lambda c: ~F.coalesce(c["confidence"], F.lit(0.0)).between(0, 1)), fail("characters[].confidence: must be between 0 and 1"))
        .when(F.exists(everyone, lambda c: F.coalesce(c["lineCount"], F.lit(0)) < 0), fail("characters[].lineCount: must not be negative"))
        .otherwise(m)
    )


def encoded(manifest: Column, extras: Column | None = None) -> Column:
    """A manifest as JSON: known keys first, unknown ones last, genders and ages in lower case, no nulls."""

    def lower(c: Column) -> Column:
        return F.when(c.isNotNull(), c.withField("gender", F.lower(c["gender"])).withField("ageBand", F.lower(c["ageBand"])))

    known = F.to_json(manifest.withField("narrator", lower(manifest["narrator"])).withField("characters", F.transform(manifest["characters"], lower)), {"ignoreNullFields": "true"})
    if extras is None:
        return known
    def quoted(key: Column) -> Column:
        return F.regexp_extract(F.to_json(F.array(key)), r"^\[(.*)\]$", 1)

    # A value that is a string loses its quotes when read as a map of strings; other values are JSON already.
    def value(v: Column) -> Column:
        return F.when(v.rlike(r"^\s*[\[{]") | v.rlike(r"^-?[0-9.]+([eE][+-]?[0-9]+)?$") | v.isin("true", "false", "null"), v).otherwise(quoted(v))

    more = F.array_join(F.transform(F.map_entries(extras), lambda e: F.concat(quoted(e["key"]), F.lit(":"), value(e["value"]))), ",")
    return F.when(F.size(extras) > 0, F.concat(F.regexp_replace(known, r"\}$", ","), more, F.lit("}"))).otherwise(known)


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A RIFF file of one channel of 16-bit samples, rounded and clipped."""
    data = np.floor(np.clip(np.asarray(samples, float), -1, 1) * 32767 + 0.5).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(data))
    return head + data


def wav_samples(content: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of a RIFF file; other than one channel of 16 bits is an error. Chunks begin at even bytes."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate, channels, bits, data = 12, 0, 1, 16, None
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if data is None:
        raise ValueError("no data chunk")
    if bits != 16 or channels != 1:
        raise ValueError(f"expected one channel of 16 bits, got {channels} of {bits}")
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2") / 32767.0, rate


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``rate``, ``pcm`` of the sound files of a folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [wav_samples(c) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "rate": [r for _, r in found], "pcm": [list(s) for s, _ in found]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, rate int, pcm array<double>")
