"""Loading of delimited lines with the rows that do not parse kept apart, each with its reason."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.session import spread



def _stand_ins(text: str) -> tuple[str, str]:
    """Two characters that do not occur in ``text``, to stand for line breaks inside a field, which would end the row for the CSV reader."""
    used = set(text)
    free = (c for c in map(chr, (*range(0xFDD0, 0xFDF0), *range(0xE000, 0xF900), *range(0xF0000, 0xFFFFE), *range(0x100000, 0x10FFFE))) if c not in used)
    return next(free), next(free)

#: Where every quote of a line stands as it must: a field that begins with one ends with one.
_QUOTED_LINE = re.compile(r'(?:"[^"]*(?:""[^"]*)*"|[^",]*)(?:,(?:"[^"]*(?:""[^"]*)*"|[^",]*))*')


def _matches(pattern: str) -> Callable[[pd.Series], pd.Series]:
    compiled = re.compile(pattern)
    return lambda s: s.str.strip().str.fullmatch(compiled)


def _at_least_one(s: pd.Series) -> pd.Series:
    return s.str.strip().str.fullmatch(r"[0-9]+") & s.str.contains(r"[1-9]")


def _unit_interval(s: pd.Series) -> pd.Series:
    bare = s.str.strip()
    plain = bare.str.fullmatch(r"[0-9]+(?:\.[0-9]+)?|\.[0-9]+")
    return plain & (pd.to_numeric(bare.where(plain), errors="coerce") <= 1)


def _sound(breaks: bool) -> Callable[[pd.Series], pd.Series]:
    bad = re.compile("[�\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x9f]" if breaks else "[�\x00-\x1f\x7f-\x9f]")
    return lambda s: ~s.str.contains(bad) & (s.str.strip() != "")


@dataclass(frozen=True)
class Layout:
    """The fields of a feed: names, Spark types, and what a value must be to be valid."""

    name: str
    delimiter: str
    quoted: bool
    header: str
    fields: tuple[tuple[str, str, Callable[[pd.Series], pd.Series] | None], ...]
    kept: frozenset[str] = field(default_factory=frozenset)  # texts whose outer white space counts


_DIGITS = _matches(r"[0-9]+")

HOST_TRACE = Layout(
    "trace",
    "\t",
    False,
    "wall",
    (
        ("wall", "string", _matches(r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\.[0-9]{3}")),
        ("utterance", "bigint", _DIGITS),
        ("gap_ms", "bigint", _DIGITS),
        ("chars", "bigint", _DIGITS),
        ("rate", "bigint", _DIGITS),
        ("pitch", "bigint", _DIGITS),
        ("locale", "string", _matches(r"[a-z]{3}-[A-Z]{3}")),
        ("voice", "string", lambda s: s.str.strip() != ""),
        ("caller_uid", "bigint", _DIGITS),
        ("text", "string", _sound(breaks=False)),
    ),
    frozenset({"text"}),
)

SPEAKER_LABELS = Layout(
    "labels",
    ",",
    True,
    "c0,",
    (
        ("book_id", "string", _matches(r"[0-9a-f]{16}")),
        ("chapter", "bigint", _at_least_one),
        ("seq", "bigint", _DIGITS),
        ("kind", "string", _matches(r"NARRATION|DIALOGUE")),
        ("speaker", "string", None),
        ("confidence", "double", _unit_interval),
        ("sentence", "string", _sound(breaks=True)),
    ),
)


def _parse(lines: pd.Series, layout: Layout) -> pd.DataFrame:
    """Of each line: ``reason`` (null if it loads), ``bad`` field names, ``values`` as strings; lines that are no rows are left out."""
    lines = lines.dropna()
    lines = lines.str.replace(r"\r?\n?\Z", "", regex=True)
    rows = lines[(lines.str.strip() != "") & ~lines.str.startswith("#") & ~lines.str.startswith(layout.header)]
    out = pd.DataFrame({"reason": None, "bad": None, "values": None}, index=rows.index, dtype=object)
    if layout.quoted:
        wrong = ~rows.str.fullmatch(_QUOTED_LINE)
        out.loc[wrong[wrong].index, "reason"] = "quoting"
        rows = rows[~wrong]
    if rows.empty:
        return out
    feed, back = _stand_ins("".join(rows))
    flat = rows.str.translate({10: feed, 13: back})
    rejected: list[int] = []

    def on_invalid(row: pacsv.InvalidRow) -> str:
        rejected.append(int(row.text.split(layout.delimiter, 1)[0]))
        return "skip"

    names = ["#"] + [name for name, _, _ in layout.fields]
    buffer = "\n".join(f"{i}{layout.delimiter}{line}" for i, line in enumerate(flat)).encode() + b"\n"
    table = pacsv.read_csv(
        pa.BufferReader(buffer),
        read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=len(buffer) + 1),
        parse_options=pacsv.ParseOptions(
            delimiter=layout.delimiter,
            quote_char='"' if layout.quoted else False,
            double_quote=layout.quoted,
            escape_char=False,
            newlines_in_values=False,
            ignore_empty_lines=False,
            invalid_row_handler=on_invalid,
        ),
        convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
    )
    out.loc[rows.index[rejected], "reason"] = "columns"
    cells = table.to_pandas()
    if cells.empty:
        return out
    cells.index = rows.index[cells.pop("#").astype(int)]
    fails = pd.DataFrame(index=cells.index)
    for name, _, valid in layout.fields:
        cells[name] = cells[name].str.translate({ord(feed): "\n", ord(back): "\r"})
        fails[name] = False if valid is None else ~valid(cells[name]).astype(bool)
    for name, _, _ in layout.fields:
        if name not in layout.kept:
            cells[name] = cells[name].str.strip()
    invalid = fails.any(axis=1)
    out.loc[invalid[invalid].index, "reason"] = "value"
    marks = np.array([n for n, _, _ in layout.fields], dtype=object)
    out.loc[cells.index, "bad"] = pd.Series([list(marks[row]) for row in fails.to_numpy(dtype=bool)], index=cells.index)
    out.loc[cells.index, "values"] = pd.Series(list(cells.to_numpy(dtype=object)), index=cells.index)
    return out


def parse_lines(lines: DataFrame, layout: Layout, key: str = "line_id", raw: str = "raw_line") -> DataFrame:
    """Each line that should be a row: ``key``, ``reason``, ``bad`` (names of failing cells), ``cells``.

    Structural rejects come from the CSV reader's invalid-row callback after a check of the quotes;
    all fields are read as strings and tested column by column. ``reason`` is null for a loaded
    row, else ``quoting``, ``columns`` or ``value``, the first that holds. Null and blank lines,
    comments and repeated headers are no rows. Lines that share a key are each parsed; an empty
    table gives an empty result; other columns of ``lines`` are not read.
    """
    key_type = lines.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            parsed = _parse(batch.column(1).to_pandas(), layout)
            if parsed.empty:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(parsed.index.to_numpy(), pa.int64())),
                    pa.array(parsed["reason"], pa.string(), from_pandas=True),
                    pa.array(parsed["bad"], pa.list_(pa.string()), from_pandas=True),
                    pa.array([None if v is None else list(v) for v in parsed["values"]], pa.list_(pa.string())),
                ],
                names=["k", "reason", "bad", "cells"],
            )

    return (
        spread(lines.select(F.col(key).alias("k"), F.col(raw).cast("string").alias("raw")))
        .mapInArrow(run, f"k {key_type}, reason string, bad array<string>, cells array<string>")
        .withColumnRenamed("k", key)
    )


def loaded(parsed: DataFrame, layout: Layout, key: str = "line_id") -> DataFrame:
    """The rows that load, with the layout's names and types; digits beyond the type's range become null."""

    def cell(i: int, kind: str) -> Column:
        value = F.col("cells")[i]
        return value if kind == "string" else value.try_cast(kind)

    columns = [cell(i, kind).alias(name) for i, (name, kind, _) in enumerate(layout.fields)]
    return parsed.where(F.col("reason").isNull()).select(key, *columns)


def failed(parsed: DataFrame, key: str = "line_id") -> DataFrame:
    """The lines that fail, with the reason and the names of the failing cells."""
    return parsed.where(F.col("reason").isNotNull()).select(key, "reason", "bad")
