"""Oversized texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.sentences import sentence_spans
from loomtext.session import spread

#: Boundaries from the strongest to the weakest: a cut may fall where a match ends.
_PARAGRAPH = regex.compile(r"\n[^\S\n]*\n\s*|\p{Zp}+\s*")
_LINE = regex.compile(r"[\n\r\p{Zl}\x85]+\s*")
_CLAUSE = regex.compile(r"[,;:،؛、，；：—–](?=[\s\p{P}]|[\p{Han}\p{Hiragana}\p{Katakana}])[\p{P}]*\s*|(?<=[\p{Han}\p{Hiragana}\p{Katakana}])[、，；：]")
_SPACE = regex.compile(r"\s+")
_MARK = regex.compile(r"\p{P}+")
_GLYPH = regex.compile(r"\X")
#: A stretch without white space or marks.
_RUN = regex.compile(r"[^\s\x85\p{Z}\p{P}]+")


def _boundaries(text: str) -> list[list[int]]:
    """Places where a cut may fall, by falling strength; those between glyphs are looked for only when none of these serves."""
    ends = [[m.end() for m in pattern.finditer(text)] for pattern in (_PARAGRAPH, _LINE)]
    starts = [a for a, _ in sentence_spans(text)]
    return [*ends, starts, *[[m.end() for m in pattern.finditer(text)] for pattern in (_CLAUSE, _SPACE, _MARK)]]


def cut_points(text: str, room: int, long_run: int | None = None) -> list[tuple[int, bool]]:
    """Where to cut ``text`` so that no part is longer than ``room``, and whether the cut falls into a stretch of more
    than ``long_run`` (default: ``room``) characters without white space or marks.

    A part that is too long is cut at its strongest boundary in the half around the middle (the
    nearest to the middle of equals), else at the natural boundary nearest to the middle, else
    between the two glyphs nearest to the middle, and inside a glyph only if one alone fills the part; both
    halves are then treated alike.
    """
    places = _boundaries(text)
    glyphs: list[int] | None = None
    out: list[int] = []
    todo = [(0, len(text))]
    while todo:
        low, high = todo.pop()
        size = high - low
        if size <= room:
            continue
        middle = low + size // 2

        def nearest(level: list[int], a: int, b: int) -> int | None:
            i, j = bisect_right(level, a), bisect_left(level, b)
            k = bisect_left(level, middle, i, j)
            return min((level[x] for x in (k - 1, k) if i <= x < j), key=lambda p: (abs(p - middle), p), default=None)

        cut = None
        for level in places:
            cut = nearest(level, low + size // 4 - 1, high - size // 4 + 1)
            if cut is not None and low < cut < high:
                break
            cut = None
        if cut is None:
            found = [p for level in places if (p := nearest(level, low, high)) is not None]
            if found:
                cut = min(found, key=lambda p: (abs(p - middle), p))
        if cut is None:
            if glyphs is None:
                glyphs = [m.end() for m in _GLYPH.finditer(text)]
            cut = nearest(glyphs, low, high)
        if cut is None:
            cut = middle
        out.append(cut)
        todo += [(low, cut), (cut, high)]
    out.sort()
    least = room if long_run is None else long_run
    runs = [m.span() for m in _RUN.finditer(text) if m.end() - m.start() > least]
    starts = [a for a, _ in runs]

    def inside(cut: int) -> bool:
        i = bisect_left(starts, cut) - 1
        return i >= 0 and cut < runs[i][1]

    return [(c, inside(c)) for c in out]


def piece_spans(text: str, limit: int = 1000, overlap: int = 100) -> list[tuple[int, int, bool]]:
    """The pieces of a text as ``(start, end, hard)``: none longer than ``limit``, each but the first opening with the
    last ``overlap`` characters of the piece before; ``hard`` if the piece ends inside a stretch of more than ``limit`` characters without white space or marks."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    if len(text) <= limit:
        return [(0, len(text), False)] if text else []
    cuts = cut_points(text, limit - overlap, limit)
    ends = [c for c, _ in cuts] + [len(text)]
    starts = [0] + [c for c, _ in cuts]
    return [(max(0, s - overlap), e, h) for s, e, h in zip(starts, ends, [h for _, h in cuts] + [False])]


def pieces(items: DataFrame, key: str, carry: list[str], text: str = "text", limit: int = 1000, overlap: int = 100) -> DataFrame:
    """The pieces of every text longer than ``limit`` characters.

    Result: ``key``, the columns ``carry``, ``piece`` (0-based), ``piece_start``, ``piece_end`` (half-open, in the item's
    text), ``hard`` and ``piece_text``. Texts within the limit, empty and null texts have no rows. An overlap may be
    shorter than asked only where the piece before is. Repeated rows and keys are cut each time; an empty table gives
    an empty result; other columns are not read. The length is tested before a text leaves the JVM.
    """
    kept = [f"_c{i}" for i in range(len(carry))]
    source = items.select(F.col(key).alias("k"), *[F.col(c).alias(n) for c, n in zip(carry, kept)], F.col(text).cast("string").alias("t")).where(
        F.char_length("t") > limit
    )
    kinds = "".join(f"{n} {items.schema[c].dataType.simpleString()}, " for c, n in zip(carry, kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                spans = piece_spans(t, limit, overlap)
                rows = pa.array([i] * len(spans), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).take(rows) for c in range(batch.num_columns - 1)],
                        pa.array(range(len(spans)), pa.int32()),
                        pa.array([s for s, _, _ in spans], pa.int32()),
                        pa.array([e for _, e, _ in spans], pa.int32()),
                        pa.array([h for _, _, h in spans], pa.bool_()),
                        pa.array([t[s:e] for s, e, _ in spans], pa.string()),
                    ],
                    names=["k", *kept, "piece", "piece_start", "piece_end", "hard", "piece_text"],
                )

    key_type = items.schema[key].dataType.simpleString()
    out = spread(source).mapInArrow(run, f"k {key_type}, {kinds}piece int, piece_start int, piece_end int, hard boolean, piece_text string")
    return out.select(
        F.col("k").alias(key), *[F.col(n).alias(c) for c, n in zip(carry, kept)], "piece", "piece_start", "piece_end", "hard", "piece_text"
    )
