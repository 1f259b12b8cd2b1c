"""Text functions as Columns: sentences, normal form, prefixes, hashes, marks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: Unicode white space as a character class, the same in Java's and RE2's dialect.
_SPACES = r"\p{Z}\t-\r\x1c-\x1f\x{85}"
WHITE = f"[{_SPACES}]"
WORDLIKE = r"[\p{L}\p{Nd}]"

# Abbreviations whose period ends no sentence of the index.
ABBREVIATIONS = "mr mrs ms dr prof st sr jr capt col gen lt sgt rev hon esq vs etc".split()
# Characters that the normal form drops.
STRIPPED = "\"“”‘’«»­​﻿*†‡"
#: Words of a sentence's opening that the index can find it by.
HEAD_WORDS = 6

_HELD, _CUT = "\x01", "\x02"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def is_blank(c: Column) -> Column:
    return c.rlike(rf"\A{WHITE}*\z")


#: Further ones that a wider reading of abbreviations holds.
WIDE_ABBREVIATIONS = [*ABBREVIATIONS, "e.g", "i.e"]


def unquoted(c: Column) -> Column:
    """Without white space and double quotation marks at the ends."""
    return strip(F.regexp_replace(strip(c), r'^["“”]+|["“”]+$', ""))


def index_sentences(c: Column, known: list[str] = ABBREVIATIONS) -> Column:
    """Sentences as the index holds them: a break after ``.!?`` at the end or before a space, tab or line break.

    A period of an abbreviation does not break, a closing quote right after the mark blocks the break, blank
    pieces are dropped, the rest is stripped.
    """
    abbreviations = "|".join(a.replace(".", "[.]") for a in known)
    held = F.regexp_replace(c, rf"(?i)((?:^|{WHITE})(?:{abbreviations}))[.](?=[ \n\r\t]|$)", "$1" + _HELD)
    cut = F.regexp_replace(held, r"([.!?])([ \n\r\t])", "$1" + _CUT + "$2")
    parts = F.transform(F.split(cut, _CUT), lambda s: strip(F.translate(s, _HELD, ".")))
    return F.filter(parts, lambda s: s != "")


def plain_sentences(c: Column) -> Column:
    """Sentences of narration: a break at white space behind ``.!?``; blank pieces are dropped."""
    cut = F.regexp_replace(c, r"([.!?])[ \t\n\x0b\f\r]+", "$1" + _CUT)
    return F.filter(F.split(cut, _CUT), lambda s: ~is_blank(s))


def normal_form(c: Column) -> Column:
    """Letters and digits in lower case, apostrophes kept, white space and dashes as one space, the rest dropped.

    For text that is already in compatibility form; see :func:`compatible`.
    """
    bare = F.translate(c, STRIPPED, "")
    spaced = F.regexp_replace(bare, f"[{_SPACES}—-]+", " ")
    lower = F.lower(F.translate(spaced, "Σİ", "σi"))
    kept = F.regexp_replace(lower, r"[^\p{L}\p{Nd}' ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


@F.pandas_udf(StringType())
def compatible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility normalisation (composed form), once for each distinct value of a batch."""
    for s in batches:
        codes, values = pd.factorize(s)
        forms = pd.Series([v if v.isascii() else unicodedata.normalize("NFKC", v) for v in values], dtype=object)
        yield pd.Series([None if k < 0 else forms[k] for k in codes])


def full_form(c: Column) -> Column:
    """The normal form with the compatibility step; texts of ASCII alone do not leave the JVM for it."""
    ascii_only = c.rlike(r"\A\p{ASCII}*\z")
    return normal_form(F.coalesce(compatible(F.when(~ascii_only, c)), c))


def openings(normal: Column, most: int = HEAD_WORDS) -> Column:
    """The openings of one to ``most`` words of a text in normal form."""
    return let(F.split(normal, " "), lambda words: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(words))), lambda n: F.array_join(F.slice(words, 1, n), " ")))


def fnv64(c: Column) -> Column:
    """The 64-bit FNV-1a hash over UTF-16 units, in two halves of 32 bits so that no product overflows."""
    low = (1 << 32) - 1

    def units(h: Column) -> Column:
        """The UTF-16 units of a text given as hexadecimal digits, four to a unit."""
        one = F.lit(1).cast("int")
        places = F.when(F.length(h) > 0, F.sequence(one, (F.length(h) / 4).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.conv(F.substr(h, 4 * i - 3, F.lit(4)), 16, 10).cast("bigint"))

    start = F.struct(F.lit(3421674724).cast("bigint").alias("hi"), F.lit(2216829733).cast("bigint").alias("lo"))

    def step(state: Column, unit: Column) -> Column:
        x = state["lo"].bitwiseXOR(unit)
        product = x * 435
        return F.struct(
            ((state["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(x, 8)).bitwiseAND(F.lit(low))).alias("hi"),
            product.bitwiseAND(F.lit(low)).alias("lo"),
        )

    code = F.hex(F.encode(c, "UTF-16BE"))
    return let(
        let(code, lambda h: F.aggregate(units(h), start, step)),
        lambda done: F.shiftleft(done["hi"], 32).bitwiseOR(done["lo"]),
    )


@F.pandas_udf(LongType())
def fnv64_batched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Equal to :func:`fnv64`, for many texts: once for each distinct value of a batch, unit by unit over all of them; null for null."""
    for s in batches:
        codes, values = pd.factorize(s)
        units = [v.encode("utf-16-le") for v in values]
        sizes = np.array([len(u) // 2 for u in units], dtype=np.int64)
        longest_first = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[longest_first]
        flat = np.frombuffer(b"".join(units), dtype="<u2").astype(np.uint64)
        h = np.full(len(units), 0xCBF29CE484222325, dtype=np.uint64)
        # So many texts have a unit at each place.
        reach = len(units) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
        for j, m in enumerate(reach.tolist()):
            h[:m] = (h[:m] ^ flat[starts[:m] + j]) * np.uint64(0x100000001B3)
        hashes = np.empty(len(units), dtype=np.int64)
        hashes[longest_first] = h.view(np.int64)
        yield pd.Series([None if k < 0 else int(hashes[k]) for k in codes], dtype="Int64")


def is_scene_break(c: Column) -> Column:
    """A paragraph of nothing but white space and break marks."""
    return c.rlike(rf"\A[{_SPACES}*·•#~=_.,\-‐‑‒–—―]*\z")


def is_heading(c: Column) -> Column:
    """A paragraph that names a chapter, book, part or volume, or is a bare roman or arabic numeral."""
    return strip(c).rlike(r"(?i)\A(?:(?:chapter|book|part|volume)\b.*|[ivxlcdm]+\.?|[0-9]+\.?)\z")


def estimated_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("int")


def _count(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.translate(c, mark, ""))


def leaves_quotation_open(c: Column) -> Column:
    return (_count(c, '"') % 2 == 1) | (_count(c, "“") > _count(c, "”"))


def opens_quotation(c: Column) -> Column:
    return F.substring(strip(c), 1, 1).isin('"', "“", "«")


def word_set(c: Column) -> Column:
    """The distinct lower-case words of letters a to z, sorted."""
    words = F.split(F.regexp_replace(F.lower(c), "[^a-z ]", " "), " +")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def same_by_words(a: Column, b: Column) -> Column:
    """Whether two names agree: the words of one are all among the other's."""
    return let(
        word_set(a),
        lambda x: let(word_set(b), lambda y: (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))),
    )


def comma_chunks(c: Column) -> Column:
    """The text split behind each comma."""
    return F.filter(F.split(F.regexp_replace(c, ",", "," + _CUT), _CUT), lambda s: s != "")


def word_tokens(c: Column) -> Column:
    """Runs of word characters, and single marks."""
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_\s])"), F.lit(1))


def known_or(c: Column, known: list[str], default: str = "UNKNOWN") -> Column:
    """The upper-case value if it is known, else ``default``."""
    up = F.upper(c)
    return F.when(up.isin(*known), up).otherwise(default)


def char_of_byte(c: Column, byte: Column) -> Column:
    """The character at which byte ``byte`` of the UTF-8 form lies."""
    return F.length(F.decode(F.substr(F.encode(c, "UTF-8"), F.lit(1), byte), "UTF-8"))
