"""One consistent form for texts that look the same but differ in their characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomtext.session import checkpointed, spread

# Letters of other scripts with the Latin letter of the same printed shape.
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ѵ": "V", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Һ": "H",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y", "Ү": "Y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J", "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "υ": "u",
    "ϳ": "j",
    # Armenian
    "Օ": "O", "Ս": "U", "Տ": "S", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "ꮯ": "c", "ꮪ": "s", "ꮩ": "v", "ꮃ": "w", "ꮓ": "z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K",
    "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W",
    "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # Latin variants, among them small capitals of the shape of the small letter
    "ɑ": "a", "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    # Coptic
    "ⲟ": "o", "Ⲟ": "O", "ⲣ": "p", "Ⲣ": "P", "ⲥ": "c", "Ⲥ": "C",
    # Kana
    "ヘ": "へ",
    # Marks
    "‐": "-", "‒": "–", "−": "–", "―": "—", "ʼ": "’", "ʻ": "‘",
}

_ALIKE = str.maketrans(LOOK_ALIKE)


def _back(block: str) -> dict[int, str]:
    """From the Latin letters to those of the same shape in a block of Unicode's names, the first of each."""
    out: dict[int, str] = {}
    for own, latin in LOOK_ALIKE.items():
        if unicodedata.name(own).startswith(block) and latin.isalpha():
            out.setdefault(ord(latin), own)
    return out


#: A word that keeps a letter of one of these scripts belongs to it, and so do its letters of Latin shape.
_HOMES = [(regex.compile(rf"\p{{{block.title()}}}"), _back(block)) for block in ("CYRILLIC", "GREEK")]
_OTHER = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_WORD = regex.compile(r"[\p{L}\p{M}]+")


def _home(word: regex.Match) -> str:
    text = word.group()
    found = [letters for script, letters in _HOMES if script.search(text)]
    return text.translate(found[0]) if len(found) == 1 else text


_IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cc}--\p{White_Space}]+", regex.V1)
_SPACE = regex.compile(r"\p{White_Space}+")


@lru_cache(maxsize=1)
def _raised() -> regex.Pattern:
    """Characters that compatibility normalisation would lower: raised and sunk figures and letters."""
    marked = (c for c in map(chr, range(0xA0, 0x20000)) if unicodedata.decomposition(c).startswith(("<super>", "<sub>")))
    return regex.compile("([" + "".join(map(regex.escape, marked)) + "]+)")


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters that may compose with the one before."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0xA0, 0x20000))
    jamo = map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)))
    return frozenset([*(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")), *jamo])


_IGNORED, _RAISES, _NORMALISED, _TWIN = 1, 2, 4, 8


class _Traits(dict):
    """What each character may need: to be left out, to be kept raised, to be normalised, or to take the letter of its shape."""

    def __missing__(self, c: str) -> int:
        apart = unicodedata.normalize("NFD", c)
        bits = _IGNORED if _IGNORABLE.match(c) else 0
        bits |= _RAISES if _raised().match(c) else 0
        bits |= _NORMALISED if unicodedata.normalize("NFKC", c) != c or unicodedata.combining(c) or c in _seconds() else 0
        # A letter of a script with Latin twins tells the script of its word.
        bits |= _TWIN if _OTHER.search(apart) or any(x in LOOK_ALIKE for x in apart) else 0
        self[c] = bits
        return bits


_TRAITS = _Traits()


def _spaced(text: str) -> str:
    """Each stretch of white space as one space, none at the ends."""
    if text.isprintable():
        return " ".join(filter(None, text.split(" "))) if "  " in text or text[:1] == " " or text[-1:] == " " else text
    return _SPACE.sub(" ", text).strip(" ")


def canonical(text: str, fold_case: bool = False, keep_raised: bool = True, alike: bool = True, twins: Mapping[int, str] = _ALIKE) -> str:
    """The form that texts which look the same share.

    Compatibility normalisation in composed form, default-ignorable and control characters
    removed, each stretch of white space as one space and none at the ends. ``keep_raised`` leaves
    raised and sunk characters as they are, ``alike`` gives letters of one shape one script:
    that of the letters in their word that have no twin, else Latin, ``fold_case`` adds full case folding. ``twins`` are
    the letters of one shape, by default those of ``LOOK_ALIKE`` (see ``read_twins``). Applying it twice changes nothing.
    """
    out = _spaced(text)
    need = 0
    for c in set(out):
        need |= _TRAITS[c]
    own = twins is not _ALIKE
    if not need and not own:
        return unicodedata.normalize("NFC", out.casefold()) if fold_case and not out.isascii() else out.casefold() if fold_case else out
    if need & _IGNORED:
        out = _IGNORABLE.sub("", out)
    if need & _NORMALISED:
        pieces = _raised().split(out) if keep_raised and need & _RAISES else [out]
        pieces[::2] = [unicodedata.normalize("NFKC", p) for p in pieces[::2]]
        out = "".join(pieces)
    if need & (_NORMALISED | _TWIN) or fold_case or own:
        # Decomposed, so that an accented look-alike gives the accented letter.
        out = unicodedata.normalize("NFD", out)
        for _ in range(2 if fold_case else 1):
            out = out.translate(twins) if alike else out
            out = unicodedata.normalize("NFD", out.casefold()) if fold_case else out
        if alike and _OTHER.search(out):
            # A word with a letter that no Latin one looks like goes back to its own script as a whole.
            out = _WORD.sub(_home, out)
        out = unicodedata.normalize("NFC", out)
    return _spaced(_IGNORABLE.sub("", out))


def read_twins(lines: Iterable[str]) -> dict[int, str]:
    """Letters of one shape from lines of the public list of confusable characters (``0441 ; 0063 ; MA``), added to ``LOOK_ALIKE``.

    Only single characters that stand for a single letter are taken; a list of all confusables also joins marks and
    sequences that readers tell apart.
    """
    out = dict(_ALIKE)
    for line in lines:
        fields = [f.strip() for f in line.split("#")[0].lstrip("\ufeff").split(";")]
        if len(fields) >= 2 and len(fields[0].split()) == len(fields[1].split()) == 1:
            own, other = (chr(int(f, 16)) for f in fields[:2])
            if own.isalpha() and other.isalpha() and not own.isascii():
                out[ord(own)] = other
    return out


def per_distinct(texts: pa.Array, change: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """``change`` of each text, called once for each distinct value; null stays null."""
    coded = texts.dictionary_encode()
    values = pa.array([change(t) for t in coded.dictionary.to_pylist()], kind)
    return values.take(coded.indices)


def canonical_texts(df: DataFrame, text: str = "text", to: str = "canonical", fold_case: bool = False) -> DataFrame:
    """``df`` with the canonical form of ``text`` in a further column ``to`` (which must not exist). A null text has a null form."""
    if to in df.columns:
        raise ValueError(f"{to} is already a column")
    schema = StructType([*df.schema.fields, StructField(to, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            form = per_distinct(batch.column(at).cast(pa.string()), lambda t: canonical(t, fold_case), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, form], names=[*batch.schema.names, to])

    return spread(df).mapInArrow(run, schema)


#: Texts of these characters alone need no more than their white space set right.
_PLAIN = r"\A[\x20-\x7e]*\z"
#: Rows of one string that one task pairs.
SALTED = 1_000


def _forms(texts: DataFrame, group: list[str], key: str, text: str) -> DataFrame:
    """``_g0`` .., ``_id``, ``form``, ``string`` (digests) of the rows with a letter or digit; plain texts do not leave the JVM."""
    names = [f"_g{i}" for i in range(len(group))]
    # A constant group column may come as non-nullable; the filter costs nothing then.
    rows = texts.select(*[F.col(g).alias(n) for g, n in zip(group, names)], F.col(key).alias("_id"), F.col(text).cast("string").alias("_t")).where(
        " AND ".join(f"`{n}` IS NOT NULL" for n in [*names, "_id", "_t"])
    )
    plain = F.col("_t").rlike(_PLAIN)
    worded = F.col("_t").rlike("[A-Za-z0-9]")
    split = rows.select(
        *names,
        "_id",
        F.md5("_t").alias("string"),
        F.when(plain, F.when(worded, F.md5(F.trim(F.regexp_replace("_t", " +", " ")))).otherwise("")).alias("_plain"),
        F.when(~plain, F.col("_t")).alias("_t"),
    )
    formed = canonical_texts(split, "_t", "_c")
    return formed.select(*names, "_id", F.coalesce("_plain", F.when(F.col("_c").rlike(r"[\p{L}\p{N}]"), F.md5("_c"))).alias("form"), "string").where("form <> ''")


def look_alike_classes(texts: DataFrame, group: list[str], key: str, text: str) -> DataFrame:
    """``group``, ``key`` and ``class`` (the least key of a text of the same group that looks the same) of every row with a letter or digit.

    Null texts and rows with a null group or key have no class; repeated rows count once. The class form stands for any
    number of equal looking rows without pairing them.
    """
    names = [f"_g{i}" for i in range(len(group))]
    keyed = _forms(texts, group, key, text).select(*names, "_id", "form").distinct()
    least = keyed.groupBy(*names, "form").agg(F.min("_id").alias("class"))
    return keyed.join(least, [*names, "form"]).select(*[F.col(n).alias(g) for n, g in zip(names, group)], F.col("_id").alias(key), "class")


def look_alike_pairs(texts: DataFrame, group: list[str], key: str, text: str, salted: int = SALTED) -> DataFrame:
    """Pairs ``id_a`` < ``id_b`` of one ``group`` whose texts look the same but are different strings.

    Texts without a letter or digit, null texts and rows with a null group or key have no pairs; equal strings
    are no pair; repeated rows of one key count once. Texts are first reduced to their distinct
    strings in each group; only strings that share a form with another string are joined back, each
    pair of strings on its own, so a string repeated any number of times meets only the strings
    that differ from it. The rows of a string that many share are spread over buckets of about ``salted`` rows on
    one side, and those of its partner are copied to each. Other columns are not read.
    """
    names = [f"_g{i}" for i in range(len(group))]
    keyed = checkpointed(_forms(texts, group, key, text))
    # Only the rows of forms that several strings have are kept; they are few.
    shared = keyed.groupBy(*names, "form").agg(F.min("string").alias("least"), F.max("string").alias("most")).where("least <> most").select(*names, "form")
    rows = checkpointed(keyed.join(shared, [*names, "form"], "left_semi").dropDuplicates([*names, "_id", "string", "form"]))
    several = rows.groupBy(*names, "form", "string").agg(F.ceil(F.count("*") / salted).cast("int").alias("salts"))
    matches = several.withColumnsRenamed({"string": "left_string", "salts": "left_salts"}).join(
        several.select(*names, "form", F.col("string").alias("right_string")), [*names, "form"]
    )
    matches = matches.where(F.col("left_string") < F.col("right_string"))
    members = rows.join(several, [*names, "form", "string"])
    left = members.select(*names, "form", F.col("string").alias("left_string"), F.pmod(F.xxhash64("_id"), F.col("salts")).cast("int").alias("salt"), F.col("_id").alias("_l"))
    right = (
        matches.join(rows.select(*names, "form", F.col("string").alias("right_string"), F.col("_id").alias("_r")), [*names, "form", "right_string"])
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("left_salts") - 1)))
        .drop("left_salts")
    )
    return (
        right.join(left, [*names, "form", "left_string", "salt"])
        .where(F.col("_l") != F.col("_r"))
        .select(*[F.col(n).alias(g) for n, g in zip(names, group)], F.least("_l", "_r").alias("id_a"), F.greatest("_l", "_r").alias("id_b"))
    )
