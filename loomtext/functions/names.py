"""Names, pronouns and speech tags around quotations, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import let

# Titles, verbs of speech, and words that are no names or that announce someone spoken to.
TITLES = "Mr Mrs Ms Miss Dr Prof St Sir Lady Lord Captain Capt Colonel Col Major Aunt Uncle Father Mother".split()
VERBS = """said|says|say|asked|asks|replied|replies|answered|answers|cried|cries|shouted|whispered|whispers|murmured|muttered|mutters|exclaimed
continued|continues|added|adds|began|observed|remarked|returned|retorted|protested|insisted|called|calls|screamed|sighed|laughed|groaned|breathed
drawled|snapped|snaps|demanded|demands|inquired|repeated|repeats|admitted|agreed|offered|echoed|mused|ventured|urged|stammered|faltered|announced
declared|growled|hissed|barked|put in|went on|broke in|interrupted""".replace("\n", "|")
SPOKEN_TO = "to at toward towards for with about of from by near beside against behind beyond upon".split()
NOT_NAMES = """The A An And But Or So Then When While After Before There That This These Those What Why How He She They It We You I His Her Their Its
Yes No Oh Ah Well Now Here If As At In On Of For To With From By Not Never Only Even""".split()
FEMALE_TITLES = "mrs ms miss lady aunt mother".split()
MALE_TITLES = "mr sir lord uncle father".split()

# Patterns of a name, and of a speech tag or pronoun before or after a quotation.
NAME = rf"(?:(?:{'|'.join(TITLES)})\.?\s+)?[A-Z][a-zA-Z'’-]+(?:\s+[A-Z][a-zA-Z'’-]+)?"
AFTER_VERB_NAME = rf"^[\s,.;:!?—–-]*\b({VERBS})\s+({NAME})"
AFTER_NAME_VERB = rf"^[\s,.;:!?—–-]*({NAME})\s+\b({VERBS})\b"
BEFORE_NAME_VERB = rf"({NAME})\s+\b({VERBS})\b[\s,:—–-]*$"
BEFORE_VERB_NAME = rf"\b({VERBS})\s+({NAME})[\s,:—–-]*$"
AFTER_PRONOUN = rf"(?i)^[\s,.;:!?—–-]*\b(he|she)\b\s+\b({VERBS})\b"
BEFORE_PRONOUN = rf"(?i)\b(he|she)\b\s+\b({VERBS})\b[\s,:—–-]*$"
# The edges of a word are spelt out, as the dialects differ on letters outside ASCII.
_EDGES = (r"(?i)(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])")
FEMALE = "(she|her|hers|herself)".join(_EDGES)
MALE = "(he|him|his|himself)".join(_EDGES)

_LEFT, _RIGHT = "\x01", "\x02"


def clean(raw: Column) -> Column:
    """A matched name without trailing words that are none; null if nothing or a bare title is left."""

    def dropped(w: Column) -> Column:
        return F.when((F.size(w) > 1) & F.element_at(w, -1).isin(NOT_NAMES), F.slice(w, 1, F.size(w) - 1)).otherwise(w)

    def kept(w: Column) -> Column:
        titled = F.regexp_replace(w[0], r"\.+$", "").isin(TITLES)
        return F.when((F.size(w) == 1) & (titled | w[0].isin(NOT_NAMES)), None).otherwise(F.array_join(w, " "))

    # A name has three words at most, so two steps drop all that can be dropped.
    return let(let(let(F.split(F.trim(raw), r"\s+"), dropped), dropped), kept)


def _end(before: Column) -> Column:
    return F.regexp_replace(before, r"[\p{Z}\t-\r\x1c-\x1f]+\z", "")


def tag_name(before: Column, after: Column) -> Column:
    """The name of a speech tag next to a quotation; the first of the four patterns that matches decides, even for null."""

    def first(trimmed: Column) -> Column:
        out = F.lit(None).cast("string")
        for text, pattern, group in reversed(
            [(after, AFTER_VERB_NAME, 2), (after, AFTER_NAME_VERB, 1), (trimmed, BEFORE_NAME_VERB, 1), (trimmed, BEFORE_VERB_NAME, 2)]
        ):
            out = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)).otherwise(out)
        return out

    return let(let(_end(before), first), lambda name: F.when(name.isNotNull(), clean(name)))


def tag_pronoun(before: Column, after: Column) -> Column:
    """``he`` or ``she`` of a speech tag next to a quotation."""
    return let(
        _end(before),
        lambda trimmed: F.when(after.rlike(AFTER_PRONOUN), F.lower(F.regexp_extract(after, AFTER_PRONOUN, 1))).when(
            trimmed.rlike(BEFORE_PRONOUN), F.lower(F.regexp_extract(trimmed, BEFORE_PRONOUN, 1))
        ),
    )


def names_in(sentence: Column) -> Column:
    """All names of a sentence in order, repeated ones too, but none behind a word that announces someone spoken to."""

    def found(parts: Column) -> Column:
        def name(i: Column) -> Column:
            ahead = F.translate(F.element_at(parts, i), _RIGHT, "")
            last = F.regexp_replace(F.lower(F.regexp_extract(ahead, r"(\S*)\s*$", 1)), r"^[,.;:]+|[,.;:]+$", "")
            return F.when(~last.isin(SPOKEN_TO), clean(F.split(F.element_at(parts, i + 1), _RIGHT)[0]))

        many = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(many, name), lambda n: n.isNotNull())

    marked = F.split(F.regexp_replace(sentence, f"({NAME})", f"{_LEFT}$1{_RIGHT}"), _LEFT)
    return F.coalesce(let(marked, found), F.array().cast("array<string>"))


def without_quoted(c: Column) -> Column:
    """The text with quotations replaced by a space; an unclosed one runs to the end."""
    return F.regexp_replace(c, r'"[^"]*(?:"|\z)|“[^”]*(?:”|\z)|«[^»]*(?:»|\z)', " ")


def title_gender(name: Column) -> Column:
    head = F.lower(F.regexp_replace(F.split(F.trim(name), " ")[0], r"\.+$", ""))
    return F.when(head.isin(FEMALE_TITLES), "FEMALE").when(head.isin(MALE_TITLES), "MALE")


def pronoun_gender(sentence: Column) -> Column:
    """The gender of a sentence's pronouns; null if there are none or both."""
    f, m = sentence.rlike(FEMALE), sentence.rlike(MALE)
    return F.when(f & ~m, "FEMALE").when(m & ~f, "MALE")


def nearest_name(sentence: Column, names: Column, gender: Column) -> Column:
    """The last of ``names`` that begins before the sentence's first pronoun of ``gender``."""
    ahead = F.when(gender == "FEMALE", F.regexp_replace(sentence, rf"{FEMALE}[\s\S]*", "")).when(gender == "MALE", F.regexp_replace(sentence, rf"{MALE}[\s\S]*", ""))

    def nearest(mark: Column) -> Column:
        rest = F.transform(names, lambda n: F.struct(F.length(F.regexp_replace(mark, F.concat(F.lit(r"(?s)^.*\Q"), n, F.lit(r"\E")), F.lit(""))).alias("rest"), n.alias("name")))
        return F.array_min(F.filter(rest, lambda r: F.contains(mark, r["name"])))["name"]

    return let(ahead, nearest)
