"""The same text rules as SQL expressions, for the statements that queries are held against."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from loomtext.functions.names import (
    AFTER_NAME_VERB,
    AFTER_PRONOUN,
    AFTER_VERB_NAME,
    BEFORE_NAME_VERB,
    BEFORE_PRONOUN,
    BEFORE_VERB_NAME,
    FEMALE,
    FEMALE_TITLES,
    MALE,
    MALE_TITLES,
    NAME,
    NOT_NAMES,
    SPOKEN_TO,
    TITLES,
)
from loomtext.functions.text import ABBREVIATIONS, STRIPPED

WHITE = r"[\pZ\t-\r\x1c-\x1f\x{85}]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


PARAGRAPHS = f"""
para AS (
  SELECT * FROM (
    SELECT book_id, arg_min(chapter, entry_id) AS chapter, seq, {strip('arg_min(text, entry_id)')} AS text,
      length(regexp_extract(arg_min(text, entry_id), '^{WHITE}*')) AS lead
    FROM entries WHERE book_id IS NOT NULL AND seq IS NOT NULL AND text IS NOT NULL GROUP BY book_id, seq)
  WHERE text <> '')"""

_RUNS = text(r'("[^"]*(?:"|\z)|“[^”]*(?:”|\z)|«[^»]*(?:»|\z)|(?:[\p{L}\p{Nd}]"|[^"“«])+)')

SEGMENTS = (
    PARAGRAPHS
    + f""",
runs AS (
  SELECT book_id, chapter, seq, lead, text, CASE WHEN text[1] IN ('—', '―') THEN NULL ELSE regexp_extract_all(text, {_RUNS}, 1) END AS r,
    regexp_extract(text, '^([—―][^—―]*)', 1) AS speech FROM para),
dashed AS (
  SELECT book_id, chapter, seq, lead, 0 AS n, 'DIALOGUE' AS kind, speech AS raw, '' AS before, text[length(speech) + 1:] AS after FROM runs WHERE r IS NULL
  UNION ALL SELECT book_id, chapter, seq, lead, 1, 'NARRATION', text[length(speech) + 1:], speech, '' FROM runs WHERE r IS NULL),
quoted AS (
  SELECT book_id, chapter, seq, lead, i - 1 AS n, CASE WHEN r[i][1] IN ('"', '“', '«') THEN 'DIALOGUE' ELSE 'NARRATION' END AS kind, r[i] AS raw,
    array_to_string(r[1:i - 1], '') AS before, array_to_string(r[i + 1:], '') AS after
  FROM (SELECT *, unnest(generate_series(1, len(r))) AS i FROM runs WHERE r IS NOT NULL)),
seg AS (
  SELECT * FROM (SELECT book_id, chapter, seq, lead, n::INT AS n, kind, {strip('raw')} AS run, before, after,
      length(before) + length(regexp_extract(raw, '^{WHITE}*')) AS run_start
    FROM (SELECT * FROM dashed UNION ALL SELECT * FROM quoted)) WHERE run <> '')"""
)


def clean(raw: str) -> str:
    drop = "CASE WHEN len({w}) > 1 AND {w}[-1] IN " + listed(NOT_NAMES) + " THEN {w}[:-2] ELSE {w} END"
    words = f"string_split_regex(trim({raw}), '\\s+')"
    once = "(" + drop.format(w=f"({words})") + ")"
    # Bound by a one-element list, so that each step is written once.
    return (
        f"list_transform(list_transform([{once}], lambda w: {drop.format(w='w')}), lambda w: CASE WHEN len(w) = 1 AND (w[1] IN {listed(NOT_NAMES)} "
        f"OR regexp_replace(w[1], '\\.+$', '') IN {listed(TITLES)}) THEN NULL ELSE array_to_string(w, ' ') END)[1]"
    )


def tag_name(before: str, after: str) -> str:
    end = f"regexp_replace({before}, '[\\pZ\\t-\\r\\x1c-\\x1f]+$', '')"
    out = "CASE"
    for subject, pattern, group in ((after, AFTER_VERB_NAME, 2), (after, AFTER_NAME_VERB, 1), (end, BEFORE_NAME_VERB, 1), (end, BEFORE_VERB_NAME, 2)):
        out += f" WHEN regexp_matches({subject}, {text(pattern)}) THEN {clean(f'regexp_extract({subject}, {text(pattern)}, {group})')}"
    return out + " END"


def tag_pronoun(before: str, after: str) -> str:
    end = f"regexp_replace({before}, '[\\pZ\\t-\\r\\x1c-\\x1f]+$', '')"
    return (
        f"CASE WHEN regexp_matches({after}, {text(AFTER_PRONOUN)}) THEN lower(regexp_extract({after}, {text(AFTER_PRONOUN)}, 1)) "
        f"WHEN regexp_matches({end}, {text(BEFORE_PRONOUN)}) THEN lower(regexp_extract({end}, {text(BEFORE_PRONOUN)}, 1)) END"
    )


def names_in(sentence: str) -> str:
    parts = f"string_split(regexp_replace({sentence}, {text(f'({NAME})')}, chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    last = "regexp_replace(lower(regexp_extract(replace(p[i], chr(2), ''), '(\\S*)\\s*$', 1)), '^[,.;:]+|[,.;:]+$', '', 'g')"
    name = f"CASE WHEN {last} NOT IN {listed(SPOKEN_TO)} THEN {clean('string_split(p[i + 1], chr(2))[1]')} END"
    return f"list_filter(list_transform([{parts}], lambda p: list_transform(generate_series(1, len(p) - 1), lambda i: {name}))[1], lambda x: x IS NOT NULL)"


def without_quoted(x: str) -> str:
    pattern = text(r'"[^"]*(?:"|\z)|“[^”]*(?:”|\z)|«[^»]*(?:»|\z)')
    return f"regexp_replace({x}, {pattern}, ' ', 'g')"


def title_gender(name: str) -> str:
    head = f"lower(regexp_replace(string_split(trim({name}), ' ')[1], '\\.+$', ''))"
    return f"CASE WHEN {head} IN {listed(FEMALE_TITLES)} THEN 'FEMALE' WHEN {head} IN {listed(MALE_TITLES)} THEN 'MALE' END"


def pronoun_gender(s: str) -> str:
    f, m = f"regexp_matches({s}, {text(FEMALE)})", f"regexp_matches({s}, {text(MALE)})"
    return f"CASE WHEN {f} AND NOT {m} THEN 'FEMALE' WHEN {m} AND NOT {f} THEN 'MALE' END"


def plain_sentences(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(2), 'g'), chr(2)), lambda s: NOT regexp_full_match(s, '{WHITE}*'))"


def index_sentences(x: str, known: list[str] = ABBREVIATIONS) -> str:
    abbreviations = "|".join(a.replace(".", "[.]") for a in known)
    # No look-ahead here: the abbreviation's period is held in two passes, as one match may end where the next begins.
    held = x
    for _ in range(2):
        held = f"regexp_replace({held}, '(?i)((?:^|{WHITE})(?:{abbreviations}))[.]([ \\n\\r\\t]|$)', '\\1' || chr(1) || '\\2', 'g')"
    cut = f"regexp_replace(regexp_replace({held}, '([.!?])([ \\n\\r\\t])', '\\1' || chr(2) || '\\2', 'g'), '([.!?])([ \\n\\r\\t])', '\\1' || chr(2) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(2)), lambda s: {strip('replace(s, chr(1), chr(46))')}), lambda s: s <> '')"


def normal_form(x: str) -> str:
    bare = f"translate({x}, {text(STRIPPED)}, '')"
    lower = f"lower(translate(regexp_replace({bare}, '(?:{WHITE}|[-—])+', ' ', 'g'), 'Σİ', 'σi'))"
    return f"trim(regexp_replace(regexp_replace({lower}, '[^\\pL\\p{{Nd}}'' ]', '', 'g'), ' +', ' ', 'g'))"


@lru_cache(maxsize=1)
def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters of the Basic Multilingual Plane whose compatibility form is one other character, these, and Latin, Thai and Lao letters with a longer form."""
    one, to, more = [], [], []
    for c in map(chr, range(0xA0, 0xFFFE)):
        if unicodedata.decomposition(c).startswith("<"):
            form = unicodedata.normalize("NFKC", c)
            if len(form) == 1:
                one.append(c)
                to.append(form)
            elif unicodedata.name(c, "").startswith("LATIN SMALL LIGATURE") or "\u0e00" <= c < "\u0f00":
                more.append((c, form))
    return "".join(one), "".join(to), more


def full_form(x: str) -> str:
    """The normal form with the compatibility step: characters that stand for others, then composed."""
    one, to, more = _compatible()
    out = f"translate({x}, {text(one)}, {text(to)})"
    for c, form in more:
        out = f"replace({out}, {text(c)}, {text(form)})"
    return normal_form(f"nfc_normalize({out})")


def fnv64(x: str) -> str:
    """Over the code points of the Basic Multilingual Plane and the surrogate pairs of the rest."""
    units = f"""flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN c = '' THEN [] WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT]
      ELSE [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024]::BIGINT[] END))"""
    step = """lambda s, u: list_transform([xor(s[2], u[2])], lambda v: [(s[1] * 435 + ((v * 435) >> 32) + (v << 8)) & 4294967295, (v * 435) & 4294967295])[1]"""
    pairs = f"list_prepend([3421674724, 2216829733]::BIGINT[], list_transform({units}, lambda u: [0, u]::BIGINT[]))"
    signed = "CASE WHEN h[1] >= 2147483648 THEN (h[1] - 4294967296) * 4294967296 + h[2] ELSE h[1] * 4294967296 + h[2] END"
    return f"list_transform([list_reduce({pairs}, {step})], lambda h: {signed})[1]"
