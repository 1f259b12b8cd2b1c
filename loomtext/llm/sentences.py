"""Sentence boundaries across languages and scripts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.canonical import canonical
from loomtext.session import spread

# Abbreviations whose period does not end a sentence before a name, by language; "" holds in every language.
BEFORE_NAME = {
    "": "mr mrs ms dr prof st mme mlle mgr",
    "en": "messrs capt cpt col gen lt sgt maj cmdr adm rev hon pres gov sen rep fr mt ft sr",
    "de": "hr hrn frl fr sankt",
    "fr": "m mm ste",
    "es": "sr sra srta sres d dña dra ud uds",
    "ru": "г гг ул св проф акад им тов гр пр-т пл пер наб",
    "el": "κ κα κος κυρ δρ αγ καθ",
    "hi": "डॉ पं श्री श्रीमती प्रो कु",
    "ar": "د أ م",
}

# Abbreviations that also end names of streets, firms and people: a word that begins a sentence ends theirs.
CLOSING = "st ft mt rd ave ln blvd co ltd inc corp jr bros".split()

# Abbreviations whose period does not end a sentence before a number.
BEFORE_NUMBER = {
    "": "no nos vol vols p pp pg fig figs ch chap cap art t n op",
    "en": "sec par",
    "de": "nr nrn bd bde s tel",
    "fr": "s",
    "es": "núm núms pág págs",
    "ru": "стр с д кв гл рис корп № п т",
    "el": "αρ σελ αριθ τ",
    "hi": "नं",
    "ar": "ص",
}

# Number words that may follow these in place of a figure.
NUMBERS = "one two three four five six seven eight nine ten eleven twelve i ii iii iv v vi vii viii ix x xi xii".split()

# Abbreviations that never end a sentence, written without their inner spaces.
NEVER = {
    "": "i.e e.g cf vs c.-à-d z.b",
    "en": "viz",
    "de": "d.h u.a bzw ca vgl ggf evtl sog",
    "fr": "p.ex",
    "es": "p.ej",
    "ru": "т.е т.к напр",
    "el": "π.χ δηλ",
}

# Words that begin a sentence more likely than they follow an initial or an acronym.
STARTERS = {
    "en": "the a an he she it they we i you this that these those there here his her its their our my your no not nobody nothing "
    "but and so if when while then what who why how where did do does is was were are had has in on at for from after before",
    "de": "der die das er sie es wir ich ein eine",
    "fr": "le la les il elle ils elles un une",
    "es": "el los las",
    "ru": "он она они мы я это в на но и",
    "el": "ο η το οι ένας μια",
}

# Words before which a number with a period is an ordinal.
BEFORE_ORDINAL = {"de": "am dem der den des die das im vom zum zur beim seit ab bis jeder jedem jeden jede"}

# Verbs with which a sentence goes on after a quotation.
SAYING = {
    "cased": "said says asked replied cried answered whispered shouted called muttered murmured added exclaimed sagte fragte rief antwortete flüsterte dit demanda cria répondit dijo preguntó gritó respondió сказал сказала спросил спросила ответил ответила крикнул крикнула είπε ρώτησε φώναξε απάντησε".split(),
    "Hani": "说 說 问 問 道 喊 叫 答 喝 嚷 曰".split(),
    "Deva": "पूछा कहा बोला बोली बोले चिल्लाया चिल्लाई".split(),
    "Arab": "قال قالت سأل سألت صاح صاحت أجاب أجابت هتف همس همست".split(),
    "Thai": "ถาม พูด กล่าว ตอบ ตะโกน บอก".split(),
}


@lru_cache(maxsize=100_000)
def _fold(word: str) -> str:
    return canonical(word, fold_case=True)


@dataclass(frozen=True)
class Suppressions:
    """What keeps a period or a closed quotation from ending a sentence in one language."""

    name: frozenset[str]
    closing: frozenset[str]
    number: frozenset[str]
    counts: frozenset[str]
    never: frozenset[str]
    start: frozenset[str]
    ordinal: frozenset[str]
    say: frozenset[str]


@lru_cache(maxsize=64)
def suppressions(lang: str | None) -> Suppressions:
    """Those of a language (``de``, ``de-AT``); of all languages together if it is null or has no list."""
    code = (lang or "").replace("_", "-").split("-")[0].lower()
    wanted = {"", code} if code in BEFORE_NAME and code else set(BEFORE_NAME)

    def of(lists: dict[str, str]) -> frozenset[str]:
        return frozenset(_fold(w) for k, words in lists.items() if k in wanted for w in words.split())

    def flat(words: list[str]) -> frozenset[str]:
        return frozenset(map(_fold, words))

    return Suppressions(
        of(BEFORE_NAME), flat(CLOSING), of(BEFORE_NUMBER), flat(NUMBERS), of(NEVER), of(STARTERS), of(BEFORE_ORDINAL), flat(SAYING["cased"])
    )


_HIDDEN = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cc}--\p{White_Space}]", regex.V1)
_BLANK_LINE = regex.compile(r"(?:\r\n|[\n\r\x85 ])[^\S\n\r\x85  ]*(?:\r\n|[\n\r\x85 ])\s*| \s*")
_TERMINATORS = regex.compile(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…⋯;\uff1b\u037e]+")
_GREEK_ASKS = ";\uff1b\u037e"
_NO_GREEK = dict.fromkeys(map(ord, _GREEK_ASKS))
_DOTS = frozenset(".…⋯")
_ANY_LETTER = regex.compile(r"\p{L}")
_ATERM = regex.compile(r"\p{Sentence_Break=ATerm}")
_OPENERS = "“„«‘‚‹「『《〈(（[【—–-¿¡\"'*_»"
_QUOTES = "”’»›」』\"'“‘«"
_SPACE = regex.compile(r"\s*")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Hangul}]")
#: Speech that a dash opens has no closing mark.
_DASHED = regex.compile(r"\s*[—–―]")
_LETTER = regex.compile(r"[\p{L}\p{N}]")
_THAI = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_SPACE_RUN = regex.compile(r"[^\S\n\r]+")
_THAI_SPACE = regex.compile(rf"(?<={_THAI.pattern}\p{{M}}*)[^\S\n\r]+(?={_THAI.pattern})")
#: Read backwards from a period: the abbreviation with its inner periods, a short number, and the words before.
_TAIL = regex.compile(r"(?r)(?<![\p{L}\p{N}])(?:[\p{L}\p{M}\p{N}º№’'-]+\.\s?)*[\p{L}\p{M}№’'-]+")
_COUNT = regex.compile(r"(?r)(?:(?<=[\s(])|\A)\p{Nd}{1,3}")
_LAST_WORD = regex.compile(r"(?r)[\p{L}\p{M}’'-]+")
_WORD = regex.compile(r"[\p{L}\p{M}’'-]+")
_UPPER, _LOWER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{Ll}")
_LATIN_OR_GREEK = regex.compile(r"(?r)[\p{Latin}\p{Greek}]")
_IS_GREEK = regex.compile(r"\p{Greek}")
_FULL_STOPS = regex.compile(r"[。！？｡]")
_PLAIN_STOPS = regex.compile(r"[．!?]")
_UNSPACED = regex.compile(r"[।॥؟։።]")
_JAPANESE = regex.compile(r"[\p{Hiragana}\p{Katakana}]|\p{Han}[\s\S]*\p{Hiragana}")
_SCRIPTS = {name: regex.compile(rf"\p{{Script={name}}}") for name in ("Hani", "Deva", "Arab", "Thai")}
_ASKED = regex.compile(r"[!?]")


#: A clause that leads to a quotation of its own, which begins like a sentence.
_NEW_SPEECH = regex.compile(r"[^.!?。！？]*(?:\.[^.!?。！？“„«\"]*)?[:,]\s*[“„«\"‘]+\p{Lu}")


def _closers(text: str, at: int, paragraph: int) -> int:
    """The place after the closing marks that follow a terminator at once, or for guillemets after one space."""
    i = at
    while i < len(text):
        c = text[i]
        if c in "”’)）]】」』》〉›}":
            i += 1
        elif c == "»" or (c == "«" and 0 <= text.find("»", paragraph, i) < (text.find("«", paragraph, i) % (1 << 60))):
            i += 1
        elif c in "“‘\"'" and not _LETTER.match(text, i + 1):
            i += 1
        elif c.isspace() and c not in "\n\r" and text[i + 1 : i + 2] == "»" and i == at:
            i += 2
        else:
            break
    return i


def _abbreviated(text: str, start: int, dot: int, look: int, rules: Suppressions) -> bool:
    """Whether the single period at ``dot`` belongs to an abbreviation, an initial or an ordinal."""
    word = _WORD.match(text, look)
    following, digit = word.group() if word else "", text[look].isdigit()
    next_word = _fold(following)
    initial = len(following) == 1 and text[look + 1 : look + 2] == "."
    if not digit and (number := _COUNT.fullmatch(text, max(start, dot - 3), dot) or _COUNT.match(text, start, dot)):
        previous = _LAST_WORD.search(text, start, number.start())
        return previous is not None and _fold(previous.group()) in rules.ordinal
    tail = _TAIL.match(text, start, dot)
    if not tail:
        return False
    whole = _fold(tail.group()).replace(" ", "")
    token = whole.rsplit(".", 1)[-1]
    starter = not initial and next_word in rules.start
    if initial and f"{token}.{next_word}" in rules.never:
        return True
    if token in rules.never or whole in rules.never or any(whole.endswith("." + n) for n in rules.never):
        return True
    if digit or (token in rules.number and next_word in rules.counts):
        return token in rules.number
    if token == "sr" and token in rules.name:
        last = _LAST_WORD.search(text, start, tail.end())
        before = last and _LAST_WORD.search(text, start, last.start())
        return not (before and before.group()[:1].isupper() and len(before.group()) > 2)
    raw = tail.group().rsplit(".", 1)[-1].strip()
    if len(raw) == 1 and raw.isupper():
        return not starter
    if token in rules.name:
        return not (len(raw) == 1 and "." in whole) and not (starter and (len(raw) == 1 or token in rules.closing))
    return False


def _goes_on(text: str, begin: int, quote: int, at: int, breaks: list[int], paragraph: int, rules: Suppressions) -> bool:
    """Whether the words from ``at`` on belong to the sentence of the quotation that closed just before."""
    opened = max(text.rfind(o, paragraph, quote) for o in "“„«「『‘\"—")
    since = breaks[bisect_right(breaks, opened) - 1] if opened >= 0 else begin
    narrated = opened >= 0 and _LETTER.search(text, since, opened) is not None
    if narrated:
        return False
    end = _TERMINATORS.search(text, at)
    clause = text[at : end.start() if end else len(text)]
    first = clause[:1]
    if _UPPER.match(first):
        if _NEW_SPEECH.match(text, at):
            return False
        words = [w.group() for w in _WORD.finditer(clause)]
        return any(_fold(w) in rules.say for w in words[1:])
    if _JAPANESE.match(clause):
        return clause.startswith(("と", "って"))
    for script, letter in _SCRIPTS.items():
        if letter.match(first):
            return any(v in clause for v in SAYING[script])
    return False


def _greek(text: str, start: int, at: int) -> bool:
    """Whether the letter before a question mark of Greek form is Greek, past all that is neither Greek nor Latin."""
    last = _LATIN_OR_GREEK.search(text, start, at)
    return last is not None and _IS_GREEK.match(last.group()) is not None


def _paragraph(text: str, start: int, stop: int, thai: bool, rules: Suppressions) -> list[tuple[int, int]]:
    """The stretches of one paragraph between its sentence boundaries.

    The rules of the sentence-break property in their order, each mark with what follows it held against them; behind
    them the tailorings: quotations that are carried on, and the suppressions of the language.
    """
    breaks = [start]
    spaces = [m.end() for m in (_SPACE_RUN if thai else _THAI_SPACE).finditer(text, start, stop)] if thai or _THAI.search(text, start, stop) else []
    for m in _TERMINATORS.finditer(text, start, stop):
        marks, first, end = m.group(), m.start(), m.end()
        if any(c in _GREEK_ASKS for c in marks) and not _greek(text, start, first):
            marks = marks.translate(_NO_GREEK)
            if not marks:
                continue
        if marks != "." and set(marks) <= _DOTS and _WIDE.match(text[first - 1 : first]):
            continue
        # Close* Sp*
        close = _closers(text, end, start)
        ahead = _SPACE.match(text, close).end()
        if ahead >= stop:
            break
        spaced = ahead > close
        quoted = any(c in _QUOTES for c in text[end:close])
        after = text[ahead]
        # SB8a: a mark that carries on.
        if after in ",;:،、，；：" or (not spaced and after in "-–—/"):
            continue
        full = _FULL_STOPS.search(marks) is not None
        wide = full or _WIDE.match(after) is not None
        # SB6, SB7: decimals, addresses and acronyms have no space behind the mark; scripts without spaces have none anyway.
        if not spaced and not (wide or quoted or _UNSPACED.search(marks)):
            if not (_ASKED.search(marks) and after in "¿¡“«„「『—("):
                continue
        look = ahead
        while look < stop and (text[look] in _OPENERS or text[look].isspace()):
            look += 1
        if look >= stop:
            break
        period = _ATERM.search(marks) is not None or "…" in marks or "⋯" in marks
        # SB8: a period, or a mark in direct speech, before a small letter.
        if _LOWER.match(text, look) and (period or quoted or look > ahead or _DASHED.match(text, breaks[-1])):
            continue
        if _ATERM.fullmatch(marks) and not quoted:
            if _abbreviated(text, breaks[-1], first, look, rules):
                continue
            if not spaced and not _WIDE.match(after):
                continue
        if quoted and look == ahead and _goes_on(text, breaks[-1], end, ahead, breaks, start, rules):
            continue
        # SB11
        breaks.append(ahead)
    cuts = sorted({*breaks, *spaces, stop})
    return list(zip(cuts, cuts[1:]))


def sentence_spans(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """The sentences of a text as half-open ranges of characters.

    Marks and rules are those of the sentence-break property, for all scripts. A blank line ends a sentence,
    a lone line break does not, in scripts written without spaces between words a space does. A
    period of an abbreviation, initial, ordinal or number does not, by the lists of ``lang`` (of all languages
    if it is null or unknown). A mark inside a quotation ends a sentence unless the words after the quotation carry
    it on. What has no letter or digit is no sentence. Invisible characters count for nothing but
    their place.
    """
    if not text:
        return []
    rules = suppressions(lang)
    seen = None
    plain = text
    if not text.isprintable() and _HIDDEN.search(text):
        seen = [i for i, c in enumerate(text) if not _HIDDEN.match(c)]
        plain = "".join(text[i] for i in seen)
    thai = not plain.isascii() and _THAI.search(plain) is not None and 2 * len(_THAI.findall(plain)) > len(_ANY_LETTER.findall(plain))
    out = []
    edges = [0]
    if not plain.isprintable():
        for m in _BLANK_LINE.finditer(plain):
            edges += [m.start(), m.end()]
    edges.append(len(plain))
    for a, b in zip(edges[::2], edges[1::2]):
        for start, stop in _paragraph(plain, a, b, thai, rules):
            while start < stop and plain[start].isspace():
                start += 1
            while stop > start and plain[stop - 1].isspace():
                stop -= 1
            if start < stop and _LETTER.search(plain, start, stop):
                out.append((start, stop) if seen is None else (seen[start], seen[stop - 1] + 1))
    return out


def sentences(entries: DataFrame, key: str = "entry_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """``key``, ``sent_start``, ``sent_end`` of every sentence of every row; ``lang`` names the column of the row's language.

    Without a language the lists of all languages hold. Null, empty and wordless texts have no rows; repeated rows and
    keys give their sentences each time; whole texts are read whatever their length; an empty table gives an empty result;
    other columns are not read.
    """
    key_type = entries.schema[key].dataType.simpleString()
    span = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            memo: dict[tuple[str, str | None], list[tuple[int, int]]] = {}
            found = []
            for row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = memo.get(row)
                if spans is None:
                    spans = memo[row] = sentence_spans(*row)
                found.append(spans)
            ends = np.cumsum([0, *map(len, found)])
            flat = np.fromiter(chain.from_iterable(chain.from_iterable(found)), np.int32, 2 * int(ends[-1])).reshape(-1, 2)
            places = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)], names=["k", "s"])

    said = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    return (
        spread(entries.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), said.alias("l")).where("t IS NOT NULL"))
        .mapInArrow(run, f"k {key_type}, s array<struct<a: int, b: int>>")
        .select(F.col("k").alias(key), F.inline("s"))
        .withColumnsRenamed({"a": "sent_start", "b": "sent_end"})
    )
