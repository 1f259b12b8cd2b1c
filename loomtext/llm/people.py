"""What a typed name says: given name, family name, generation, kind."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import regex

# Words that are no part of a person's own name.
TITLES = {
    "mr": "m", "mister": "m", "sir": "m", "lord": "m", "herr": "m", "hr": "m", "monsieur": "m", "don": "m", "senor": "m", "uncle": "m", "father": "m", "gospodin": "m", "g-n": "m",
    "mrs": "f", "ms": "f", "miss": "f", "lady": "f", "madam": "f", "madame": "f", "mme": "f", "mlle": "f", "frau": "f", "fraulein": "f", "dona": "f", "dna": "f", "sra": "f", "srta": "f",
    "aunt": "f", "mother": "f", "sister": "f", "g-zha": "f", "dr": "", "doctor": "", "prof": "", "professor": "", "captain": "", "capt": "", "cpt": "", "col": "", "colonel": "",
    "major": "", "maj": "", "general": "", "gen": "", "lieutenant": "", "lt": "", "sergeant": "", "sgt": "", "rev": "", "reverend": "", "hon": "", "judge": "", "d-r": "", "brother": "m",
}
GENERATION = {"sr": "sr", "senior": "sr", "snr": "sr", "jr": "jr", "junior": "jr", "jnr": "jr", "ii": "jr", "iii": "iii", "pere": "sr", "fils": "jr", "st": "sr", "ml": "jr", "starshii": "sr", "mladshii": "jr"}
PRONOUNS = {"he": "m", "him": "m", "his": "m", "she": "f", "her": "f", "hers": "f", "they": "", "them": "", "it": "", "i": "", "me": "", "you": "", "we": "", "us": "", "who": "",
            "er": "m", "sie": "f", "es": "", "il": "m", "elle": "f", "ils": "", "elles": "", "el": "m", "ella": "f", "ellos": "", "on": "", "ona": "f", "oni": "", "narrator": "", "unknown": ""}
AGES = set("old young little dear poor".split())
ARTICLES = set("the a an le la les un une der die das ein eine el los las un una".split())
FIRM = {"co": "company", "company": "company", "cie": "company", "compagnie": "company", "compania": "company", "bros": "brothers", "brothers": "brothers", "gebruder": "brothers",
        "gebr": "brothers", "freres": "brothers", "hermanos": "brothers", "hnos": "brothers", "wks": "works", "works": "works", "ltd": "limited", "limited": "limited", "inc": "incorporated",
        "incorporated": "incorporated", "corp": "corporation", "corporation": "corporation", "sons": "sons", "sohne": "sons", "fils": "sons", "hijos": "sons", "house": "house", "society": "society",
        "gmbh": "limited", "ag": "limited", "llc": "limited", "mill": "mill", "mills": "mill", "bank": "bank", "press": "press", "assoc": "association", "association": "association", "line": "line",
        "lines": "line", "yard": "yard", "yards": "yard", "guild": "guild", "partners": "partners", "trust": "trust", "mfg": "manufacturing", "manufacturing": "manufacturing"}
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", "a b v g d e yo zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e yu ya i yi ye g".split(" ")))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split()))
_KEPT_CAMEL = ("Mac", "Mc", "De", "Le", "La", "Du", "Van", "Von", "Di", "Fitz", "O’", "O'")
_PARTICLES = set("von van de der den del della di da dos du la le ben bin ibn al el af av zu zum ter ten".split())

@dataclass(frozen=True)
class Person:
    """A person's name; ``given`` may be one letter, or missing: a lone word, of which nothing says whether it is a given or a family name, is in ``family``."""

    given: str
    family: str
    generation: str = ""


@dataclass(frozen=True)
class Firm:
    """An organisation's name: its own words in order, and the sort of firm."""

    own: tuple[str, ...]
    sort: tuple[str, ...] = ()


def _plain(text: str) -> str:
    """Lower-case Latin letters without accents, from any of Latin, Cyrillic or Greek."""
    out = []
    for c in unicodedata.normalize("NFC", text.casefold()):
        base = unicodedata.normalize("NFD", c)
        if c in CYRILLIC:
            out.append(CYRILLIC[c])
        elif base[0] in GREEK:
            out.append(GREEK[base[0]])
        else:
            out.append("".join(x for x in base if not unicodedata.combining(x)))
    return "".join(out).replace("ß", "ss").replace("ø", "o").replace("ł", "l")


@lru_cache(maxsize=100_000)
def parse(name: str | None) -> tuple[Person | Firm | None, str]:
    """A typed name and the gender (``m``, ``f`` or nothing) that a title or a pronoun gives away; no name for roles, families and pronouns."""
    if not name:
        return None, ""
    text = regex.sub(r"\s+", " ", regex.sub(r"[\p{Default_Ignorable_Code_Point}]", "", unicodedata.normalize("NFKC", name))).strip()
    if " " not in text and "." not in text:
        parts = regex.split(r"(?<=\p{Ll})(?=\p{Lu})", text)
        glued: list[str] = []
        for p in parts:
            if glued and glued[-1].endswith(_KEPT_CAMEL) and len(glued[-1]) <= 4:
                glued[-1] += p
            else:
                glued.append(p)
        text = " ".join(glued)
    plain = _plain(text)
    words = regex.findall(r"[\p{L}\p{M}\p{N}’'-]+", plain)
    if len(words) > 2 and words[0] in AGES and words[1] in TITLES:
        plain, words = plain.split(words[0], 1)[1].strip(), words[1:]
    if not words or not regex.search(r"\p{L}", plain):
        return None, ""
    if len(words) == 1 and words[0] in PRONOUNS:
        return None, PRONOUNS[words[0]]
    joined = regex.search(r"[&+]|(?<=\p{L}) (?:and|und|et|y|i) (?=\p{L})", plain) is not None
    sorts = [FIRM[w] for w in words if w in FIRM and not (w == "fils" and not joined)]
    if joined or (sorts and len(words) > 1 and not (words[0] in TITLES)):
        flat = regex.findall(r"[\p{L}\p{M}\p{N}]+", regex.sub(r"[’']", "", plain))
        own = [w for w in flat if w not in FIRM and w not in ARTICLES and w not in ("and", "und", "et", "y", "i", "of")]
        if "," in plain and not regex.search(r"[&+]|\band\b", plain.split(",", 1)[0]):
            # Turned round: the sort of firm before the comma, the name behind it.
            head, tail = plain.split(",", 1)
            front = [w for w in regex.findall(r"[\p{L}\p{M}\p{N}]+", head) if w not in ARTICLES]
            if any(w in FIRM for w in front):
                lead = [w for w in front if w not in FIRM]
                own = [w for w in own if w not in lead] + lead
        return (Firm(tuple(own), tuple(sorted(set(sorts)))) if own else None), ""
    if words[0] in ARTICLES:
        return None, ""
    generation, gender = "", ""
    pieces = [regex.findall(r"[\p{L}\p{M}\p{N}’'-]+\.?", p) for p in plain.split(",")]
    kept: list[list[str]] = []
    for tokens in pieces:
        out = []
        for k, t in enumerate(tokens):
            bare = t.rstrip(".")
            first = not out and not kept
            if first and bare in TITLES and (len(tokens) > 1 or len(pieces) > 1):
                gender = gender or TITLES[bare]
            elif first and bare == "sr" and k == 0 and len(tokens) > 1:
                gender = gender or "m"
            elif first and bare in ("m", "fr") and t.endswith(".") and len(tokens) == 2 and len(pieces) == 1:
                # A lone initial before a family name; it may as well be a title.
                out.append(t)
            elif bare in GENERATION and (out or kept) and not first and k == len(tokens) - 1:
                generation = GENERATION[bare]
            elif bare in TITLES and kept and not out:
                gender = gender or TITLES[bare]
            else:
                out.append(t)
        if out:
            kept.append(out)
    if not kept:
        return None, gender
    if len(kept) > 1:
        family, given = kept[0], kept[1]
        order = [*given, *family]
    else:
        order = kept[0]
    initials = [t for t in order if len(t.rstrip(".")) == 1]
    full = [t for t in order if len(t.rstrip(".")) > 1]
    if not full:
        return None, gender
    if len(full) == 1:
        one = full[0].rstrip(".")
        if initials:
            return Person(initials[0].rstrip("."), one, generation), gender
        return Person("", one, generation), gender
    given = full[0].rstrip(".")
    rest = [t.rstrip(".") for t in full[1:]]
    cut = next((i for i, t in enumerate(rest) if t in _PARTICLES), len(rest) - 1)
    family = " ".join(rest[cut:])
    if len(order[0].rstrip(".")) == 1 and len(kept) == 1:
        given = order[0].rstrip(".")
        family = full[-1].rstrip(".")
        # "J. Thomas Hardy": the initial and the second given name; the family name is the last word.
    return Person(given, family, generation), gender
