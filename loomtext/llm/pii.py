"""Personal information inside free text: spans proposed by patterns, confirmed by checks and by the words around."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.canonical import canonical
from loomtext.session import spread

#: A proposed span becomes an item at this score.
ENOUGH = 0.5

# Words that announce an item, per type.
CUES = {
    "phone": "tel|tél|tél.|tfno|teléfono|téléphone|telefon|phone|mobile|cell|fax|call|ring|rufen sie|appelez|llame|móvil|handy|звоните|телефон|тел|τηλ|τηλέφωνο|στο|phone|電話|电话|फ़ोन|फोन|هاتف|الهاتف|โทร|เบอร์|or on|или|ou|oder|reach",
    "identity": "passport|identity|id|i.d.|ssn|nino|insurance|tax|tin|steuer|ausweis|ausweisnummer|personalausweis|sécurité|passeport|identité|carte|dni|nie|nif|pasaporte|паспорт|паспорта|снилс|инн|διαβατηρίου|ταυτότητας|ταυτότητα|αφμ|αδτ|证件|号码|号碼|番号|護照|护照|身份证|身分|旅券|パスポート|マイナンバー|पासपोर्ट|पहचान|आधार|جواز|هوية|الهوية|บัตร|หนังสือเดินทาง|ประชาชน",
    "other": "order|order no|tracking|parcel|invoice|ticket|shelf|item no|ref|reference|isbn|bestellung|rechnung|sendung|commande|facture|colis|pedido|factura|заказ|счёт|παραγγελία",
}

# What stands before a full name that someone gives as a person's own or as a contact.
NAME_BEFORE = r"""
reported by|submitted by|sent by|written by|signed|yours|yours truly|yours sincerely|sincerely|regards|best regards|kind regards|best wishes|cheers|thanks|
contact|attn|attention|my name is|name is|i am called|this is|our neighbour|our neighbor|my neighbour|my neighbor|ask for|on behalf of|care of|c/o|
gemeldet von|mein name ist|ich heiße|mit freundlichem gruß|mit freundlichen grüßen|viele grüße|gruß|unser nachbar|unsere nachbarin|kontakt|
signalé par|je m’appelle|je m'appelle|mon nom est|cordialement|bien à vous|salutations|notre voisin|notre voisine|demandez|
aviso de|me llamo|mi nombre es|atentamente|un saludo|saludos|cordialmente|nuestro vecino|nuestra vecina|pregunte por|contacto|
меня зовут|моё имя|мое имя|с уважением|сообщил|сообщила|сообщает|контакт|наш сосед|наша соседка|спросите|
με λένε|ονομάζομαι|το όνομά μου είναι|με εκτίμηση|αναφορά από|φιλικά|ο γείτονάς μας|
我叫|我是|我的名字是|姓名|联系人|此致|报告人|私の名前は|私は|名前は|氏名|連絡先は|報告者|
मेरा नाम|नाम|सूचना|भवदीय|اسمي|الاسم|أنا|مع التحية|جارنا|ผมชื่อ|ฉันชื่อ|ดิฉันชื่อ|ชื่อ|แจ้งโดย
""".replace("\n", "")

# Titles that may stand before a name and are no part of it.
TITLES = r"(?:mr|mrs|ms|miss|dr|prof|sir|lady|herr|hr|frau|fr|mme|mlle|m|monsieur|madame|sr|sra|srta|dña|don|doña|г-н|г-жа|д-р|κ|κα)\.?\s+"

_PART = r"\p{Lu}(?:[\p{L}\p{M}]|[’'](?=\p{Lu}))+(?:[-‐‑’'][\p{L}\p{M}]+)*"
_INITIAL = r"\p{Lu}\."
_PARTICLE = r"(?:(?i:von|van|vom|de|der|den|del|della|di|da|dos|du|des|la|le|las|los|ben|bin|ibn|al|el|af|av|zu|zum|ter|ten|mac|abu|y))"
_S = r"(?:[^\S\n]|\n(?!\s*\n))+"
_FORWARD = rf"(?:{_PART}|{_INITIAL})(?:{_S}{_INITIAL}){{0,3}}(?:{_S}{_PARTICLE}(?![\p{{L}}.])){{0,3}}{_S}{_PART}"
_BACKWARD = rf"(?:{_PARTICLE}{_S}){{0,3}}{_PART},{_S}(?:{_PART}|{_INITIAL})(?:{_S}{_INITIAL}){{0,3}}(?:{_S}{_PARTICLE}(?![\p{{L}}.])){{0,3}}(?![\p{{L}}])"
_NAME = rf"(?P<name>{_FORWARD}|{_BACKWARD})"

#: A bracketed word for the sign of mail addresses.
_BRACKETED_AT = regex.compile(r"[\[({]\s*(?i:at|ät|arroba|@)")
_DIGIT = regex.compile(r"\d")

_EDGE = r"(?<![\p{Latin}\p{N}_])"
_LOCAL = rf"{_EDGE}[\p{{Latin}}\p{{N}}](?:[\p{{Latin}}\p{{N}}._%+'’-]*[\p{{Latin}}\p{{N}}_+-])?"
_LABEL = r"[\p{Latin}\p{N}](?:[\p{Latin}\p{N}-]*[\p{Latin}\p{N}])?"
_DOT = r"(?:\.|[^\S\n]*[\[({]\s*(?i:dot|punkt|point|punto|точка)\s*[\])}][^\S\n]*|[^\S\n]+(?i:dot|punkt|punto)[^\S\n]+)"
_AT_MARK = r"(?:@|＠|[^\S\n]*[\[({]\s*(?i:at|ät|arroba|@)\s*[\])}][^\S\n]*)"
#: The sign of an address of mail, written or spoken; what stands before it, read backwards; and the domain behind it.
_AT = regex.compile(_AT_MARK)
_SAID_AT = regex.compile(r"[^\S\n]+(?i:at)[^\S\n]+")
_USER = regex.compile(rf"(?r){_LOCAL}")
_DOMAIN = regex.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[\p{{Latin}}]{{2,}}(?![\p{{Latin}}\p{{N}}_@])")
_SAID_DOMAIN = regex.compile(rf"{_LABEL}(?:[^\S\n]+(?i:dot)[^\S\n]+{_LABEL})*[^\S\n]+(?i:dot)[^\S\n]+[\p{{Latin}}]{{2,}}(?![\p{{Latin}}\p{{N}}_@])")

_DIGITS = regex.compile(
    r"(?<![\p{Latin}\d#@])(?<!\d[.,:/-])(?<!\()(?:\+ ?\d|\(\+?\d{1,4}\)|\d)(?:[ .\-/ –]?\(\d{1,4}\)|[ .\-/ –]?\d)+(?![\d\p{Latin}])(?![.,:/-]\d)"
)
_PHONE_SHAPES = regex.compile(
    r"\+\d[\d ().\-/ –]{6,}|00\d{2}[\s/.-][\d\s/.()-]{6,}|\(0\d{0,4}\)[\d .\-/]{6,}|0\d{1,5}(?:[ .\-/]\d{2,8})+"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([ .-])\d{3}\1\d{4}|0\d{8,11}"
)
_DATE = regex.compile(r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$|\d{1,2}:\d{2}")

_SPAIN = "TRWAGMYFPDXBNJZSQVHLCKE"


def _mod_97(number: str) -> bool:
    return 97 - int(number[:13]) % 97 == int(number[13:])


def _luhn(number: str) -> bool:
    odd = number[::-1]
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(odd)) % 10 == 0


def _seven_three_one(number: str) -> bool:
    return sum(int(c, 36) * (7, 3, 1)[i % 3] for i, c in enumerate(number[:-1])) % 10 == int(number[-1], 36)


def _mod_11_10(number: str) -> bool:
    product = 10
    for c in number[:10]:
        product = ((int(c) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(number[10])


def _control_letter(number: str) -> bool:
    digits = number[:-1].translate(str.maketrans("XYZ", "012"))
    return _SPAIN[int(digits) % 23] == number[-1]


def _social_security(number: str) -> bool:
    return number[:3] not in ("000", "666") and number[0] != "9" and number[3:5] != "00" and number[5:] != "0000"


def _insurance_prefix(number: str) -> bool:
    return not set("DFIQUV") & set(number[:2]) and number[1] != "O" and number[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")


def _mod_101(number: str) -> bool:
    return sum(int(c) * (9 - i) for i, c in enumerate(number[:9])) % 101 % 100 == int(number[9:])


def _iban(number: str) -> bool:
    turned = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


#: Shapes of identity numbers: pattern, check of the bare number, score of the shape alone, what the check adds if it holds and takes if not.
_IDENTITIES = [
    (regex.compile(r"\d{3}-\d{2}-\d{4}"), _social_security, 0.45, 0.1, 0.2),
    (regex.compile(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"), _insurance_prefix, 0.45, 0.2, 0.2),
    (regex.compile(r"\d{8}[- ]?[A-Z]"), _control_letter, 0.4, 0.4, 0.1),
    (regex.compile(r"[XYZ][- ]?\d{7}[- ]?[A-Z]"), _control_letter, 0.4, 0.4, 0.1),
    (regex.compile(r"[12] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3} ?\d{2}"), _mod_97, 0.4, 0.4, 0.1),
    (regex.compile(r"\d{2} \d{3} \d{3} \d{3}"), _mod_11_10, 0.4, 0.4, 0.1),
    (regex.compile(r"\d{3}-\d{3}-\d{3} \d{2}"), _mod_101, 0.4, 0.4, 0.1),
    (regex.compile(r"[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ\d]{7}\d"), _seven_three_one, 0.25, 0.2, 0.05),
    (regex.compile(r"\d{9}"), _luhn, 0.2, 0.2, 0.05),
]
#: What a word that announces the item adds, the same past another number, and what a word that announces something else takes.
_SAID, _CARRIED, _DENIED = 0.35, 0.2, 0.35

#: Numbers that count only if their check holds: payment cards and bank accounts.
_CARD = regex.compile(r"(?<![\p{Latin}\d+])(?<!\d[.,:/-])[3-6]\d{3}(?:[ -]?\d){9,15}(?![\p{Latin}\d])(?![.,:/-]\d)")
_IBAN = regex.compile(r"(?<![\p{Latin}\d])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,4})?(?![\p{Latin}\d])")

_IDENTITY_TOKEN = regex.compile(rf"(?<![\p{{Latin}}\d+])(?=[A-Z\d])(?<!\d[.,:/-])(?:{'|'.join(p.pattern for p, *_ in _IDENTITIES)})(?![\p{{Latin}}\d])(?![.,:/-]\d)")
#: From a word that announces an identity number to the number, within the clause.
_AFTER_IDENTITY = regex.compile(
    r"[^\d\n.;!?]*(?:(?<=(?i:nos?|nrs?|num))\.[^\d\n.;!?]*)?(?:[;:：][^\d\n.!?]*)?(?P<value>(?<![A-Z])[A-Z]{0,3}\d[A-Z\d]*(?:[ -][A-Z\d]+)*)"
)

_STOP = regex.compile(r"[\d\n.;!?]")

_TOWN_WORD = r"\p{Lu}[\p{L}\p{M}’']*(?:-[\p{L}\p{M}’']+)*"
_TOWN = rf"(?:{_TOWN_WORD}[^\S\n]+){{0,2}}{_TOWN_WORD}(?:[^\S\n]+(?:am|an der|ob der|im|in der|bei|sur|sous|les|lès|de la|de las|de los|del|de|upon|on|under)[^\S\n]+{_TOWN_WORD})?"
_ONE_TOWN = rf"(?:(?:Port|Saint|St\.?|San|Santa|New|Old|Great|Little|North|South|East|West|Upper|Lower|Bad|Fort|Mount|Lake|Puerto|Villa|La|Le|Les|El|Los|Las|Groß|Klein|Alt|Neu)[^\S\n]+)?{_TOWN_WORD}(?:[^\S\n]+(?:Harbour|Harbor|Creek|Bay|Hill|Falls|Springs|Green|Heath|Park|City|Town|Cross|Bridge|Ferry|Head|Point|Valley|Wells|Common|Regis))?(?:[^\S\n]+(?:am|an der|ob der|im|in der|bei|sur|sous|les|lès|de la|de las|de los|del|de|upon|on|under)[^\S\n]+{_TOWN_WORD})?"
_SEP = r"(?:\s*,\s*|\s*\n\s*|\s+[–—-]\s+|[^\S\n]+)"
_EN_STREET = (
    r"(?:(?:Street|Road|Lane|Row|Terrace|Avenue|Close|Court|Drive|Way|Walk|Square|Place|Hill|Crescent|Gardens|Grove|Mews|Parade|Quay|Boulevard|Alley|Yard|Wharf|Rise|View|Circle|Highway)(?!\p{L})"
    r"|(?:St|Rd|Ln|Ter|Ave|Ct|Dr|Sq|Pl|Cres|Gdns|Blvd|Hwy)(?!\p{L})\.?)"
)
_FLAT = r"(?:(?i:flat|apt\.?|apartment|unit|suite|room|floor|fl\.)\s*#?[\p{L}\d]{1,4}|\d{1,2}\.?[ºª°o](?:\s?[A-Z]\b)?|(?i:bâtiment|bât\.?|appt\.?|porte|wohnung|whg\.?|piso|puerta|кв\.?)\s*[\p{L}\d]{1,4})"
_CODE = r"(?:[A-Z]{1,2}-)?\d{4,6}(?:-\d{4})?"
_EN_CODE = r"(?:[A-Z]{2}\s+\d{5}(?:-\d{4})?|[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}|\d{5}(?:-\d{4})?)"
#: Street, number, code and town of the continent: the number and what follows it, and read backwards from there the street.
_AFTER_STREET = regex.compile(rf"\s+\d{{1,4}}\s?[a-z]?(?:{_SEP}{_FLAT})?{_SEP}{_CODE}\s+{_TOWN}(?![\p{{L}}\d])")
_STREET_BEFORE = regex.compile(
    rf"(?r)(?<![\p{{L}}\d])(?:(?:{_TOWN_WORD}[ -]){{0,3}}[\p{{L}}’-]*(?:[sS]traße|[sS]trasse|[sS]tr\.|[wW]eg|[gG]asse|[sS]tieg|[aA]llee|[pP]latz|[uU]fer|[rR]ing|[dD]amm|[hH]of|[sS]teig|[mM]arkt|[pP]fad|[cC]haussee|[gG]raben|[bB]erg|[wW]all|[tT]or)|(?:Am|An der|Auf der|Im|In der|Zum|Zur)\s{_TOWN_WORD})"
)
_GREEK = regex.compile(r"\p{Greek}")
_ADDRESSES = [
    p and regex.compile(p)
    for p in (
        rf"(?<![\p{{L}}\d.,/-])\d{{1,5}}[a-zA-Z]?,?\s+(?:(?:St\.|{_TOWN_WORD})\s+){{1,4}}?{_EN_STREET}(?:(?P<flat>{_SEP}{_FLAT})?\s*,\s*{_ONE_TOWN}(?P<code>{_SEP}{_EN_CODE})?|(?:{_SEP}{_FLAT})?\s+{_ONE_TOWN}(?P<code>{_SEP}{_EN_CODE}))(?![\p{{L}}\d])",
        rf"(?<![\p{{L}}\d])(?:P\.?\s?O\.?\s?Box|Post Office Box)\s+\d+(?:\s*,\s*{_ONE_TOWN}(?P<code>{_SEP}{_EN_CODE})?|\s+{_ONE_TOWN}(?P<code>{_SEP}{_EN_CODE}))(?![\p{{L}}\d])",
        rf"(?<![\p{{L}}\d])(?:Postfach|BP|B\.P\.|Boîte postale|Apartado(?: de Correos)?|Apdo\.?|Casella postale|а/я)\s+\d[\d ]*{_SEP}{_CODE}\s+{_TOWN}(?![\p{{L}}\d])",
        None,
        rf"(?<![\p{{L}}\d.,/-])\d{{1,4}}(?:\s?(?:bis|ter|quater|[A-Z]))?,?\s+(?i:rue|avenue|av\.|quai|impasse|chemin|place|allée|allées|boulevard|bd|cours|route|passage|ruelle|square|sentier|faubourg|voie|montée|cité|villa)\s+[\p{{L}}\p{{M}}’' -]+?(?:{_SEP}{_FLAT})?{_SEP}{_CODE}\s+{_TOWN}(?![\p{{L}}\d])",
        rf"(?<![\p{{L}}\d])(?:C/|C\.|Calle|Avda\.?|Av\.|Avenida|Plaza|Pza\.?|Pl\.|Paseo|P\.º|Camino|Ctra\.?|Carretera|Ronda|Travesía|Callejón|Cuesta|Glorieta)\s*[\p{{L}}\p{{M}}’' -]+?,?\s+(?:n\.?\s?[ºo°]\.?\s*|núm\.?\s*)?\d{{1,4}}(?:\s?[A-Za-z]\b)?(?:{_SEP}{_FLAT})?{_SEP}{_CODE}\s+{_TOWN}(?![\p{{L}}\d])",
        r"(?<![\p{L}\d])(?:\d{6},\s*)?(?:г\.\s*\p{Lu}[\p{L}-]+,\s*)?(?:ул\.|улица|пр\.|просп\.|проспект|пер\.|переулок|наб\.|набережная|пл\.|площадь|шоссе|бульвар|б-р)\s+[\p{L}\p{M} -]+?,\s*(?:д\.\s*)?\d{1,4}[а-я]?(?:,\s*(?:корп|к|стр)\.\s*\d+)?(?:,\s*(?:кв|оф)\.\s*\d+)?(?:,\s*(?:г\.\s*)?\p{Lu}[\p{L}-]+(?:\s\p{Lu}[\p{L}-]+)?)?(?:,\s*\d{6})?(?![\p{L}\d])",
        r"(?<![\p{L}\d])(?:οδός\s+|Οδός\s+)?\p{Lu}[\p{Greek}\p{M}]+(?:\s\p{Lu}[\p{Greek}\p{M}]+)?\s+\d{1,4},\s*(?:\d{3}\s?\d{2}\s+\p{Lu}[\p{Greek}\p{M}]+|\p{Lu}[\p{Greek}\p{M}]+\s+\d{3}\s?\d{2})(?![\p{L}\d])",
    )
]

#: Words without one of which the address pattern of the same place cannot match, in small letters.
_SIGNS = [
    "street road lane row terrace avenue close court drive way walk square place hill crescent gardens grove mews parade quay boulevard alley yard wharf rise view circle highway st rd ln ter ave ct dr sq pl cres gdns blvd hwy",
    "box",
    "postfach bp b.p. postale apartado apdo а/я",
    "straße strasse str. weg gasse stieg allee platz ufer ring damm hof steig markt pfad chaussee graben berg wall tor am an auf im in zum zur",
    "rue avenue av. quai impasse chemin place allée boulevard bd cours route passage ruelle square sentier faubourg voie montée cité villa",
    "c/ c. calle avda av. avenida plaza pza pl. paseo p.º camino ctra carretera ronda travesía callejón cuesta glorieta",
    "ул. улица пр. просп проспект пер. переулок наб. набережная пл. площадь шоссе бульвар б-р",
    None,
]

#: From a word that announces a name to the name.
_AFTER_CUE = regex.compile(rf"(?:\s*[:：,;–—-]\s*|{_S}|(?<=[\p{{Han}}\p{{Hiragana}}\p{{Thai}}]))(?:(?i:is|ist|est|es|是|は|है)\s+)?(?:(?i:{TITLES}))?{_NAME}(?![\p{{L}}\p{{M}}])")
_AFTER_AS = regex.compile(rf"\s+(?:(?i:{TITLES}))?{_NAME}\s+(?i:wrote|writes|said|noted|reported|mentioned|schrieb|schreibt|l[’']a écrit|écrit|écrivait|a écrit|escribió|escribe|писал|писала|написал|написала|έγραψε)(?![\p{{L}}])")
#: Read backwards from an item: the name right before it.
_ENDING_NAME = regex.compile(rf"(?r)(?<![\p{{L}}\p{{M}}]){_NAME}\s*(?:[,:/|–—-]|[<(\[])\s*")

# Words that tell that someone's words follow.
AS = "as wie comme como как όπως"


@lru_cache(maxsize=1)
def _words() -> ahocorasick.Automaton:
    """All words that announce or are needed by an item, each with what it stands for."""
    stands: dict[str, set[object]] = defaultdict(set)
    for w in NAME_BEFORE.split("|"):
        stands[w.lower()].add("name")
    for kind, listed in CUES.items():
        for w in listed.split("|"):
            stands[w.lower()].add(kind)
    for w in AS.split():
        stands[w].add("as")
    for i, listed in enumerate(_SIGNS):
        for w in (listed or "").split():
            stands[w].add(i)
    automaton = ahocorasick.Automaton()
    for w, kinds in stands.items():
        automaton.add_word(w, (len(w), kinds))
    automaton.make_automaton()
    return automaton


@dataclass
class Signs:
    """Where the words of ``_words`` stand in a text: ends by kind in rising order, each with its beginning, and the address patterns that may match."""

    ends: dict[str, list[int]]
    starts: dict[str, list[int]]
    addresses: set[int]
    sentences: list[int]


_KINDS = ("name", "as", "phone", "identity", "other")


def _signs(text: str, low: str) -> Signs:
    ends: dict[str, list[int]] = {k: [] for k in _KINDS}
    starts: dict[str, list[int]] = {k: [] for k in _KINDS}
    addresses: set[int] = set()
    for last, (length, kinds) in _words().iter(low):
        end = last + 1
        start = end - length
        for k in kinds:
            if isinstance(k, int):
                addresses.add(k)
            elif (start == 0 or not text[start - 1].isalpha()) and (k in ("name", "as") or not _CARRIES_ON.match(text, end)):
                ends[k].append(end)
                starts[k].append(start)
    return Signs(ends, starts, addresses, [m.start() for m in _SENTENCE_END.finditer(text)] if ends["identity"] else [])


@dataclass(frozen=True)
class Item:
    kind: str
    start: int
    end: int
    score: float


_NUMBER_WORDS = regex.compile(r"(?:[A-Z\d]+(?:[ -](?=[A-Z]?\d|[A-Z]\b))?)+")
#: A letter that carries a word on; words of scripts without spaces may be followed by any letter.
_CARRIES_ON = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}]")
#: What may not stand between a word and the item that it announces.
_SENTENCE_END = regex.compile(r"[\n!?]|(?<!(?i:nos?|nrs?|num))\.\s+\p{Lu}")
_CLAUSE_END = regex.compile(rf"{_SENTENCE_END.pattern}|\d")


def _announced(text: str, at: int, kind: str, signs: Signs) -> int:
    """The end of the last word of ``kind`` before ``at`` in the same clause, past no other number; -1 without one."""
    ends = signs.ends[kind]
    i = bisect_right(ends, at) - 1
    return ends[i] if i >= 0 and not _CLAUSE_END.search(text, ends[i], at) else -1


def _carried(at: int, kind: str, signs: Signs) -> bool:
    """Whether a word of ``kind`` stands before ``at`` in the same sentence, other numbers between or not."""
    i = bisect_right(signs.ends[kind], at) - 1
    return i >= 0 and bisect_left(signs.sentences, signs.ends[kind][i]) == bisect_left(signs.sentences, at)


def _followed(text: str, end: int, kind: str, signs: Signs) -> bool:
    """Whether a word of ``kind`` is the next word behind ``end``."""
    starts = signs.starts[kind]
    i = bisect_left(starts, end)
    return i < len(starts) and not any(c.isalnum() or c in ".!?\n" for c in text[end : starts[i]])


_NAME_WORD = regex.compile(r"[\p{L}\p{M}’'-]+\.?")


@lru_cache(maxsize=50_000)
def _tokens(name: str) -> frozenset[str]:
    words = _NAME_WORD.findall(canonical(name, fold_case=True))
    return frozenset(w for w in words if w not in ("sr", "sr.", "jr", "jr.", "senior", "junior"))


#: Read backwards from an address: words of dwelling in the same sentence.
_DWELLS = regex.compile(r"(?r)(?i)\b(?:live[sd]?|living|address|reside[sd]?|ship|send|deliver|mail|post|moved|at home|habite|wohne|wohnt|vivo|adresse|dirección|адрес|живу)\b[^.!?\n]*")


def _emails(text: str, low: str) -> list[Item]:
    out = []
    forms = [(_AT, _DOMAIN)] if "@" in text or _BRACKETED_AT.search(text) else []
    # A spoken address has a spoken dot.
    forms += [(_SAID_AT, _SAID_DOMAIN)] if "dot" in low else []
    for sign, domain in forms:
        for m in sign.finditer(text):
            user, rest = _USER.match(text, 0, m.start()), domain.match(text, m.end())
            if user and rest:
                out.append(Item("email", user.start(), rest.end(), 1.0))
    return out


def _addresses(text: str, signs: Signs) -> list[Item]:
    out = []
    for i, pattern in enumerate(_ADDRESSES):
        if i not in signs.addresses if _SIGNS[i] else not _GREEK.search(text):
            continue
        if pattern is None:
            for m in _AFTER_STREET.finditer(text, overlapped=True):
                if street := _STREET_BEFORE.match(text, 0, m.start()):
                    out.append(Item("address", street.start(), m.end(), 0.9))
            continue
        for m in pattern.finditer(text):
            sure = 0.9
            if "code" in pattern.groupindex and not m["code"]:
                # A street and a town alone may be anything; a flat, a box or words of dwelling make it an address.
                boxed = "flat" not in pattern.groupindex or m["flat"]
                sure = 0.7 if boxed or _DWELLS.match(text, 0, m.start()) else 0.3
            out.append(Item("address", m.start(), m.end(), sure))
    return out


def _confirmed(text: str) -> list[Item]:
    """Cards and accounts: only what passes its check."""
    out = []
    for kind, pattern, check in (("card", _CARD, _luhn), ("iban", _IBAN, _iban)):
        for m in pattern.finditer(text):
            if check(m.group().replace(" ", "").replace("-", "")):
                out.append(Item(kind, m.start(), m.end(), 1.0))
    return out


def _identities(text: str, signs: Signs) -> list[Item]:
    out = []
    for m in _IDENTITY_TOKEN.finditer(text):
        value = m.group()
        bare = value.replace(" ", "").replace("-", "")
        score = max(base + (adds if check(bare) else -takes) for shape, check, base, adds, takes in _IDENTITIES if shape.fullmatch(value))
        said, phone, other = (_announced(text, m.start(), k, signs) for k in ("identity", "phone", "other"))
        if said >= 0 and said >= max(phone, other):
            score += _SAID
        elif max(phone, other) >= 0 or _followed(text, m.end(), "other", signs):
            score -= _DENIED
        elif _carried(m.start(), "identity", signs):
            score += _CARRIED
        out.append(Item("identity", m.start(), m.end(), score))
    # Of the words with one and the same stop behind them, the last.
    last_of: dict[int, int] = {}
    stop = -1
    for end in signs.ends["identity"]:
        if stop < end:
            found = _STOP.search(text, end)
            if not found:
                break
            stop = found.start()
        last_of[stop] = end
    for end in last_of.values():
        m = _AFTER_IDENTITY.match(text, end)
        if not m:
            continue
        a, b = m.span("value")
        value = _NUMBER_WORDS.match(text, a, b)
        b = value.end() if value else b
        bare = text[a:b].replace(" ", "").replace("-", "")
        if 6 <= len(bare) <= 18 and sum(c.isdigit() for c in bare) >= 5 and not text[b : b + 1].isalnum():
            out.append(Item("identity", a, b, 0.52))
    return out


def _phones(text: str, signs: Signs) -> list[Item]:
    out = []
    for m in _DIGITS.finditer(text):
        value = m.group()
        digits = sum(c.isdigit() for c in value)
        if not 8 <= digits <= 15 or _DATE.search(value):
            continue
        score = 0.5 if _PHONE_SHAPES.fullmatch(value) else 0.15
        said, other = _announced(text, m.start(), "phone", signs), _announced(text, m.start(), "identity", signs)
        if said >= 0 and said >= other:
            score += _SAID
        elif other >= 0:
            score -= _DENIED
        out.append(Item("phone", m.start(), m.end(), score))
    return out


def _names(text: str, cast: list[str] | None, others: list[Item], signs: Signs) -> list[Item]:
    found: dict[tuple[int, int], float] = {}

    def propose(span: tuple[int, int], score: float) -> None:
        found[span] = max(found.get(span, 0.0), score)

    for kind, pattern in (("name", _AFTER_CUE), ("as", _AFTER_AS)):
        for end in signs.ends[kind]:
            if m := pattern.match(text, end):
                propose(m.span("name"), 0.7)
    for item in others:
        if m := _ENDING_NAME.match(text, 0, item.start):
            propose(m.span("name"), 0.6)
    if not found:
        return []
    known = [_tokens(c) for c in cast or [] if c]
    # A name given with a cue counts wherever else the text repeats it.
    for name in {text[a:b] for (a, b), s in found.items() if s >= ENOUGH}:
        at = text.find(name)
        while at >= 0:
            end = at + len(name)
            if not text[max(0, at - 1) : at].isalpha() and not text[end : end + 1].isalpha():
                propose((at, end), 0.55)
            at = text.find(name, end)
    out = []
    for (a, b), score in found.items():
        tokens = _tokens(text[a:b])
        if any(tokens <= k or k <= tokens for k in known if k):
            score -= 1.0
        out.append(Item("name", a, b, score))
    return out


#: Wide spaces, full-width signs and hyphens as the plain ones, one for one, so that places hold.
_LEVEL = {c: ord(" ") for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)} | {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x2010: ord("-"), 0x2011: ord("-")}

_LEVELLED = regex.compile("[" + "".join(map(regex.escape, map(chr, _LEVEL))) + "]")

#: Types of items, the surest first.
KINDS = ("email", "iban", "card", "address", "identity", "phone", "name")
_ORDER = {k: i for i, k in enumerate(KINDS)}


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _take(proposals: list[Item], taken: list[Item]) -> None:
    """Adds to the items of ``taken``, which are in order, each proposal that overlaps none of them."""
    starts = [t.start for t in taken]
    for p in proposals:
        i = bisect_right(starts, p.start)
        if (i == 0 or taken[i - 1].end <= p.start) and (i == len(taken) or p.end <= taken[i].start):
            taken.insert(i, p)
            starts.insert(i, p.start)


def find_items(text: str | None, cast: list[str] | None = None) -> list[Item]:
    """The items of a text in order, none overlapping, of the types in ``KINDS``."""
    if not text:
        return []
    if not text.isascii():
        text = _LEVELLED.sub(lambda m: chr(_LEVEL[ord(m.group())]), text)
    low = _lowered(text)
    signs = _signs(text, low)
    strong = _emails(text, low)
    numbers: list[Item] = []
    if _DIGIT.search(text):
        strong += _confirmed(text) + _addresses(text, signs)
        numbers = _identities(text, signs) + _phones(text, signs)
    proposals = strong + numbers
    proposals = [p for p in proposals if p.score >= ENOUGH]
    proposals.sort(key=lambda p: (_ORDER[p.kind] > _ORDER["address"], -p.score, _ORDER[p.kind], p.start - p.end, p.start))
    taken: list[Item] = []
    _take(proposals, taken)
    names = [n for n in _names(text, cast, taken, signs) if n.score >= ENOUGH]
    names.sort(key=lambda p: (-p.score, p.start - p.end, p.start))
    _take(names, taken)
    return taken


def redact(text: str | None, items: list[Item]) -> str | None:
    """The text with each item replaced by its type in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for i in items:
        out += [text[at : i.start], f"[{i.kind.upper()}]"]
        at = i.end
    return "".join(out) + text[at:]


def personal_information(docs: DataFrame, key: str = "doc_id", text: str = "text", cast: str | None = "cast_names", kinds: Sequence[str] = KINDS) -> DataFrame:
    """``key``, ``redacted`` text and ``items`` (array of ``pii_type``, ``char_start``, ``char_end``) of every row.

    ``kinds`` are the types that count. Names that occur in the row's ``cast`` (null: none) are no items. A null text stays
    null with no items, an empty one empty; repeated rows and keys give one row each; whole texts are read whatever their
    length; an empty table gives an empty result; other columns are not read.
    """
    wanted = frozenset(kinds)
    key_type = docs.schema[key].dataType.simpleString()
    item = pa.list_(pa.struct([("pii_type", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, tuple] = {}
            texts, spans = [], []
            for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at = (t, None if c is None else tuple(c))
                if at not in seen:
                    items = [i for i in find_items(t, c) if i.kind in wanted]
                    seen[at] = (redact(t, items), [{"pii_type": i.kind, "char_start": i.start, "char_end": i.end} for i in items])
                texts.append(seen[at][0])
                spans.append(seen[at][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, item)], names=["k", "redacted", "items"])

    names = F.col(cast) if cast else F.lit(None).cast("array<string>")
    return (
        spread(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), names.alias("c")))
        .mapInArrow(run, f"k {key_type}, redacted string, items array<struct<pii_type: string, char_start: int, char_end: int>>")
        .withColumnRenamed("k", key)
    )
