import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm.sentences import sentence_spans, sentences

CASES = [
    ["“It is late.", "We go,” said Ann."],
    ["“‘Never,’ he told me.", "That was all,” said Zoë.", "What?!", "Her cousin would not!"],
    ["It was 4.20 p.m. when she left.", "He came at 6 a.m.", "The master returned."],
    ["J. R. Yarrel opened it.", "The U.S. consul kept it.", "They sold tar, oil, etc.", "The porters left."],
    ["Dr. Quill and Mrs. Thistle lived at No. 262, St. Lorren Street.", "Vol. 97, pp. 361–12, cf. the entry.", "(She left.)", "The end."],
    ["“Go on!” she said.", "Robert cried, “Stop!” and left.", "He asked Capt. Penn: “Who came?”", "No answer came."],
    ["“Do you believe me?”", "Ann cried, “Stop!” and left.", "“Is it late?” Robert asked.", "“Who?”", "Stephen asked Capt. Lorren: “Who came?”"],
    ["Prof. Orrin fragte: „Wer kam?“", "Keine Antwort kam.", "„Komm!“, rief Käthe.", "Am 3. Tag las sie.", "Sie verkauften Hanf, Öl usw.", "Das war z. B. Gertrud."],
    ["« Venez ! » cria José.", "« Il est tard.", "Prenons tout », dit Clé.", "— Qui vint ? demanda Éti.", "M. Penn paya 66,47 écus."],
    ["—Es tarde.", "Vamos —dijo Ana.", "¿Qué?", "¡Mi hermano!", "Dña. Dun vivía en el n.º 355, allí.", "Véase la pág. 146."],
    ["«Кто забыл?» — спросил он.", "Они продавали дёготь и т. д.", "Екатерина ушла.", "И. О. Суровей жил в д. 270."],
    ["Ποιος ήρθε；", "Τι ησυχία;", "Ποιος ήρθε;", "Ο κ. Μαρτής πλήρωσε 28,57 δραχμές.", "«Ποιος ξέχασε;» ρώτησε."],
]
TIGHT = [
    ["“时候不早了。", "带上旧地图！”姑娘说。", "没有人等着……忘记了。", "老账房问：“谁来了？”", "没有人回答。"],
    ["「待て！」と娘は叫んだ。", "水深は73.45メートルだ。", "待った……そして去った。", "静かな夜だ！"],
]


@pytest.mark.parametrize("parts", CASES)
def test_spaced(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == parts


@pytest.mark.parametrize("parts", TIGHT)
def test_tight(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == parts


def test_lines_hidden_characters_and_other_scripts():
    def parts(t):
        return [t[a:b] for a, b in sentence_spans(t)]

    assert parts("CHAPTER I\n\nThe lamp\nwent out. It rained") == ["CHAPTER I", "The lamp\nwent out.", "It rained"]
    assert parts("​One.​ Two.﻿") == ["One.", "Two."]
    assert parts("देर हो गई। डॉ. वेल आए। “कौन?” मुंशी ने पूछा।") == ["देर हो गई।", "डॉ. वेल आए।", "“कौन?” मुंशी ने पूछा।"]
    assert parts("من نسي؟ «من نسي؟» سأل الكاتب. وصل.") == ["من نسي؟", "«من نسي؟» سأل الكاتب.", "وصل."]
    assert parts("หญิงชราขายโคมไฟ ใครพบ\nจดหมาย") == ["หญิงชราขายโคมไฟ", "ใครพบ\nจดหมาย"]
    assert parts("⁂") == parts("* * *") == parts("") == parts(" \n ") == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB1 .!?“”«»,\n​。」ก…")), max_size=40))
def test_spans_are_ordered_and_leave_nothing_out(text):
    spans = sentence_spans(text)
    assert all(a < b for a, b in spans) and all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, c in enumerate(text) if c.isalnum())


def test_table(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "One. Two.", 9), (3, "One. Two.", 9), (4, "x. " * 50_000, 9)]
    got = sentences(spark.createDataFrame(rows, "entry_id bigint, text string, sent_start int"))
    assert [tuple(r) for r in got.where("entry_id = 3").collect()] == [(3, 0, 4), (3, 5, 9)] * 2
    assert {r.entry_id for r in got.collect()} == {3, 4}
    assert sentences(spark.createDataFrame([], "entry_id bigint, text string")).count() == 0


@pytest.mark.parametrize(
    "text,lang,cuts",
    [
        ("He lives on Elm St. The house is red.", "en", 2),
        ("Is it so? yes.", "en", 2),
        ("“Is it so?” asked Ann.", "en", 1),
        ("See vol. Two.", "en", 1),
        ("Am 3. Mai kam er.", "de", 1),
        ("There were 3. Nobody spoke.", "en", 2),
        ("Vea a la Sra. Ruiz.", "es", 1),
        ("We met at 6 a.m. Jonathan spoke.", "en", 2),
        ("x" * 500 + " " + "e.g. " * 200 + "Mr. Brown said so. He left.", "en", 2),
    ],
)
def test_lists_of_the_language(text, lang, cuts):
    assert len(sentence_spans(text, lang)) == cuts


def test_a_long_clause_behind_a_quotation():
    far = "“Go!” " + "Anna Maria Luisa Beata Clara Dora Edith Frieda Greta " * 8 + "said."
    assert len(sentence_spans(far, "en")) == 1


def test_language_column(spark):
    rows = spark.createDataFrame([(1, "Am 3. Mai kam er.", "de"), (2, "There were 3. Nobody spoke.", "en"), (3, None, "de"), (4, "Am 3. Mai.", None)], "entry_id bigint, text string, lang string")
    got = sentences(rows, lang="lang").groupBy("entry_id").count().collect()
    assert {r["entry_id"]: r["count"] for r in got} == {1: 1, 2: 2, 4: 1}
