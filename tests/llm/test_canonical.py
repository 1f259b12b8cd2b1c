import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm.canonical import canonical, canonical_texts, look_alike_classes, look_alike_pairs, read_twins

SAME = [
    ("A blue  lamp. ", " A blue　lamp．"),
    ("final office", "ﬁnal oﬃce"),
    ("été", "été"),
    ("Louisa still", "Lоuіѕа ѕtіll"),
    ("The moved", "Τhe mονed"),
    ("ランプ", "ﾗﾝﾌ゚"),
    ("水門", "⽔⾨"),
    ("Keeper", "Keeper"),
    ("seed", "se​͏e⁠­d"),
    ("hiver-là", "hiver‐là"),
    ("l’été", "lʼété"),
    ("sound", "\ua731\u1d0f\u1d1cnd"),
    ("yoyo", "\u04af\u2c9fy\uab93".replace("\uab93", "o")),
    ("swz", "\uabaa\uab83\uab93"),
    ("ёлка", "ёлка"),
]
OTHER = [("10²", "102"), ("n.º", "n.o"), ("Keeper", "keeper"), ("schon", "schön"), ("мой", "мои"), ("“far”", '"far"'), ("己经", "已经"), ("はば", "ぱぱ"), ("won;", "won,")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert canonical(a) != canonical(b)


def test_words_keep_their_script():
    assert canonical("мoкрые пaльто") == "мокрые пальто" and canonical("Ζοmaletοpi") == "Zomaletopi"
    assert canonical("ёлка") == canonical("ëлка") == "ёлка" and canonical("γράμμα") == "γράμμα" and canonical("сор") == "cop"


def test_folding_is_an_option():
    assert canonical("STRASSE", fold_case=True) == canonical("straße", fold_case=True)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_idempotent(text):
    assert canonical(canonical(text)) == canonical(text)
    assert canonical(canonical(text, fold_case=True), fold_case=True) == canonical(text, fold_case=True)


def test_column(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " a b "), (3, " a b ")], "id int, text string")
    assert [(r.id, r.canonical) for r in canonical_texts(df).orderBy("id").collect()] == [(1, None), (2, ""), (3, "a b"), (3, "a b")]
    assert df.columns == ["id", "text"]
    with pytest.raises(ValueError):
        canonical_texts(df, to="text")


def test_pairs_against_brute_force(spark):
    rng = random.Random(1)
    forms = [None, "", "…", "a b", "a b", " a b", "а b", "c", "c​", "C", "***", "* * *"]
    rows = [(rng.choice(["x", "y", None]), i // 2 * 2 if i % 9 == 0 else i, rng.choice(forms), "form", "string") for i in range(80)]
    rows += rows[:5]
    got = look_alike_pairs(spark.createDataFrame(rows, "g string, id bigint, t string, form string, string string"), ["g"], "id", "t")
    want = set()
    for p, q in itertools.combinations(set(rows), 2):
        if p[0] and p[0] == q[0] and p[1] != q[1] and p[2] and q[2] and p[2] != q[2] and any(c.isalnum() for c in p[2]) and canonical(p[2]) == canonical(q[2]):
            want.add((p[0], min(p[1], q[1]), max(p[1], q[1])))
    assert {tuple(r) for r in got.collect()} == want
    empty = look_alike_pairs(spark.createDataFrame([], "g string, id bigint, t string"), ["g"], "id", "t")
    assert empty.count() == 0


def test_hot_strings_are_split(spark):
    rows = [("x", i, "a b" if i % 2 else "a\u00a0b") for i in range(40)] + [("x", 40, "a  b"), ("x", 41, None)]
    df = spark.createDataFrame(rows, "g string, id bigint, t string")
    whole, split = (look_alike_pairs(df, ["g"], "id", "t", salted=n) for n in (1_000, 3))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect())) and split.count() == 400 + 40
    classes = look_alike_classes(df.union(df), ["g"], "id", "t").collect()
    assert len(classes) == 41 and {r["class"] for r in classes} == {0}


def test_twins_from_a_list():
    twins = read_twins(["# list", "\ufeff0269 ;\t0069 ;\tMA # x", "FB01 ; 0066 0069 ; MA", "2010 ; 002D ; MA"])
    assert canonical("w\u0269n", twins=twins) == "win" and canonical("w\u0269n") != "win"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeéДo-\u0301\u0435\u0450 \u00a0\u200b\u00b2\ufb01\u0441x\u1100\u1161\u11a8K\u212a\u30d8\u3099")), max_size=12))
def test_short_ways_give_the_same(text):
    # A twin that does not occur sends every text the whole way.
    assert canonical(text) == canonical(text, twins=read_twins(["0269 ; 0069 ; MA"]))
