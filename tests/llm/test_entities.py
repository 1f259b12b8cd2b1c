import itertools
import math
import random
from collections import Counter

import pytest

from loomtext.llm.entities import Vocabulary, average_linkage, clustered, components, goes_by, linked_in_rounds, linked_records, profile, record_pairs
from loomtext.llm.people import Firm, Person, parse

NAMES = [
    ("Robert A. Nethermarch", Person("robert", "nethermarch")),
    ("RobertNethermarch", Person("robert", "nethermarch")),
    ("ZOË ORRINLEIGH", Person("zoe", "orrinleigh")),
    ("Nethermarch, Robert", Person("robert", "nethermarch")),
    ("Yarrelshaw, William, Jr", Person("william", "yarrelshaw", "jr")),
    ("W. Yarrelshaw Junior", Person("w", "yarrelshaw", "jr")),
    ("Yarrelgate H.", Person("h", "yarrelgate")),
    ("Mrs. Hollinshaw", Person("", "hollinshaw")),
    ("Captain Charles Kestle Sr.", Person("charles", "kestle", "sr")),
    ("Bob", Person("", "bob")),
    ("Old Mr. Ostershaw", Person("", "ostershaw")),
    ("Aunt Louisa", Person("", "louisa")),
    ("Екатерина Тихоствол", Person("ekaterina", "tikhostvol")),
    ("Ana de la Torre", Person("ana", "de la torre")),
    ("the stranger", None),
    ("the Wethergates", None),
    ("he", None),
    ("", None),
    (None, None),
    ("—", None),
    ("Umberwick + Winderleigh salt co", Firm(("umberwick", "winderleigh", "salt"), ("company",))),
    ("Salt Company, Umberwick & Winderleigh", Firm(("umberwick", "winderleigh", "salt"), ("company",))),
    ("The Umberwick-Winderleigh Bros.", Firm(("umberwick", "winderleigh"), ("brothers",))),
]


@pytest.mark.parametrize("typed,name", NAMES)
def test_parse(typed, name):
    assert parse(typed)[0] == name


WORDS = "field string, word string"
GOES_BY = "word string, other string, share double"


def test_vectors_against_brute_force(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 8))) for _ in range(60)})
    shares = [(words[i], words[i + 1], 0.5) for i in range(0, 20, 4)]
    lists = [(f, w) for f in "gf" for w in words]
    vocabulary = Vocabulary(spark.createDataFrame(lists, WORDS), spark.createDataFrame(shares, GOES_BY), 0.4)
    scoped = spark.createDataFrame([(s, f, w) for s in ("x", "y") for f, w in lists if s == "x" or w[0] in "ab"], "s string, field string, word string")
    got = {(r.s, r.field, r.a, r.b): r.cos for r in vocabulary.met(scoped).collect()}

    def grams(w):
        return {f"^{w}$"[i : i + n] for n in (2, 3) for i in range(len(w) + 3 - n)}

    df = Counter(g for w in words for g in grams(w))
    own = {w: {g: math.log(1 + len(words) / df[g]) for g in grams(w)} for w in words}

    def unit(v):
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / norm for k, x in v.items()}

    own = {w: unit(v) for w, v in own.items()}
    given = {w: Counter(v) for w, v in own.items()}
    for w, o, share in shares:
        for g, x in own[o].items():
            given[w][g] += share * x
    given = {w: unit(v) for w, v in given.items()}
    want = {}
    for s in "xy":
        for field, vec in (("g", given), ("f", own)):
            kept = [w for w in words if s == "x" or w[0] in "ab"]
            for a, b in itertools.combinations_with_replacement(kept, 2):
                c = sum(x * vec[b].get(g, 0) for g, x in vec[a].items())
                if c >= 0.4:
                    want[s, field, a, b] = c
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_other_names_are_counted(spark):
    schema = "kind string, given array<string>, words array<string>"
    rows = [("person", ["robert"], ["bob"])] * 4 + [("person", ["bob", "robert"], [])] * 2 + [("person", ["bob"], ["xy"]), ("person", ["bob"], []), ("firm", [], [])]
    got = {(r.word, r.other): round(r.share, 4) for r in goes_by(spark.createDataFrame(rows, schema), 2).collect()}
    assert got == {("bob", "robert"): round(6 / 7, 4), ("robert", "bob"): round(2 / 6, 4)}


@pytest.mark.parametrize("seed", range(3))
def test_linkage_in_rounds_is_the_same(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{a:02}", f"n{b:02}", rng.random()) for a, b in itertools.combinations(range(40), 2) if rng.random() < 0.25]
    df = spark.createDataFrame(edges, "a string, b string, score double")
    want = average_linkage(edges, 0.3)
    assert {r.node: r.cluster for r in linked_in_rounds(df, 0.3).collect()} == want
    assert {r.node: r.cluster for r in clustered(df, 0.3, largest=10).collect()} == want
    assert {r.node: r.cluster for r in clustered(df, 0.3).collect()} == want


def test_average_linkage():
    edges = [("a", "b", 0.9), ("b", "c", 0.9), ("c", "d", 0.9), ("x", "y", 0.4)]
    found = average_linkage(edges, 0.5)
    assert found["a"] == found["b"] and found["c"] == found["d"] and found["a"] != found["c"] and found["x"] != found["y"]


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(90)) if a != b]
    edges += [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in parent}


SCHEMA = "rec_id bigint, book_id string, display_name string, aliases array<string>, gender string, cluster string, node string"


def pairs(spark, rows):
    full = [(i, book, name, aliases, gender, "c", "n") for i, (book, name, aliases, gender) in enumerate(rows)]
    got = record_pairs(linked_records(spark.createDataFrame(full, SCHEMA)))
    return {tuple(r) for r in got.collect()}


def test_records(spark):
    rows = [
        ("b1", "Robert Wethergate", None, "MALE"),
        ("b1", "Bob", ["Robbert Wethergate", "he"], None),
        ("b1", "Wethergate, Robt.", [], "UNKNOWN"),
        ("b1", "Augustus Wethergate", [None], "male"),
        ("b1", "William Wethergate Sr.", None, None),
        ("b1", "William Wethergate Junior", None, None),
        ("b1", None, ["the stranger"], "MALE"),
        ("b1", "R. Wethergate", None, "MALE"),
        ("b2", "Robert Wethergate", None, "MALE"),
        ("b1", "Umber & Winder Salt Co", None, "NEUTRAL"),
        ("b1", "Salt Company, Umber & Winder", None, None),
        ("b1", "Bob", [], "MALE"),
        (None, "Robert Wethergate", None, "MALE"),
        ("b1", "", ["", None], ""),
        ("b1", "x" * 20_000, None, None),
    ]
    group = {0, 1, 2, 7, 11}
    assert pairs(spark, rows) == {(a, b) for a in group for b in group if a < b} | {(9, 10)}


def test_ambiguous_part_stays_alone_and_equal_records_pair(spark):
    rows = [("b", "Frances Orrinfell", None, None), ("b", "Fiona Orrinfell", None, None), ("b", "F. Orrinfell", None, None)]
    assert pairs(spark, rows) == set()
    assert pairs(spark, [("b", "P. Morrow", None, None)] * 2) == {(0, 1)}
    assert pairs(spark, []) == set()


def test_other_names_learned_from_records(spark):
    aliased = [(f"b{i}", "Robert Orrin", ["Bob Orrin"], None) for i in range(4)]
    assert pairs(spark, [*aliased, ("z", "Bob Kestlewick", None, None), ("z", "Robert Kestlewick", None, None), ("z", "Hugo Kestlewick", None, None)]) == {(4, 5)}


def test_few_nearest_and_hot_clusters(spark):
    full = [(i, "b", n, None, None, "c", "n") for i, n in enumerate(["Robert Wethergate", "Robert Wethergat", "Augustus Pell", "Robert Wethergate"] * 5)]
    df = spark.createDataFrame(full, SCHEMA)
    every, few = (linked_records(df, top_n=n) for n in (None, 1))
    assert len({r.cluster for r in every.collect()}) == len({r.cluster for r in few.collect()}) == 2
    split = {tuple(r) for r in record_pairs(every, salted=4).collect()}
    assert split == {tuple(r) for r in record_pairs(every).collect()} and len(split) == 15 * 14 // 2 + 10


def test_profile_without_a_name():
    assert profile(None, None, None) is None and profile("The Captain", ["he", "them"], "MALE") is None
