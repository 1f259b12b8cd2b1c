import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm.bpe import encoder, slices, token_ids, vocabulary_path
from loomtext.llm.packing import best_fit, pack, placements, total_cost

P = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "<|endoftext|>", "aaaaaaaaaaaaa", "don't 123  \n\n x", "日本語のテキスト" * 300, "é" * 50, "\x00\x01", "👩‍👩‍👧"]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id bigint, text string, ids string")
    ids = reference()
    got = {r.doc_id: r.ids for r in token_ids(df).collect()}
    assert got == {i: ids(t) for i, t in enumerate(ODD)}
    assert {r.doc_id: r.n_tokens for r in token_ids(df, count_only=True).collect()} == {i: len(v) for i, v in got.items()}
    assert token_ids(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_ids_of_any_text(texts):
    ids = reference()
    assert encoder(vocabulary_path(), P.PATTERN).encode(texts) == [ids(t) for t in texts]


def test_slices():
    assert list(slices(["abc", "d", "e" * 9, "", "f"], 4)) == [(0, 2), (2, 3), (3, 5)]
    assert list(slices([])) == []


def check_plan(sizes, costs):
    counts = Counter(sizes)
    runs, bins = best_fit(counts, costs)
    load, seen = Counter(), Counter()
    capacity = {}
    for size, low, high, first, each, cap, room in placements(runs, bins):
        for rank in range(low, high):
            c = first + (rank - low) // each
            load[c] += size
            capacity[c] = (cap, room)
            seen[size] += 1
    assert seen == counts
    for c, (cap, room) in capacity.items():
        assert load[c] + room == cap and cap in costs
    return capacity


def test_best_fit_holds_every_item_once():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(0, 400))]
        used = check_plan(sizes, {64: 64})
        assert len(used) <= 11 / 9 * max(1, -(-sum(sizes) // 64)) + 1
        check_plan(sizes, {16: 16, 32: 30, 64: 70})


def test_shrinks_to_contents():
    assert check_plan([5], {8: 8, 64: 64}) == {0: (8, 3)}


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i % 90, rng.choice([None, 0, -3, 10, 10, 10, 33, 100, 250]), "c") for i in range(300)]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, n int, container string"), "doc_id", "n", (100,)).collect()
    wanted = Counter(r[1] for r in rows if r[1] and r[1] > 0)
    assert sum(r.part_end - r.part_start for r in got) == sum(k * v for k, v in wanted.items())
    load, items = Counter(), defaultdict(int)
    for r in got:
        load[r.container] += r.part_end - r.part_start
        items[r.part_end - r.part_start] += 1
        assert r.capacity == 100
    assert items[10] == wanted[10] and items[33] == wanted[33] and items[100] == wanted[100] + 2 * wanted[250]
    assert all(100 - load[r.container] == r.room >= 0 for r in got)
    assert pack(spark.createDataFrame([], "doc_id bigint, n int"), "doc_id", "n").count() == 0


@pytest.mark.parametrize(
    "counts,costs,most",
    [
        ({700: 10}, {700: 700, 2048: 2048}, 7000),
        ({500: 3}, {512: 512, 1024: 1024, 2048: 2048}, 1536),
        ({512: 4}, {512: 600, 2048: 2048}, 2048),
        ({1000: 1, 24: 1}, {512: 512, 1024: 1024, 2048: 2048}, 1024),
    ],
)
def test_capacities_are_weighed_jointly(counts, costs, most):
    assert total_cost(best_fit(counts, costs)[1], costs) <= most


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12), st.permutations([64, 32, 24]))
def test_joint_plan_is_no_dearer_than_one_capacity(counts, capacities):
    costs = {c: c for c in capacities}
    assert total_cost(best_fit(counts, costs)[1], costs) <= total_cost(best_fit(counts, {64: 64})[1], costs)
