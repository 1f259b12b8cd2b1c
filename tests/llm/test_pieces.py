import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm.pieces import piece_spans, pieces


def check(text, limit, overlap):
    spans = piece_spans(text, limit, overlap)
    if len(text) <= limit:
        assert spans == ([(0, len(text), False)] if text else [])
        return spans
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(spans, spans[1:]):
        assert c == max(0, b - overlap) and b < d
    assert all(0 < b - a <= limit for a, b, _ in spans)
    return spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abc .,\n。́")), max_size=300), st.integers(2, 40), st.integers(0, 10))
def test_any_text(text, limit, overlap):
    check(text, limit, min(overlap, limit - 1))


def test_natural_boundaries_come_first():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    text = " ".join(w + ("." if i % 11 == 0 else "") for i, w in enumerate(words))
    spans = check(text, 1000, 100)
    assert not any(h for _, _, h in spans)
    assert all(text[b - 1].isspace() for _, b, _ in spans[:-1])
    assert any(h for _, _, h in check("x" * 1500, 1000, 100))
    assert not any(h for _, _, h in check("x" * 890 + " " + "y" * 890, 1000, 100))


def test_glyphs_stay_whole():
    text = "é" * 1200
    assert all(text[b] != "́" for _, b, _ in check(text, 1000, 100)[:-1])


def test_long_glyphs_stay_whole():
    text = "x" * 500 + "a" + "\u0301" * 300 + "x" * 500
    assert [b for _, b, _ in check(text, 1000, 100)] == [500, 1301]
    assert all(h for _, _, h in check("x" * 1500, 1000, 100)[:-1])
    # Cut, but no longer than a piece may be.
    assert not any(h for _, _, h in check("x" * 950 + " " + "y" * 400, 1000, 100))


def test_bad_parameters():
    with pytest.raises(ValueError):
        piece_spans("x" * 50, 10, 10)


def test_table(spark):
    rows = [(1, None, 1, "p"), (2, "", 1, "p"), (3, "x" * 1000, 1, "p"), (4, "word " * 400, None, "p"), (4, "word " * 400, None, "p")]
    got = pieces(spark.createDataFrame(rows, "entry_id bigint, text string, chapter int, piece string"), "entry_id", ["chapter"]).collect()
    assert {r.entry_id for r in got} == {4} and all(r.chapter is None for r in got)
    assert all(r.piece_text == ("word " * 400)[r.piece_start : r.piece_end] and len(r.piece_text) <= 1000 for r in got)
    assert pieces(spark.createDataFrame([], "entry_id bigint, text string, chapter int"), "entry_id", ["chapter"]).count() == 0
