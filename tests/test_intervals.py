import random

import pytest

from loomtext.operators.intervals import periods_and_gaps

SCHEMA = "book string, seq int, a int, b int, what string, p_start string"


def brute(rows):
    out = []
    for key in {(r[0], r[1]) for r in rows}:
        covered = {p for r in rows if (r[0], r[1]) == key and r[2] is not None and r[3] is not None for p in range(r[2], r[3])}
        if not covered:
            continue
        inside, start = False, None
        for p in range(min(covered), max(covered) + 2):
            if (p in covered) != inside:
                if start is not None:
                    out.append((*key, "period" if inside else "gap", start, p))
                inside, start = not inside, p
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [3, 4096])
def test_against_brute_force(spark, block):
    rng = random.Random(7)
    rows = [
        (rng.choice(["x", "y", None]), rng.choice([1, 2, None]), rng.choice([None, *range(-5, 40)]), rng.choice([None, *range(-5, 40)]), "w", "q")
        for _ in range(60)
    ]
    rows += rows[:10]
    got = periods_and_gaps(spark.createDataFrame(rows, SCHEMA), ("book", "seq"), "a", "b", block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_nothing_covers(spark):
    rows = [("x", 1, 5, 5, "", ""), ("x", 1, 9, 2, "", ""), ("x", 1, 3, None, "", ""), ("x", 1, None, 3, "", "")]
    assert periods_and_gaps(spark.createDataFrame(rows, SCHEMA), ("book", "seq"), "a", "b").count() == 0
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA), ("book", "seq"), "a", "b").count() == 0


def test_touching_is_continuous_and_types_stay(spark):
    got = periods_and_gaps(spark.createDataFrame([("x", 1, 0, 5, "", ""), ("x", 1, 5, 9, "", "")], SCHEMA), ("book", "seq"), "a", "b")
    assert dict(got.dtypes)["p_start"] == "int"
    assert [tuple(r) for r in got.collect()] == [("x", 1, "period", 0, 9)]
