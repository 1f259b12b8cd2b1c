import random

from pyspark.sql import functions as F

from loomtext.operators import audio as U
from loomtext.operators import casting as C
from loomtext.operators import sampling as P


def test_all_present_differ():
    people = [(w, (4, 9)) for w in ("a", "b", "c")]
    near = {x: {y for y, _ in people if y != x} for x, _ in people}
    found = C.assign(people, near)
    assert len(set(found.values())) == 3
    assert C.assign(people, near, {"a": (9, 1.0)})["a"] == (9, 1.0)
    assert C.assign([("x", ())], {}) == {"x": (0, 1.0)}
    assert C.assign([("x", (1, 2, 3))], {}) == {"x": (2, 1.0)}


def test_no_neighbours_share_voice_and_rate():
    rng = random.Random(2)
    people = [(f"c{i}", tuple(range(rng.randint(1, 6)))) for i in range(30)]
    near: dict[str, set[str]] = {}
    for _ in range(80):
        a, b = rng.sample(range(30), 2)
        near.setdefault(f"c{a}", set()).add(f"c{b}")
        near.setdefault(f"c{b}", set()).add(f"c{a}")
    found = C.assign(people, near)
    assert all(found[a] != found[b] for a in near for b in near[a])


def test_blend_plan(spark):
    rows = [(1, 100.0, "male", None), (2, 120.0, "male", "poor"), (3, 140.0, "male", None), (4, 200.0, "female", None), (5, None, "male", None), (6, 150.0, "unclear", None)]
    pool = C.without_poor(C.pools(spark.createDataFrame(rows, "speaker int, f0_hz double, voice string, quality string")))
    people = spark.createDataFrame([("MALE", 115.0), ("MALE", 10.0), ("MALE", 999.0), ("FEMALE", 1.0), ("NEUTRAL", 150.0), ("MALE", None)], "gender string, target_hz double")
    got = {(r.gender, r.target_hz): (r.parent_a, r.parent_b, r.fraction) for r in C.blend_plan(people, pool).collect()}
    assert got[("MALE", 115.0)] == (1, 3, 0.375) and got[("MALE", 10.0)] == (1, 1, 0.0) and got[("MALE", 999.0)] == (3, 3, 0.0)
    assert got[("FEMALE", 1.0)] == (4, 4, 0.0) and got[("NEUTRAL", 150.0)][0] is None and got[("MALE", None)][0] is None


def arrays(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} array<double>" for k in cols))


def test_kernels(spark):
    one = arrays(spark, a=[0.5, -0.5, 0.5], b=[0.0, 1.0, 0.0, 1.0], z=[0.0, 0.0], e=[])
    a, b, z, e = map(F.col, "abze")
    r = one.select(
        U.rms(a).alias("rms"), U.dbfs(z).alias("silent"), U.loudness(z).alias("kept"), U.crossfade(a, b, F.lit(2)).alias("x"), U.crossfade(a, e, F.lit(2)).alias("xe"),
        U.stretch(b, F.lit(2.0)).alias("fast"), U.stretch(b, F.lit(1.0)).alias("same"), U.pcm16(F.array(F.lit(2.0), F.lit(-0.5))).alias("pcm"), C.blend(z, F.array(F.lit(10.0), F.lit(10.0)), F.lit(0.3)).alias("mix"),
        U.with_silence(F.array(a, z), 1).alias("joined"), U.softmax_best(b).alias("best"),
    ).first()
    assert r.rms == 0.5 and r.silent is None and r.kept == [0.0, 0.0]
    assert [round(v, 6) for v in r.x] == [0.5, round(-0.5 * 2 / 3, 6), round(0.5 / 3 + 2 / 3, 6), 0.0, 1.0] and r.xe == [0.5, -0.5, 0.5]
    assert r.fast == [0.0, 0.0] and r.same == [0.0, 1.0, 0.0, 1.0] and r.pcm == [32767, -16383] and r.mix == [3.0, 3.0]
    assert r.joined == [0.5, -0.5, 0.5, 0.0, 0.0, 0.0] and r.best.best == 1


def test_timings(spark):
    rows = spark.createDataFrame([(1, "no punctuation here", 1000), (2, "  ", 500), (3, "Hi. You!", 0), (4, "Ab cd. Ef!", 100), (5, None, 9)], "k int, t string, ms int")
    got = {k: sorted((r.char_start, r.char_end, r.kind, r.start_ms, r.end_ms) for r in rs) for k, rs in by(U.timings(rows, "k", "t", F.col("ms")).collect()).items()}
    assert [(s, e) for s, e, kind, *_ in got[1] if kind == "SENTENCE"] == [(0, 19)] and sum(kind == "WORD" for _, _, kind, *_ in got[1]) == 3
    assert set(got) == {1, 4}
    assert got[4] == [(0, 2, "WORD", 0, 24), (0, 6, "SENTENCE", 0, 62), (3, 6, "WORD", 24, 62), (7, 10, "SENTENCE", 62, 100), (7, 10, "WORD", 62, 100)]


def by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.k, []).append(r)
    return out


def test_passages_apart(spark):
    rows = spark.createDataFrame([("b", 0, 4), ("b", 2, 5), ("b", 4, 9), ("b", 8, 10), ("c", 1, 2)], "k string, from_place int, to_place int")
    assert sorted(tuple(r) for r in P.apart(rows, ["k"]).collect()) == [("b", 0, 4), ("b", 4, 9), ("c", 1, 2)]
    spots = spark.createDataFrame([("b", i) for i in (0, 1, 1, 9, 10)], "k string, seq int")
    assert sorted(tuple(r) for r in P.natural_passages(spots, ["k"], "seq", 2, 3).collect()) == [("b", 0, 2), ("b", 1, 2), ("b", 9, 11)]
