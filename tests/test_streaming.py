import random

from pyspark.sql import functions as F

from loomtext.operators.matching import FORGET_AFTER, LOCK_AFTER
from loomtext.operators.turns import converse
from loomtext.streaming import trace as R


def files(spark, tmp_path, rows, schema, parts=4):
    """Rows as parquet files that a stream reads one by one."""
    path = str(tmp_path / "in")
    for i in range(parts):
        spark.createDataFrame(rows[i::parts] if parts > 1 else rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def in_order(spark, tmp_path, rows, schema, size):
    path = str(tmp_path / "in")
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_turns_as_a_stream(spark, tmp_path):
    rng = random.Random(6)
    lines = [(f"s{k}", i, i // 2, rng.choice(["DIALOGUE", "DIALOGUE", "NARRATION"]), rng.choice(["A", "B", None, None])) for i in range(40) for k in range(2)]
    lines = [(k, i, p, kind, s if kind == "DIALOGUE" else None) for k, i, p, kind, s in lines]
    stream = in_order(spark, tmp_path, lines, "session_id string, at bigint, paragraph int, kind string, speaker string", 24)
    got = {(r.session_id, r.at): r.speaker for r in R.drained(spark, R.turn_stream(stream)).collect()}
    for k in ("s0", "s1"):
        mine = [x for x in lines if x[0] == k]
        want = [f[0] if f else s for f, (*_, s) in zip(converse([(p, kind, s) for _, _, p, kind, s in mine]), mine)]
        assert [got[k, i] for _, i, *_ in mine] == want


def test_lock_as_a_stream(spark, tmp_path):
    rng = random.Random(7)
    hits = [("s", i, rng.choice([["a"], ["a", "b"], ["b"], []]) if i < 30 else []) for i in range(45)]
    stream = in_order(spark, tmp_path, hits, "session_id string, at bigint, books array<string>", 15)
    got = [r.locked for r in R.drained(spark, R.lock_stream(stream)).orderBy("at").collect()]
    locked, misses, streak, want = None, 0, {"a": 0, "b": 0}, []
    for _, _, books in hits:
        if locked:
            misses = 0 if locked in books else misses + 1
            if misses >= FORGET_AFTER:
                locked, misses, streak = None, 0, {"a": 0, "b": 0}
        else:
            streak = {b: streak[b] + 1 if b in books else 0 for b in streak}
            ready = [b for b in books if streak[b] >= LOCK_AFTER]
            locked = ready[0] if ready else None
            misses = 0
        want.append(locked)
    assert got == want and any(want) and want[-1] is None


def test_windows_duplicates_and_resume(spark, tmp_path):
    rows = [(f"k{i % 3}", i, 1_700_000_000 + 60 * i) for i in range(30)] + [("k0", 0, 1_700_000_000)]
    schema = "k string, i int, s bigint"
    stream = files(spark, tmp_path, rows, schema).withColumn("t", F.timestamp_seconds("s"))
    once = R.drained(spark, R.once(stream, "t", ["k", "i"], "10 days").select("k", "i"))
    assert once.count() == 30
    table = spark.createDataFrame(rows, schema).withColumn("t", F.timestamp_seconds("s"))
    counts = R.windows(table, "t", ["k"], "10 minutes", n=F.count("*"))
    assert sum(r.n for r in counts.collect()) == 31
    counted = R.drained(spark, R.windows(stream, "t", ["k"], "10 minutes", late="1 hour", n=F.count("*")), mode="complete")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, counts.collect()))
    assert {r.n for r in R.sessions(table.where("k = 'k1'"), "t", ["k"], "2 minutes").collect()} == {1}
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        R.resumable(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, state, lambda b: b.select("k", "i"))
    assert spark.read.parquet(out).count() == 31


def test_two_streams_meet(spark, tmp_path):
    schema = "k string, v int, s bigint"
    left = files(spark, tmp_path / "l", [("a", 1, 100), ("b", 2, 100)], schema, 1).withColumn("t", F.timestamp_seconds("s"))
    right = files(spark, tmp_path / "r", [("a", 5, 103), ("a", 6, 130), ("b", 7, 90)], schema, 1).withColumn("t", F.timestamp_seconds("s"))
    met = R.drained(spark, R.joined_streams(left, right, ["k"], "t", "t", "10 seconds", "1 hour"))
    assert [(r.k, r.v, r.right_v) for r in met.collect()] == [("a", 1, 5)]
