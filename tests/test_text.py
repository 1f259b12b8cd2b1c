import random

from pyspark.sql import functions as F

from loomtext.functions import names as N
from loomtext.functions import text as T
from loomtext.operators.ordered import last_known, neighbour, running_sum
from loomtext.operators.scenes import scenes, split_scene, with_scenes
from loomtext.operators.segments import paragraphs, segments


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_index_sentences(spark):
    def cut(t):
        return one(spark, t, T.index_sentences)

    assert cut("Mr. Hart left. She stayed.") == ["Mr. Hart left.", "She stayed."]
    assert cut('"Go." He went!  Yes?') == ['"Go." He went!', "Yes?"]
    assert cut('"Mr. Hart" is. Dr.') == ['"Mr.', 'Hart" is.', "Dr."]
    assert cut("  ") == [] and cut("no end") == ["no end"]


def test_normal_form(spark):
    assert one(spark, "“Don't—stop,” SHE said…  ΟΔΟΣ", T.normal_form) == "don't stop she said οδοσ"
    assert one(spark, "ﬁn Ａｂ", lambda c: T.normal_form(T.compatible(c))) == "fin ab"


def fnv(text):
    h = 0xCBF29CE484222325
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2])) * 0x100000001B3) % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


def test_fnv(spark):
    for t in ("", "a", "it was late", "ёлка", "日本", "👩x"):
        assert one(spark, t, T.fnv64) == fnv(t)


def test_names(spark):
    def tag(before, after):
        return spark.createDataFrame([(before, after)], "b string, a string").select(N.tag_name(F.col("b"), F.col("a")).alias("x")).first().x

    assert tag("", " said Sarah.") == "Sarah" and tag("", " Sarah said quietly.") == "Sarah" and tag("Sarah said, ", "") == "Sarah"
    assert tag("", " said The.") is None and tag("", " said Mrs. Hart Then.") == "Mrs. Hart" and tag("", " nothing") is None
    assert one(spark, "She spoke to Anna, and Sarah Hart saw Tom.", N.names_in) == ["Sarah Hart", "Tom"]
    assert one(spark, "Then Tom. Tom again", N.names_in) == ["Then Tom", "Tom"]
    assert one(spark, 'He "said so" and «left» “open', N.without_quoted) == "He   and    "
    assert one(spark, "She took his hat", N.pronoun_gender) is None and one(spark, "she left", N.pronoun_gender) == "FEMALE"
    assert one(spark, "Ann and Sue saw her", lambda c: N.nearest_name(c, N.names_in(c), N.pronoun_gender(c))) == "Sue"


def test_segments(spark):
    def runs(t):
        rows = spark.createDataFrame([("b", 1, 0, t)], "book_id string, chapter int, seq int, text string")
        return [(r.n, r.kind[0], r.run, r.before, r.after) for r in segments(rows).orderBy("n").collect()]

    assert runs('"Hi," he said, "go."') == [(0, "D", '"Hi,"', "", ' he said, "go."'), (1, "N", "he said,", '"Hi,"', '"go."'), (2, "D", '"go."', '"Hi," he said, ', "")]
    assert [r[:3] for r in runs('Six" tall “and open')] == [(0, "N", 'Six" tall'), (1, "D", "“and open")]
    assert [r[:3] for r in runs("—Late —she said")] == [(0, "D", "—Late"), (1, "N", "—she said")]
    assert [r[:3] for r in runs('"a" "b"')] == [(0, "D", '"a"'), (2, "D", '"b"')]
    assert len(runs("x" * 200_000 + ' "y"')) == 2


def test_paragraphs_keep_one_of_reloaded(spark):
    rows = [(2, "b", 1, " late ", 1), (1, "b", 1, " first", 1), (3, "b", 2, "  ", 1), (4, None, 2, "x", 1), (5, "b", 3, None, 1)]
    got = paragraphs(spark.createDataFrame(rows, "entry_id bigint, book_id string, seq int, text string, chapter int")).collect()
    assert [(r.book_id, r.seq, r.text, r.lead) for r in got] == [("b", 1, "first", 1)]


def test_ordered_against_plain_loops(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([None, 1, 2, 3])) for k in ("x", "y", None) for i in rng.sample(range(60), 25)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for block in (4, 1000):
        sums = {(r.k, r.i): r.s for r in running_sum(df, ["k"], "i", F.col("v"), "s", block=block).collect()}
        last = {(r.k, r.i): r.s for r in last_known(df, ["k"], "i", F.col("v"), "s", block=block).collect()} if block else {}
        upto = {(r.k, r.i): r.s for r in last_known(df, ["k"], "i", F.col("v"), "s", block=block, before=False).collect()}
        after = {(r.k, r.i): r.s for r in neighbour(df, ["k"], "i", F.col("v"), "s", block=block).collect()}
        back = {(r.k, r.i): r.s for r in neighbour(df, ["k"], "i", F.col("v"), "s", step=-1, block=block).collect()}
        for key in ("x", "y", None):
            seq = sorted((i, v) for k, i, v in rows if k == key)
            total, known = 0, None
            for j, (i, v) in enumerate(seq):
                if key is not None:
                    assert last[key, i] == known
                total += v or 0
                known = v if v is not None else known
                if key is not None:
                    assert (sums[key, i], upto[key, i]) == (total, known)
                    assert after[key, i] == (seq[j + 1][1] if j + 1 < len(seq) else None)
                    assert back[key, i] == (seq[j - 1][1] if j else None)


def test_scenes(spark):
    texts = ["a", "***", "* *", "b", "c", "d"]
    rows = [("b", 1 if i < 5 else 2, i, t) for i, t in enumerate(texts)] + [("c", 1, i, "x") for i in range(7)]
    paras = spark.createDataFrame(rows, "book_id string, chapter int, seq int, text string")
    got = {(r.book_id, r.scene_start): (r.scene_end, r.paragraphs) for r in scenes(paras, most=3).collect()}
    assert got == {("b", 0): (3, 3), ("b", 3): (5, 2), ("b", 5): (6, 1), ("c", 0): (3, 3), ("c", 3): (6, 3), ("c", 6): (7, 1)}
    assert with_scenes(paras, most=3).count() == 13


def test_split_scene():
    def cut(n, budget, boundary, talks, speakers):
        return [(p.start, p.end, p.carried, p.at_turn) for p in split_scene(range(n), n, [1] * n, boundary, talks, speakers, budget)]

    assert cut(7, 5, [i in (0, 5) for i in range(7)], [True] * 7, ["Ann"] * 3 + ["Robert"] * 4) == [(0, 5, None, True), (5, 7, "Robert", True)]
    assert cut(5, 3, [i in (0, 2) for i in range(5)], [True] * 5, [None] * 5) == [(0, 2, None, True), (2, 5, None, True)]
    assert cut(4, 2, [i == 0 for i in range(4)], [True] * 4, [None] * 4) == [(0, 2, None, True), (2, 4, None, False)]
    assert cut(3, 0, [True] * 3, [True] * 3, ["x", None, "y"]) == [(0, 1, None, True), (1, 2, "x", True), (2, 3, None, True)]
