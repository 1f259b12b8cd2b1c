import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.sources import books as B
from loomtext.sources import fixtures as X
from loomtext.sources import manifests as M
from loomtext.sources import sinks as K


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_html():
    page = "<html><head><title>T</title></head><body><h1>One</h1><p>a <b>b</b>&amp;c<p>d<script>x</p></script><blockquote><p>q</p> r</blockquote><p> </p></body></html>"
    assert B.html_blocks(page) == ["One", "a b&c", "d", "q r", "q"]


def test_epub(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(B.epub_bytes("T", [["CHAPTER I", "It < was."], [], ["End."]]))
    rows = B.read_epubs(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.locator, r.text, r.chapter) for r in rows] == [("c0.xhtml#p0", "CHAPTER I", 0), ("c0.xhtml#p1", "It < was.", 0), ("c2.xhtml#p2", "End.", 2)]
    with pytest.raises(ValueError):
        import io
        import zipfile

        z = io.BytesIO()
        zipfile.ZipFile(z, "w").close()
        B.epub_paragraphs(z.getvalue())


def test_plain_texts(spark, tmp_path):
    text = "Title\n\nCHAPTER I\n\nIt was\nlate.\n \nVOLUME II\n\nCHAPTER II\n\nEnd."
    put(tmp_path / "n" / "novel.txt", text)
    paras = B.read_paragraphs(spark, str(tmp_path / "n"))
    rows = paras.orderBy("idx").collect()
    assert [r.text for r in rows] == ["Title", "CHAPTER I", "It was late.", "VOLUME II", "CHAPTER II", "End."]
    assert all(text[r.start : r.end].replace("\n", " ") == r.text for r in rows)
    assert [(r.text, r.chapter) for r in B.text_chapters(paras).orderBy("idx").collect()] == [("It was late.", 0), ("End.", 1)]
    plain = spark.createDataFrame([("p", 0, "a"), ("p", 1, "PART b")], "path string, idx int, text string")
    assert B.text_chapters(plain).count() == 2


def test_library_and_names(spark, tmp_path):
    put(tmp_path / "a" / "index.db", "x"), put(tmp_path / "a" / "b.epub", "x"), put(tmp_path / "c" / "b.epub", "x")
    assert {tuple(r) for r in B.library(spark, str(tmp_path)).collect()} == {("a", True, False), ("c", False, True)}
    assert B.file_name("a b/ü-1") == "a%20b%2Fü-1.characters.json" and B.identifier_of(B.file_name("a b/ü-1")) == "a b/ü-1"


def test_fixtures(spark, tmp_path):
    p = put(tmp_path / "l.tsv", '# note\n# cast: Sarah=female, Tom = MALE, X=?\nSarah|UNKNOWN\t"a" b "c"\n\nNARRATION\tText\twith tab\n')
    assert [(r.gold, r.text) for r in X.labelled_passages(spark, p).orderBy("i").collect()] == [(["Sarah", "UNKNOWN"], '"a" b "c"'), (["NARRATION"], "Text\twith tab")]
    assert {(r.name, r.gender) for r in X.declared_cast(spark, p).collect()} == {("Sarah", "FEMALE"), ("Tom", "MALE"), ("X", "UNKNOWN")}
    assert [(r.seq, r.speaker) for r in X.slice_labels(spark, p).orderBy("seq").collect()] == [(0, "Sarah|UNKNOWN"), (1, None)]
    with pytest.raises(Exception, match="no tab"):
        X.labelled_passages(spark, put(tmp_path / "bad.tsv", "oops\n")).collect()
    v = put(tmp_path / "v.tsv", "# x\nspeaker\tf0_hz\tvoice\n1\t120.5\tmale\n2\tx\tmale\n3\t150\tunclear\n")
    assert [tuple(r) for r in X.pitch_profile(spark, v).collect()] == [(1, 120.5, "male")]
    assert [r.speaker for r in X.poor_voices(spark, put(tmp_path / "q.tsv", "speaker\tquality\n7\tpoor\tnoise\n8\tgood\n")).collect()] == [7]
    a = put(tmp_path / "a.tsv", "# x\nq1\tSarah\ttag\nq2\t\t\nq3\tTom\n")
    assert {tuple(r) for r in X.answers(spark, a, "me").collect()} == {("q1", "Sarah", "tag"), ("q3", "Tom", "me")}
    e = put(tmp_path / "e.tsv", "locator\tkind\tspeaker\tconfidence\ttier\ttext\na\tPARAGRAPH\t\t0\t\tp one\na#s0\tDIALOGUE\tS\t0.9\tX\tone\nb\tPARAGRAPH\t\t\t\tp two\n")
    assert [(r.group, r.kind, r.speaker) for r in X.attributed_export(spark, e).orderBy("i").collect()] == [(1, "PARAGRAPH", None), (1, "DIALOGUE", "S"), (2, "PARAGRAPH", None)]
    t = put(tmp_path / "t" / "t.tsv", "wall\tutterance\tgapMs\tchars\trate\tpitch\tlocale\tvoice\tcallerUid\ttext\n1:00\t1\t0\t3\t100\t100\teng-GBR\ten\t9\t hi \"there\n")
    assert X.host_trace(spark, t).first().text == ' hi "there'


def test_rejected_lines_are_kept(spark, tmp_path):
    t = put(tmp_path / "t" / "t.tsv", "wall\tutterance\tgapMs\tchars\trate\tpitch\tlocale\tvoice\tcallerUid\ttext\n1:00\t1\t0\t3\t100\t100\teng-GBR\ten\t9\tok\n1:00\tx\t0\n")
    assert X.host_trace(spark, t).count() == 1 and [r.line for r in X.host_trace(spark, t, rejected=True).collect()] == ["1:00\tx\t0"]
    c = put(tmp_path / "q.csv", 'a,b\n1,"x\ny"\n2\n')
    assert [tuple(r) for r in X.quoted_csv(spark, c).collect()] == [("1", "x\ny")] and X.quoted_csv(spark, c, rejected=True).first().line.strip() == "2"


def test_corpus(spark, tmp_path):
    c = put(tmp_path / "q.csv", 'quoteID,quoteText,speaker,quoteType,quoteByteSpans\nQ1,"He said ""no""\nand left",Ann,nan,"[[1, 5], [9,12]]"\nQ2,,Bob,Explicit,\nbad,row\n')
    r = X.gold_quotations(spark, c).collect()
    assert [(x.id, x.text, x.type, [tuple(s) for s in x.spans]) for x in r] == [("Q1", 'He said "no" and left', "Unspecified", [(1, 5), (9, 12)])]
    n = put(tmp_path / "n.csv", "Folder Name,Novel Title,Narrative Person,Translator Code,Genre,Year of First Publication\nA,Ta,1st,Y,,1850\nB,Tb,,,Gothic,x\n")
    assert {tuple(r) for r in X.novel_index(spark, n).collect()} == {("A", "Ta", 1, True, "unknown", 1850), ("B", "Tb", 3, False, "Gothic", 0)}
    i = put(tmp_path / "c.csv", "Main Name,Aliases,Gender,Category\nAnn,\"{'Miss A', 'Ann'}\",F,major\n")
    assert X.character_info(spark, i).first().aliases == ["Ann", "Miss A"]


GOOD = {"schemaVersion": 1, "bookId": "b", "generatedAt": 5, "mood": {"x": [1]}, "tag": "a \"b\"", "narrator": {"id": "n", "displayName": "N", "gender": "NEUTRAL"}, "characters": [{"id": "s", "displayName": "S", "aliases": ["she"], "confidence": 0.5, "lineCount": 2}]}


def test_manifest(spark):
    df = M.decoded(spark.createDataFrame([(json.dumps(GOOD),)], "json string"))
    back = json.loads(df.select(M.encoded(F.col("manifest"), F.col("extras")).alias("j")).first().j)
    assert back["mood"] == {"x": [1]} and back["tag"] == 'a "b"' and back["narrator"]["gender"] == "neutral" and back["characters"][0]["aliases"] == ["she"]
    assert list(back)[:3] == ["schemaVersion", "bookId", "generatedAt"]
    for change, message in (({"schemaVersion": 2}, "schemaVersion"), ({"narrator": None}, "narrator"), ({"characters": [GOOD["characters"][0]] * 2}, "duplicate"), ({"characters": [{"id": "s", "confidence": 2}]}, "confidence"), ({"bookId": None}, "bookId")):
        with pytest.raises(Exception, match=message):
            M.decoded(spark.createDataFrame([(json.dumps(GOOD | change),)], "json string")).select("manifest").collect()
    with pytest.raises(Exception, match="not a JSON object"):
        M.decoded(spark.createDataFrame([("[1]",)], "json string")).select("manifest").collect()


def test_wav(spark, tmp_path):
    x = np.array([0.0, 0.5, -1.0, 2.0])
    content = M.wav_bytes(x, 8000)
    (tmp_path / "a.wav").write_bytes(content)
    r = M.read_wavs(spark, str(tmp_path)).first()
    assert r.rate == 8000 and np.allclose(r.pcm, [0, 0.5, -1, 1], atol=1e-4)
    odd = content[:36] + b"note" + (3).to_bytes(4, "little") + b"abc\0" + content[36:]
    assert np.allclose(M.wav_samples(odd)[0], r.pcm)
    for bad in (b"RIFX" + content[4:], content[:36], content[:22] + b"\2\0" + content[24:]):
        with pytest.raises(ValueError):
            M.wav_samples(bad)


def test_index_replaces_books_only(spark, tmp_path):
    path = str(tmp_path / "index")

    def tables(rows):
        books = spark.createDataFrame([(b, 1) for b in {r[0] for r in rows}], "book_id string, schema_version int")
        entries = spark.createDataFrame(rows, "book_id string, seq int, text string")
        return books, entries, entries.selectExpr("book_id", "seq", "0 ordinal"), entries.selectExpr("book_id", "1L prefix_hash", "seq")

    K.write_index(path, *tables([("a", 0, "x"), ("b", 0, "y")]))
    K.write_index(path, *tables([("a", 0, "z"), ("a", 1, "w")]))
    assert {(r.book_id, r.text) for r in spark.read.parquet(f"{path}/entries").collect()} == {("a", "z"), ("a", "w"), ("b", "y")}
    with pytest.raises(ValueError):
        K.write_index(path, spark.createDataFrame([("a", 9)], "book_id string, schema_version int"), *tables([("a", 0, "q")])[1:])


def test_exports(spark, tmp_path):
    lines = spark.createDataFrame([("b", 1, 0, None, "t\tx", "l", "NARRATION", 0.5, "NONE"), ("b", 0, 0, "S", "u", "l", "DIALOGUE", 1.0, "X")], "book_id string, seq int, n int, speaker string, text string, locator string, kind string, confidence double, tier string")
    K.attributed_tsv(lines, str(tmp_path / "t"))
    header = "locator\tkind\tspeaker\tconfidence\ttier\ttext"
    assert {r.value for r in spark.read.text(str(tmp_path / "t")).collect()} == {header, "l\tNARRATION\t\t0.50\tNONE\tt x", "l\tDIALOGUE\tS\t1.00\tX\tu"}
    assert {(r.kind, r.speaker, r.text) for r in X.attributed_export(spark, str(tmp_path / "t")).collect()} == {("NARRATION", None, "t x"), ("DIALOGUE", "S", "u")}
    script = json.loads(K.script_json(lines, ["book_id"]).first().script)
    assert [x["text"] for x in script["lines"]] == ["u", "t\tx"] and "speaker" not in script["lines"][1]
    K.bakeoff_dump(str(tmp_path / "d"), lines, lines, lines, lines)
    assert "speaker" not in spark.read.json(str(tmp_path / "d" / "questions")).columns
    assert "t" in K.report(lines.select("text"), "Texts")
    K.replace_file(str(tmp_path / "f" / "x"), b"1"), K.replace_file(str(tmp_path / "f" / "x"), b"2")
    assert (tmp_path / "f" / "x").read_bytes() == b"2" and len(list((tmp_path / "f").iterdir())) == 1
