from loomtext.operators.badrows import HOST_TRACE, SPEAKER_LABELS, failed, loaded, parse_lines

BOOK = "dd4991d24e82669f"


def lines(spark, raws):
    rows = [(i, raw, "x", "y", "z") for i, raw in enumerate(raws)]
    return spark.createDataFrame(rows, "line_id bigint, raw_line string, reason string, cells string, k string")


def reasons(spark, layout, raws):
    return {r.line_id: r.reason for r in parse_lines(lines(spark, raws), layout).collect()}


def test_labels(spark):
    good = f'{BOOK},9,1,DIALOGUE,"A, B",.75,"She said ""no""\nand left."'
    raws = [
        good,
        f'{BOOK},9,2,NARRATION,"narrator" ",0.3,CHAPTER I',
        f'{BOOK},9,2,NARRATION,,0.3,He said "no" again',
        f'{BOOK},9,2,NARRATION,,0.3,"unclosed',
        f"{BOOK},9,2,NARRATION,,0.3",
        f"{BOOK},9,2,NARRATION,,0.3,one, two",
        f"{BOOK},0,2,NARRATION,,0.3,text",
        f'{BOOK},9,2,NARRATION,,"0,85",text',
        f"{BOOK},9,2,NARRATION,,1.01,text",
        f"{BOOK},9,2,narration,,1,text",
        f"{BOOK},9,2,NARRATION,,1, ",
        f"{BOOK},9,2,NARRATION,,1,bad�text",
        f"{BOOK}, 9 ,2,NARRATION,,1,text\r",
        "c0,c1,c2,c3,c4,c5,c6",
        "# note",
        "   ",
        "",
        None,
        f"{BOOK.upper()},9,2,NARRATION,,1,text",
        f"{BOOK},९,2,NARRATION,,1,text",
    ]
    got = reasons(spark, SPEAKER_LABELS, raws)
    assert got == {
        0: None, 1: "quoting", 2: "quoting", 3: "quoting", 4: "columns", 5: "columns", 6: "value", 7: "value",
        8: "value", 9: "value", 10: "value", 11: "value", 12: None, 18: "value", 19: "value",
    }
    row = loaded(parse_lines(lines(spark, raws[:1]), SPEAKER_LABELS), SPEAKER_LABELS).first()
    assert tuple(row) == (0, BOOK, 9, 1, "DIALOGUE", "A, B", 0.75, 'She said "no"\nand left.')
    assert failed(parse_lines(lines(spark, [f"{BOOK},0,x,NARRATION,,2,t"]), SPEAKER_LABELS)).first().bad == ["chapter", "seq", "confidence"]


def test_trace(spark):
    ok = ["19:46:19.371", "44", "79", "12", "100", "100", "eng-GBR", "en-GB", "10044", ' "Quotes" mean nothing,']
    def but(**at):
        return "\t".join(at.get(f"f{i}", v) for i, v in enumerate(ok))
    raws = [but(), but(f0="24:00:00.000"), but(f1=" 44 "), but(f2="1e3"), but(f6="en_GB"), but(f7="  "), but(f9=" \x0b "), but() + "\tmore", "wall\tx", but(f1="9" * 30), but() + "\r", but(f9="a\nb")]
    assert reasons(spark, HOST_TRACE, raws) == {0: None, 1: "value", 2: None, 3: "value", 4: "value", 5: "value", 6: "value", 7: "columns", 9: None, 10: None, 11: "value"}
    rows = loaded(parse_lines(lines(spark, raws), HOST_TRACE), HOST_TRACE).collect()
    assert {r.line_id: (r.utterance, r.text) for r in rows}[0] == (44, ' "Quotes" mean nothing,')
    assert {r.line_id: r.utterance for r in rows}[9] is None


def test_any_character_comes_through(spark):
    odd = "a\ufdd0b\ufdd1\ue000c"
    row = loaded(parse_lines(lines(spark, [f'{BOOK},1,1,NARRATION,,1,"{odd}\nd"', f"{BOOK},1,1,NARRATION,,1,{odd}"]), SPEAKER_LABELS), SPEAKER_LABELS).collect()
    assert [r.sentence for r in sorted(row)] == [odd + "\nd", odd]


def test_long_text_and_empty_table(spark):
    long = f"{BOOK},1,1,NARRATION,,1," + "x" * 3_000_000
    assert reasons(spark, SPEAKER_LABELS, [long, long]) == {0: None, 1: None}
    assert reasons(spark, SPEAKER_LABELS, []) == {}
