"""Queries that must do the whole job, on small tables of their own."""

from loomtext.plans.catalog import CATALOG

ENTRIES = "entry_id bigint, book_id string, chapter int, seq int, text string"
TRACE = "chunk_id bigint, session_id string, book_id string, utterance int, text string"
CAST = "rec_id bigint, book_id string, char_id string, display_name string, aliases array<string>"


def run(spark, folder, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return CATALOG.queries[name](spark, str(folder)).collect()


def library():
    texts = ["It was late.", "Sarah looked up.", "He left the room.", "Nothing more was said.", "It rained."]
    books = {"old": texts, "new": texts, "one": ["It was late.", "Other words.", "He left the room."]}
    entries = [(b, i, t) for b, ts in books.items() for i, t in enumerate(ts)]
    chunks = [("s", None, 0, texts[0]), ("s", None, 1, "nowhere"), *(("s", "one", i + 2, t) for i, t in enumerate(texts)), ("t", "one", 0, texts[0]), ("t", "one", 2, "Other words."), ("t", None, 5, texts[2])]
    return {
        "entries": ([(i, b, 1, s, t) for i, (b, s, t) in enumerate(entries)], ENTRIES),
        "host_trace": ([(i, *c) for i, c in enumerate(chunks)], TRACE),
        "books": ([("old", 1), ("new", 2), ("one", 3)], "book_id string, indexed_at bigint"),
    }


def test_identify_lock_over_all_books(spark, tmp_path):
    got = run(spark, tmp_path, "identify_lock", **library())
    assert {(r.session_id, r.book_id, r.locked_at) for r in got} == {("s", "new", 4), ("t", "one", 5)}


def test_stream_lock_over_all_books(spark, tmp_path):
    got = run(spark, tmp_path, "stream_lock", **library())
    assert sorted((r.session_id, r.at, r.locked) for r in got if r.locked) == [("s", 4, "new"), ("s", 5, "new"), ("s", 6, "new"), ("t", 5, "one")]


def test_alias_mentions_of_any_length(spark, tmp_path):
    cast = [
        (1, "b", "l", "Louisa T. Tarrowfell", ["Lou", "Tarrowfell"]),
        (2, "b", "f", "Fenwargate, Sebastian", None),
        (3, "b", "s", "Saxelthorn & Nethergate Trading Society", ["Nethergate"]),
        (4, "c", "x", None, ["Sebastian"]),
    ]
    texts = ["Louisa T. Tarrowfell met Fenwargate, Sebastian.", "Lou left the Saxelthorn & Nethergate Trading Society, and Tarrowfell wept.", "Nethergate, Nethergate trading society!"]
    entries = [(i, "b", 1, i, t) for i, t in enumerate(texts)] + [(9, "c", 1, 0, "Sebastian, Tarrowfell")]
    got = run(spark, tmp_path, "alias_mentions", manifest_characters=(cast, CAST), entries=(entries, ENTRIES))
    assert {(r.book_id, r.name, r.mentions) for r in got} == {
        ("b", "louisa t tarrowfell", 1), ("b", "fenwargate sebastian", 1), ("b", "saxelthorn nethergate trading society", 1),
        ("b", "lou", 1), ("b", "tarrowfell", 1), ("b", "nethergate", 2), ("c", "sebastian", 1),
    }


def test_lengthened_openers_beyond_six_words(spark, tmp_path):
    texts = [
        "How quiet it was by the weir!", "How quiet it was by the weir, and cold.", "How quiet it was by the mill that night.", "How quiet it was by the mill that day.",
        "Again and again and again and again.", "Again and again and again and again.", "A b c d e f g h i j k l m n o", "A b c d e f g h i j k l m n o p", "One two three four five six.", "One two three four five six seven.", "Alone.",
    ]
    got = run(spark, tmp_path, "lengthened_openers", entries=([(i, "b", 1, i, t) for i, t in enumerate(texts)], ENTRIES))
    forms = ["".join(c for c in t.lower() if c.isalnum() or c == " ").split() for t in texts]
    want = set()
    for i, f in enumerate(forms):
        alone = [k for k in range(1, len(f) + 1) if sum(g[:k] == f[:k] for g in forms) == 1]
        want |= {(i, min(alone))} if alone else set()
    assert {(r.seq, r.words) for r in got} == want and {(7, 16), (9, 7), (10, 1)} <= want


def walked(ups):
    want = set()
    for i, at in ups.items():
        steps, seen = 0, {i}
        while ups.get(at) is not None and at not in seen:
            seen.add(at)
            at, steps = ups[at], steps + 1
        want.add((i, steps, at))
    return want


def test_reference_chains_to_the_end(spark, tmp_path):
    from loomtext.plans.corpus import chain_ends

    ids = {2**k - 1 for k in range(1, 22)} | set(range(1, 60))
    got = run(spark, tmp_path, "reference_chains", orders=([(i,) for i in ids], "o_orderkey bigint"))
    want = walked({i: None if i % 4 == 0 else i // 2 for i in ids})
    assert {(r.id, r.steps, r.root) for r in got} == want and max(s for _, s, _ in want) == 20
    ups = {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: 6, 7: 6, 8: 9, 9: None, 10: 99} | {i: i - 1 for i in range(21, 40)} | {20: 5}
    got = chain_ends(spark.createDataFrame(list(ups.items()), "id bigint, up bigint")).collect()
    assert {(r.id, r.steps, r.root) for r in got} == walked(ups)


def test_canonical_id_by_endings_either_way(spark, tmp_path):
    cast = [(1, "b", "h", "Miss Harriet Fenwarfell", ["Hattie"]), (2, "b", "j", "Jürgen", ["Dr. Jürgen Pellowwick"]), (3, "b", "x", "Old Miss Harriet Fenwarfell", None), (4, "c", "n", "Nobody", None)]
    docs = [("b", ["Harriet Fenwarfell", "Miss Harriet Fenwarfell", "jürgen pellowwick", "Young Hattie", "Nobody", "", None]), ("c", ["Body", "Hattie"])]
    got = run(spark, tmp_path, "canonical_id_join", manifest_characters=(cast, CAST), documents=(docs, "book_id string, cast_names array<string>"))
    assert {(r.book_id, r.said, r.id) for r in got} == {
        ("b", "harriet fenwarfell", "x"), ("b", "miss harriet fenwarfell", "h"), ("b", "jürgen pellowwick", "j"), ("b", "young hattie", "h"), ("c", "body", "n"),
    }


def test_full_join_of_all_customers(spark, tmp_path):
    customers = [(1, 7, 5.0), (2, 7, 9.5), (3, 7, -1.0), (4, 7, 5.0), (5, 8, 1.0), (6, None, 2.0), (7, 7, None), (None, 7, 0.5), (50, 7, 0.0), (51, 9, 0.0)]
    suppliers = [(1, 7, 5.0), (2, 7, 7.0), (3, 7, 7.0), (4, 7, -2.0), (5, 10, 3.0), (6, None, 2.0), (7, 7, None), (8, 9, 0.0), (None, 7, 6.0)]
    got = run(spark, tmp_path, "rel_full_join", customer=(customers, "c_custkey bigint, c_nationkey int, c_acctbal double"), supplier=(suppliers, "s_suppkey bigint, s_nationkey int, s_acctbal double"), nation=([(7,)], "n_nationkey int"))
    meets = lambda c, s: None not in (c[1], s[1], c[2], s[2]) and c[1] == s[1] and c[2] < s[2]
    rows = [(c, s) for c in customers for s in suppliers if meets(c, s)]
    rows += [(c, (None, None, None)) for c in customers if not any(meets(c, s) for s in suppliers)] + [((None, None, None), s) for s in suppliers if not any(meets(c, s) for c in customers)]
    nation = lambda r: r[0][1] if r[0][1] is not None else r[1][1]
    want = {(k, sum(c[0] is not None for c, s in rows if nation((c, s)) == k), sum(s[0] is not None for c, s in rows if nation((c, s)) == k)) for k in map(nation, rows)}
    assert {(r.k, r.c, r.s) for r in got} == want


def test_softmax_best_of_all_scores(spark, tmp_path):
    rows = [(1, [0.0] * 10 + [3.0] + [0.0] * 53), (2, [1.0, 0.0])]
    got = run(spark, tmp_path, "softmax_best", embeddings=(rows, "vec_id bigint, embedding array<float>"))
    e = 2.718281828459045
    assert {(r.vec_id, r.best, r.share) for r in got} == {(1, 10, round(e**3 / (e**3 + 63), 5)), (2, 0, round(e / (e + 1), 5))}


def test_match_cursor_reads_on_and_inside_words(spark, tmp_path):
    from loomtext.operators.matching import Cursor, Entry

    texts = ["Chapter II. The lamps", *(f"He said {w}, and then {w} again." for w in "one two three four five six seven eight nine ten eleven twelve".split()), "Chapter III. The end"]
    said = ["Chapter I", "lamps", "I. The lamps He said one,", *(f"and then {a} again. He said {b}," for a, b in zip("one two three four five six seven eight nine ten eleven".split(), "two three four five six seven eight nine ten eleven twelve".split()))]
    tables = {
        "entries": ([(i, "b", 1, i, t) for i, t in enumerate(texts)], ENTRIES),
        "host_trace": ([(i, "s", "b", i, t) for i, t in enumerate(said)] + [(90, "t", "b", 0, "Chapter I")], TRACE),
    }
    got = {r.chunk_id: (r.how, r.first_seq, r.last_seq, r.partial) for r in run(spark, tmp_path, "match_cursor", **tables)}
    cursor = Cursor({i: Entry(i, t) for i, t in enumerate(texts)})
    want = {}
    for i, t in enumerate(said):
        f = cursor.match(t)
        want[i] = (f.how, f.seqs[0] if f.seqs else None, f.seqs[-1] if f.seqs else None, f.partial)
    assert {k: v for k, v in got.items() if k < 90} == want and got[90] == ("RELOCATED", 0, 0, True)
    assert want[len(said) - 1] == ("FORWARD", 11, 12, True)
