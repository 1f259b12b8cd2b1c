"""Queries whose plans must hold on large tables, on small ones."""

from loomtext.plans.catalog import CATALOG


def put(spark, folder, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")


def broadcast(df):
    """What each broadcast of the plan that ran makes itself, down to the shuffles that it reads."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            shuffled = None
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                if shuffled is not None and depth(below) > shuffled:
                    continue
                shuffled = depth(below) if "ShuffleQueryStage" in below else None
                out.append(below)
    return out


def test_canonical_id_broadcasts_no_endings(spark, tmp_path):
    cast = [(i, f"b{i % 9}", f"c{i}", f"Miss Harriet Fenwarfell of Number {i} in the Street by the Weir", None) for i in range(300)]
    docs = [(f"b{i % 9}", [f"Number {i} in the Street by the Weir", f"old miss harriet fenwarfell of number {i} in the street by the weir"]) for i in range(300)]
    put(spark, tmp_path, manifest_characters=(cast, "rec_id bigint, book_id string, char_id string, display_name string, aliases array<string>"), documents=(docs, "book_id string, cast_names array<string>"))
    df = CATALOG.queries["canonical_id_join"](spark, str(tmp_path))
    assert len(df.collect()) == 600
    assert not [x for x in broadcast(df) if "Generate explode(sequence(" in x or "Generate explode(filter(" in x]


def test_index_of_many_books_in_few_folders(spark, tmp_path):
    from loomtext.sources import sinks as K

    def tables(rows):
        entries = spark.createDataFrame(rows, "book_id string, seq int, text string")
        return entries.selectExpr("book_id", "1 schema_version").distinct(), entries, entries.selectExpr("book_id", "seq", "0 ordinal"), entries.selectExpr("book_id", "1L prefix_hash", "seq")

    path = str(tmp_path / "index")
    K.write_index(path, *tables([(f"{b:03}", s, "old") for b in range(300) for s in range(2)]))
    K.write_index(path, *tables([(f"{b:03}", 5, "new") for b in range(0, 300, 7)] + [("more", 0, "new")]))
    want = {(f"{b:03}", s, "old") for b in range(300) if b % 7 for s in range(2)} | {(f"{b:03}", 5, "new") for b in range(0, 300, 7)} | {("more", 0, "new")}
    index = K.read_index(spark, path)
    # Ids of digits alone keep their zeros.
    assert sorted((r.book_id, r.seq, r.text) for r in index["entries"].collect()) == sorted(want)
    assert {name: index[name].count() for name in index} == {"books": 301, "entries": len(want), "spans": len(want), "prefixes": len(want)}
    assert all(sum(x.is_dir() for x in (tmp_path / "index" / name).iterdir()) <= K.SHELVES for name in index)


def test_hashes_of_many_texts(spark):
    from loomtext.functions.text import fnv64, fnv64_batched

    rows = [(t,) for t in ["", "a", "it was late", "Größe", "夜 は", "\U0001f600 x", None, "a", "long " * 300]]
    got = spark.createDataFrame(rows, "t string").select(fnv64("t").alias("one"), fnv64_batched("t").alias("many")).collect()
    assert [r.one for r in got[:6] + got[7:]] == [r.many for r in got[:6] + got[7:]] and got[6].many is None


def test_session_hits_name_only_books_to_lock_on(spark):
    import random

    from loomtext.operators.matching import FORGET_AFTER, LOCK_AFTER, session_hits

    rng = random.Random(5)
    phrases = ["chapter", "he said", "no", "he said no more"]
    books = {f"b{k:02}": {*rng.sample(phrases, 3), *(f"line {k} {i}" for i in range(9))} for k in range(60)}
    chunks = []
    for s in range(6):
        for u in range(40):
            own = sorted(books[f"b{(s + 7 * (u // 14)) % 60:02}"])
            chunks.append((f"s{s}", u, 100 * s + u, rng.choice([*own, *phrases, "nowhere", ""])))
    held = [(b, t) for b, texts in books.items() for t in texts]
    got = session_hits(spark.createDataFrame(chunks, "session_id string, utterance int, chunk_id bigint, form string"), spark.createDataFrame(held, "book_id string, form string"), spark.createDataFrame([(b, k // 2) for k, b in enumerate(books)], "book_id string, indexed_at bigint"))
    hits = {(r.session_id, r.form): r.books for r in got.collect()}
    newest = sorted(books, key=lambda b: (-(int(b[1:]) // 2), b))
    fits = lambda f, t: (t + " ").startswith(f + " ") or (f + " ").startswith(t + " ")
    every = {f: [b for b in newest if f and any(fits(f, t) for t in books[b])] for *_, f in chunks}

    def locked(session, known):
        lock, misses, streak, out = None, 0, {}, []
        for f in [c[3] for c in chunks if c[0] == session]:
            here = known(f)
            if lock:
                misses = 0 if lock in here else misses + 1
                if misses >= FORGET_AFTER:
                    lock, misses, streak = None, 0, {}
            else:
                streak = {b: streak.get(b, 0) + 1 for b in here}
                lock, misses = next((b for b in here if streak[b] >= LOCK_AFTER), None), 0
            out.append(lock)
        return out

    for s in {c[0] for c in chunks}:
        assert locked(s, lambda f: hits.get((s, f), [])) == locked(s, every.get)
    assert max(map(len, every.values())) > 40 and max(map(len, hits.values())) < 15


def shuffled(df):
    """The rows that each shuffle of the plan that ran has written."""
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            out += [node.metrics().apply("shuffleRecordsWritten").value()] if kind == "ShuffleExchangeExec" else []
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_cursors_share_the_entries_of_their_book(spark, tmp_path):
    entries = [(i, "b", 1, i, f"The {w} of it {i}.") for i, w in enumerate(["end", "rest", "whole"] * 100)] + [(900, "unread", 1, 0, "The end.")]
    said = [(s * 10 + k, f"s{s}", "b", k, t) for s in range(60) for k, t in enumerate(["The end of it", f"The whole of it {s * 3 + 2}.", "The"])]
    put(spark, tmp_path, entries=(entries, "entry_id bigint, book_id string, chapter int, seq int, text string"), host_trace=(said, "chunk_id bigint, session_id string, book_id string, utterance int, text string"))
    df = CATALOG.queries["match_cursor"](spark, str(tmp_path))
    got = {r.chunk_id: (r.how, r.first_seq) for r in df.collect()}
    assert len(got) == 180 and got[200] == ("RELOCATED", 0) and got[201] == ("RELOCATED", 62) and got[202] == ("FORWARD", 62)
    assert max(shuffled(df)) <= len(entries)


def test_sessions_of_a_book_that_many_read_are_dealt_over_tasks(spark, monkeypatch):
    from loomtext.operators import matching as M

    monkeypatch.setattr(M, "BOOK_CHUNKS", 20)
    texts = ["Well,", "It was late.", "He left, then.", "Well,", "It was late and dark.", "No."]
    said = [(s * 10 + k, f"s{s}", "b", k, texts[(s + k * (1 + s % 3)) % 6]) for s in range(40) for k in range(5)] + [(900, None, "b", 0, "No."), (901, "s1", "none", 0, "No."), (902, "s1", "b", 9, "...")]
    df = M.follow(spark.createDataFrame(said, "chunk_id bigint, session_id string, book_id string, utterance int, text string"), spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book_id string, seq int, text string"))
    got = {r.chunk_id: (r.how, r.first_seq, r.last_seq, r.partial) for r in df.collect()}
    want = {900: ("NONE", None, None, False), 901: ("NONE", None, None, False)}
    for s in range(40):
        cursor = M.Cursor({i: M.Entry(i, t) for i, t in enumerate(texts)})
        for c in said[s * 5 : s * 5 + 5]:
            f = cursor.match(c[4])
            want[c[0]] = (f.how, f.seqs[0] if f.seqs else None, f.seqs[-1] if f.seqs else None, f.partial)
    assert got == want
    assert 6 * 10 in shuffled(df)
