import random

from loomtext.operators.matching import Cursor, Entry, LockOn, Places, follow, lock_points, normal, relocate, replay

TEXTS = ["Chapter One", "It was late.", "Sarah looked up.", '"Well,"', "He left the room, the house, and the town.", '"Well,"', "I know,", "The end of it all came soon."]


def cursor(texts=TEXTS, spans=None):
    return Cursor({i: Entry(i, t, tuple((spans or {}).get(i, ()))) for i, t in enumerate(texts)})


def test_forward_and_relocated():
    c = cursor()
    c.seek(0)
    f = c.match("It was late.")
    assert (f.how, f.seqs, c.seq) == ("FORWARD", [1], 1)
    c.seek(2)
    assert c.match("“Well,”").seqs == [3]
    c.seek(4)
    assert c.match("“Well,”").seqs == [5]
    c.seek(0)
    f = c.match("The end of it all came soon.")
    assert (f.how, f.seqs, c.seq) == ("RELOCATED", [7], 7)


def test_search_tries_no_entry_in_vain():
    c = cursor([f"The {w} of it." for w in ["end", "rest", "whole"] * 500] + ["The end of it.", "The moon."])
    read, tried = c._read, []
    c._read = lambda *a: tried.append(a) or read(*a)
    assert c.match("The sun.").how == "NONE" and not tried
    assert c.match("The end of it. The moon.").seqs == [1500, 1501] and len(tried) == 1
    assert c.match("The whole of it. The end").seqs == [1499, 1500]


def test_nearest_start_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        texts = [" ".join(rng.choice(["a", "ab", "b", "a'"]) for _ in range(rng.randint(0, 8))) for _ in range(30)]
        c = cursor(texts)
        for _ in range(20):
            i = rng.randrange(30)
            wanted = " ".join(" ".join(texts[i : i + rng.randint(1, 3)])[: rng.randint(1, 30)].split())
            shared = lambda s: next((k for k, (x, y) in enumerate(zip([*texts[s].split()[:6], 0], [*wanted.split()[:6], 1])) if x != y))
            starts = [s for s in range(30) if wanted and shared(s) and c._read(s, 0, wanted)]
            want = min(starts, key=lambda s: (abs(s - c.seq) if c.seq >= 0 else s, -shared(s), s), default=None)
            before = c.seq, c.offset
            f = c.match(wanted)
            if f.how != "FORWARD":
                assert (f.seqs[0] if f.seqs else None) == want, (texts, wanted, before)


def test_several_entries_and_clauses():
    c = cursor()
    c.seek(0)
    f = c.match("It was late. Sarah looked up. Well,")
    assert (f.seqs, c.seq) == ([1, 2, 3], 3)
    assert cursor().match("Chapter One It was late.").seqs == [0, 1]
    c = cursor()
    assert [f.partial for f in replay(c, ["He left the room,", " the house,", " and the town."])] == [True, True, False]
    assert c.match("... !").how == "NONE" and c.match("not there").how == "NONE" and c.seq == 4
    assert c.match("and the town.").how == "NONE"


def test_clip():
    text = '"I know," said Sarah.'
    spans = {0: [(0, 9, "DIALOGUE", "sarah"), (9, 21, "NARRATION", None)]}
    c = cursor([text], spans)
    assert c.match('"I know,"').spans == [(0, 9, "DIALOGUE", "sarah")]
    c = cursor([text], spans)
    first, second = replay(c, ['"I know,', " said Sarah."])
    assert first.spans[0][2:] == ("DIALOGUE", "sarah") and second.spans[-1][2:] == ("NARRATION", None)
    p = Places('"A  b-c"')
    assert p.normal == "a b c" and [p.raw_at(i) for i in (0, 2, 4, 9)] == [1, 4, 6, 8]
    assert p.normal == normal('"A  b-c"')


def test_lock_on():
    books = {"old": (1, cursor()), "new": (2, cursor()), "other": (3, cursor(["Nothing", "alike"]))}
    lock = LockOn(books)
    for i in (1, 2, 4):
        assert lock.accept(TEXTS[i]).how == "NONE"
    assert (lock.locked, lock.ambiguous) == ("new", True)
    assert lock.accept(TEXTS[6]).seqs == [6]
    for _ in range(10):
        lock.accept("stranger words")
    assert lock.locked is None and set(lock.streak.values()) == {0}


def test_relocate_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "c d", "e"]

    def some():
        return " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))

    entries = [(rng.choice("xy"), i, some()) for i in range(60)]
    chunks = [(i, rng.choice(["x", "y", None]), some()) for i in range(60)]
    got = relocate(spark.createDataFrame(chunks, "chunk_id bigint, book_id string, form string"), spark.createDataFrame(entries, "book_id string, seq int, form string"))
    want = set()
    for k, b, f in chunks:
        hits = [s for e, s, g in entries if e == b and f and g and ((g + " ").startswith(f + " ") or (f + " ").startswith(g + " "))]
        if hits:
            want.add((k, b, min(hits)))
    assert {tuple(r) for r in got.collect()} == want


def test_follow_is_the_cursor_over_the_whole_book(spark):
    rng = random.Random(8)
    books = {b: [rng.choice(["Well,", "It was late.", "He left, then.", "No.", f"Line {i} of it.", "A \ufb01ne \uff24ay.", "Hello world again."]) for i in range(40)] for b in "xy"}
    entries = [(b, i, t) for b, texts in books.items() for i, t in enumerate(texts)]
    chunks = []
    for session in range(4):
        b = rng.choice("xy")
        for u in range(12):
            i = rng.randrange(39)
            t = rng.choice([books[b][i], books[b][i] + " " + books[b][i + 1], books[b][i][: rng.randint(1, 9)], "nowhere", "A fine Day.", "\uff28\uff45\uff4c\uff4c\uff4f world"])
            chunks.append((f"s{session}", b, session * 100 + u, u, t))
    got = follow(spark.createDataFrame(chunks, "session_id string, book_id string, chunk_id bigint, utterance int, text string"), spark.createDataFrame(entries, "book_id string, seq int, text string"))
    got = {r.chunk_id: (r.how, r.first_seq, r.last_seq, r.partial) for r in got.collect()}
    want = {}
    for session in range(4):
        mine = [c for c in chunks if c[0] == f"s{session}"]
        whole = cursor(books[mine[0][1]])
        for c in mine:
            f = whole.match(c[4])
            want[c[2]] = (f.how, f.seqs[0] if f.seqs else None, f.seqs[-1] if f.seqs else None, f.partial)
    assert got == want


def test_lock_points(spark):
    hits = [("s", "b", i, h) for i, h in enumerate([True, True, False, True, True, True, True])]
    got = lock_points(spark.createDataFrame(hits, "session_id string, book_id string, utterance int, hit boolean")).collect()
    assert [tuple(r) for r in got] == [("s", "b", 5)]
