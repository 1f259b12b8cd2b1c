"""Places of text fragments in indexed books: index entries, relocation, a cursor that follows a reader, lock-on to a book."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import HEAD_WORDS, STRIPPED, full_form, index_sentences, let, openings
from loomtext.operators.ordered import last_known, running_sum
from loomtext.session import checkpointed

WINDOW = 5
LOCK_AFTER, FORGET_AFTER = 3, 10
#: Chunks of a book up to which its sessions stay in one task.
BOOK_CHUNKS = 20_000

_DROPPED = regex.compile(r"[^\p{L}\p{Nd}' ]")
_SPACED = regex.compile(r"[\s\p{Z}\-—]")


def normal(text: str) -> str:
    """The normal form of the index, with the compatibility step."""
    out = unicodedata.normalize("NFKC", text).translate(dict.fromkeys(map(ord, STRIPPED)))
    out = _DROPPED.sub("", "".join(c.lower() if len(c.lower()) == 1 else c.lower()[0] for c in _SPACED.sub(" ", out)))
    return " ".join(out.split())


def placed_sentences(text: Column) -> Column:
    """Index sentences of a text as structs of ``sentence``, ``start``, ``end``, each looked for behind the one before."""
    empty = F.array().cast("array<struct<sentence:string,start:int,end:int>>")

    def place(found: Column, sentence: Column) -> Column:
        since = F.coalesce(F.try_element_at(found, F.lit(-1))["end"], F.lit(0))
        at = F.call_function("locate", sentence, text, since + 1)
        start = F.when(at > 0, at - 1).otherwise(since)
        return F.concat(found, F.array(F.struct(sentence.alias("sentence"), start.alias("start"), (start + F.length(sentence)).alias("end"))))

    return F.aggregate(index_sentences(text), empty, place)


def entry_spans(paras: DataFrame, lines: DataFrame) -> DataFrame:
    """Each index sentence with the attributed runs that overlap it, clipped and counted from the sentence's start.

    ``paras``: ``book_id``, ``seq``, ``text``; ``lines``: ``book_id``, ``seq``, ``n``, ``run``, ``run_start``, ``kind``,
    ``speaker_id``, ``confidence``. A sentence that no run overlaps has one span of narration.
    """
    sentences = paras.select("book_id", "seq", F.posexplode(placed_sentences(F.col("text"))).alias("i", "p")).select("book_id", "seq", "i", "p.*")
    runs = lines.select("book_id", "seq", "n", F.col("run_start").alias("r0"), (F.col("run_start") + F.length("run")).alias("r1"), "kind", "speaker_id", "confidence")
    met = sentences.join(runs, ["book_id", "seq"]).where(F.least("end", "r1") > F.greatest("start", "r0"))
    clipped = met.select(
        "book_id", "seq", "i", "n", (F.greatest("start", "r0") - F.col("start")).alias("span_start"), (F.least("end", "r1") - F.col("start")).alias("span_end"), "kind", "speaker_id", "confidence"
    )
    out = sentences.select("book_id", "seq", "i", "sentence").join(clipped, ["book_id", "seq", "i"], "left")
    return out.select(
        "book_id",
        "seq",
        "i",
        "sentence",
        F.coalesce("span_start", F.lit(0)).alias("span_start"),
        F.coalesce("span_end", F.length("sentence")).alias("span_end"),
        F.coalesce("kind", F.lit("NARRATION")).alias("kind"),
        "speaker_id",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def _opened(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows by each opening of one to six words; ``whole`` marks the longest one."""
    parts = let(openings(F.col("form")), lambda o: F.transform(o, lambda x, j: F.struct(x.alias("opening"), (j + 1 == F.size(o)).alias("whole"))))
    return rows.select(*keep, "form", F.explode(parts).alias("o")).select(*keep, "form", "o.opening", "o.whole")


def relocate(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """The first entry of the chunk's book that the chunk begins, equals or goes beyond, word by word.

    ``chunks``: ``chunk_id``, ``book_id``, ``form``; ``entries``: ``book_id``, ``seq``, ``form``, both in normal form. Equal
    texts of a book are looked up once. Texts meet through the longest opening (of up to six words) of one of them,
    so frequent first words bring together only texts that are no longer than them.
    """
    wanted = chunks.select("book_id", "form").where("form <> '' AND book_id IS NOT NULL").distinct()
    held = entries.where("form <> ''").groupBy("book_id", "form").agg(F.min("seq").alias("seq"))
    found = _met(wanted, held, ["book_id"], ["seq"]).groupBy("book_id", F.col("asked").alias("form")).agg(F.min("seq").alias("seq"))
    return chunks.join(found, ["book_id", "form"]).select("chunk_id", "book_id", "seq")


def _met(wanted: DataFrame, held: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Forms ``asked`` and ``held`` of equal ``keys`` of which one begins, equals or goes beyond the other, word by word."""
    a = _opened(wanted, keys).withColumnsRenamed({"form": "asked", "whole": "all_asked"})
    b = _opened(held, [*keys, *keep]).withColumnsRenamed({"form": "held", "whole": "all_held"})
    fits = F.startswith(F.concat("held", F.lit(" ")), F.concat("asked", F.lit(" "))) | F.startswith(F.concat("asked", F.lit(" ")), F.concat("held", F.lit(" ")))
    return _joined_at_ends(a, b, [*keys, "opening"], F.col("all_asked")).where(fits)


def _joined_at_ends(a: DataFrame, b: DataFrame, keys: Sequence[str], ending: Column) -> DataFrame:
    """Openings of ``a`` and ``b`` of which one is an end: two joins, each with the ends alone on one side."""
    return a.where(ending).join(b, [*keys]).unionByName(a.where(~ending).join(b.where("all_held"), [*keys]))


def found_in(forms: DataFrame, entries: DataFrame) -> DataFrame:
    """``form``, ``book_id``: every book with an entry that the form begins, equals or goes beyond, word by word.

    ``forms``: ``form``; ``entries``: ``book_id``, ``form``, both in normal form. Equal texts are compared once, in
    however many books they stand.
    """
    held = entries.where("form <> '' AND book_id IS NOT NULL").select("book_id", "form").distinct()
    met = _met(forms.select("form").where("form <> ''").distinct(), held.select("form").distinct(), [], [])
    pairs = met.select(F.col("asked").alias("asked"), F.col("held").alias("form")).distinct()
    return pairs.join(held, "form").select(F.col("asked").alias("form"), "book_id").distinct()


@dataclass(frozen=True)
class Entry:
    seq: int
    text: str
    spans: tuple[tuple[int, int, str, str | None], ...] = ()


@dataclass
class Found:
    """Where a chunk lies: ``how`` is FORWARD, RELOCATED or NONE."""

    how: str = "NONE"
    seqs: list[int] = field(default_factory=list)
    partial: bool = False
    spans: list[tuple[int, int, str, str | None]] = field(default_factory=list)


class Places:
    """Raw places of the characters of a text's normal form."""

    def __init__(self, raw: str):
        self.raw = raw
        self.at: list[int] = []
        kept: list[str] = []
        for i, c in enumerate(raw):
            piece = " " if _SPACED.fullmatch(c) else normal(c)
            if not piece or (piece == " " and (not kept or kept[-1] == " ")):
                continue
            for p in piece:
                kept.append(p)
                self.at.append(i)
        while kept and kept[-1] == " ":
            kept.pop()
            self.at.pop()
        self.normal = "".join(kept)

    def raw_at(self, n: int) -> int:
        if not self.at or n >= len(self.at):
            return len(self.raw)
        return self.at[max(0, n)]


class Forms:
    """The normal forms of a book's entries by place and in sorted order, which any number of cursors may share.

    A text can be read from the beginning of an entry that it begins, and all such are a range of the sorted forms; or of one
    that it goes beyond, whose form is among its own openings, where its rest can be read from the next entry on.
    """

    #: Places kept from one search to the next.
    KEPT = 1 << 22

    def __init__(self, form: Mapping[int, str]):
        self.form = form
        places = sorted(form)
        ranked = sorted(range(len(places)), key=lambda i: form[places[i]])
        self.sorted = [form[places[i]] for i in ranked]
        self.places = np.array(places, dtype=np.int64)
        self.by_rank = self.places[ranked] if ranked else self.places
        self.rank = np.empty(len(ranked), dtype=np.int64)
        self.rank[ranked] = np.arange(len(ranked))
        self.known = set(self.sorted)
        self.longest = max(map(len, self.known), default=0)
        self.found: dict[str, np.ndarray] = {}
        self.kept = 0

    def starts(self, wanted: str) -> np.ndarray:
        """The places in order where ``wanted`` can be read from the beginning of an entry that shares its first word."""
        found = self.found.get(wanted)
        if found is None:
            found = self._starts(wanted)
            self.kept += len(found) + 32
            if self.kept > self.KEPT:
                self.found, self.kept = {}, len(found) + 32
            self.found[wanted] = found
        return found

    def _starts(self, wanted: str) -> np.ndarray:
        # The ends of the entries that may be read from each place of the text at which one can begin.
        ends: dict[int, list[int]] = {}
        todo = [0]
        while todo:
            at = todo.pop()
            if at in ends:
                continue
            ends[at], space = [], wanted.find(" ", at)
            while 0 <= space - at <= self.longest:
                if wanted[at:space] in self.known:
                    ends[at].append(space)
                    todo.append(space + 1)
                space = wanted.find(" ", space + 1)
        through: dict[int, np.ndarray] = {}
        for at in sorted(ends, reverse=True):
            runs = [np.empty(0, dtype=np.int64)]
            for end in ends[at]:
                here = self._equal(wanted[at:end])
                runs.append(self._before(here, self._begun(wanted[end + 1 :])))
                runs.append(through[end + 1][self._within(through[end + 1] - 1, here)] - 1)
            through[at] = np.unique(np.concatenate(runs)) if len(runs) > 1 else runs[0]
        # A single word must be a whole one. A space sorts before all that can follow inside a word.
        first, last = self._begun(wanted) if " " in wanted else (bisect_left(self.sorted, wanted), bisect_left(self.sorted, wanted + "!"))
        begun = np.sort(self.by_rank[first:last])
        return np.union1d(begun, through[0]) if len(through[0]) else begun

    def _equal(self, text: str) -> tuple[int, int]:
        return bisect_left(self.sorted, text), bisect_right(self.sorted, text)

    def _begun(self, text: str) -> tuple[int, int]:
        return bisect_left(self.sorted, text), bisect_left(self.sorted, text + "\U0010ffff")

    def _within(self, places: np.ndarray, ranks: tuple[int, int]) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
        return (self.places[i] == places) & (self.rank[i] >= ranks[0]) & (self.rank[i] < ranks[1])

    def _before(self, here: tuple[int, int], then: tuple[int, int]) -> np.ndarray:
        """Places of the forms ``here`` right before one of ``then``, from the side that has fewer."""
        if here[1] - here[0] <= then[1] - then[0]:
            places = self.by_rank[slice(*here)]
            return places[self._within(places + 1, then)]
        places = self.by_rank[slice(*then)] - 1
        return places[self._within(places, here)]


class Cursor:
    """Follows a reader through one book: tries the place where the last chunk ended, the entries just ahead, then all by their openings.

    Cursors of one book may share its ``forms``; ``entries`` are then only needed for spans.
    """

    def __init__(self, entries: Mapping[int, Entry], window: int = WINDOW, forms: Forms | None = None):
        self.entries = entries
        self.forms = Forms({s: normal(e.text) for s, e in entries.items()}) if forms is None else forms
        self.form = self.forms.form
        self.window = window
        self.seq, self.offset = -1, 0

    def seek(self, seq: int) -> None:
        self.seq, self.offset = max(-1, min(seq, max(self.form, default=-1))), 0

    def _read(self, seq: int, offset: int, wanted: str) -> tuple[list[int], int, int, int] | None:
        """Entries used, end of the content in the last, and the place to go on from, if ``wanted`` is read from here on."""
        used: list[int] = []
        while True:
            form = self.form.get(seq)
            if form is None or offset > len(form):
                return None
            ahead = form[offset:]
            if ahead and wanted.startswith(ahead + " "):
                used.append(seq)
                wanted, seq, offset = wanted[len(ahead) + 1 :], seq + 1, 0
            elif ahead.startswith(wanted):
                end = offset + len(wanted)
                return [*used, seq], end, seq, end + (form[end : end + 1] == " ")
            else:
                return None

    def _shared(self, seq: int, wanted: str) -> int:
        """With how many words, up to those of an opening, an entry begins like the text."""
        n = 0
        for a, b in zip(self.form[seq].split(" ", HEAD_WORDS)[:HEAD_WORDS], wanted.split(" ", HEAD_WORDS)[:HEAD_WORDS]):
            if a != b:
                break
            n += 1
        return n

    def _nearest(self, wanted: str) -> int | None:
        """The start nearest to the cursor, before the first match the first one; of two as near the one with the longer opening in common, then the earlier."""
        starts = self.forms.starts(wanted)
        if not len(starts) or self.seq < 0:
            return int(starts[0]) if len(starts) else None
        i = int(starts.searchsorted(self.seq))
        near = [int(s) for s in starts[max(0, i - 1) : i + 1]]
        if len(near) == 2 and near[1] - self.seq == self.seq - near[0]:
            return min(near, key=lambda s: (-self._shared(s, wanted), s))
        return min(near, key=lambda s: abs(s - self.seq))

    def place(self, wanted: str) -> tuple[str, list[int], int, int] | None:
        """Where a text in normal form lies: FORWARD or RELOCATED, the entries used, its beginning in the first and its end in the last of them. The cursor moves on behind it, or stays if there is no such place."""
        if not wanted:
            return None
        tries = [(self.seq, self.offset), *((s, 0) for s in range(self.seq, self.seq + self.window + 1))] if self.seq >= 0 else []
        for seq, offset in tries:
            if (run := self._read(seq, offset, wanted)) is not None:
                used, end, self.seq, self.offset = run
                return "FORWARD", used, offset, end
        if (seq := self._nearest(wanted)) is None:
            return None
        used, end, self.seq, self.offset = self._read(seq, 0, wanted)
        return "RELOCATED", used, 0, end

    @property
    def partial(self) -> bool:
        """Whether the last text placed ended inside an entry."""
        return self.offset < len(self.form[self.seq])

    def match(self, chunk: str) -> Found:
        """The place of a chunk; a chunk without words, or not found, leaves the cursor where it is."""
        placed = self.place(normal(chunk))
        if placed is None:
            return Found()
        how, used, start, end = placed
        return Found(how, used, self.partial, self._clip(used, start, end))

    def _clip(self, used: list[int], start: int, end: int) -> list[tuple[int, int, str, str | None]]:
        """The entries' spans inside the chunk, counted from its first character; an opening mark before it belongs to it."""
        joined = " ".join(self.entries[s].text for s in used)
        places = Places(joined)
        last = places.raw_at(end + sum(len(self.form[s]) + 1 for s in used[:-1]))
        first = places.raw_at(start)
        while first > 0 and not joined[first - 1].isspace() and not normal(joined[first - 1]):
            first -= 1
        out, base = [], 0
        for s in used:
            for a, b, kind, who in self.entries[s].spans:
                lo, hi = max(a + base, first), min(b + base, last)
                if lo < hi:
                    out.append((lo - first, hi - first, kind, who))
            base += len(self.entries[s].text) + 1
        return out


class LockOn:
    """Finds out which of several books a reader reads: the newest of those that fit several chunks in a row."""

    def __init__(self, books: Mapping[str, tuple[int, Cursor]], lock_after: int = LOCK_AFTER, forget_after: int = FORGET_AFTER):
        self.books = books
        self.lock_after, self.forget_after = lock_after, forget_after
        self.streak = dict.fromkeys(books, 0)
        self.locked: str | None = None
        self.misses = 0
        self.ambiguous = False

    def accept(self, chunk: str) -> Found:
        if self.locked is not None:
            found = self.books[self.locked][1].match(chunk)
            self.misses = 0 if found.how != "NONE" else self.misses + 1
            if self.misses >= self.forget_after:
                self.locked, self.misses, self.ambiguous = None, 0, False
                self.streak = dict.fromkeys(self.books, 0)
            return found
        for name, (_, cursor) in self.books.items():
            self.streak[name] = self.streak[name] + 1 if cursor.match(chunk).how != "NONE" else 0
        ready = [n for n, k in self.streak.items() if k >= self.lock_after]
        if ready:
            self.locked, self.ambiguous, self.misses = max(ready, key=lambda n: self.books[n][0]), len(ready) > 1, 0
        return Found()


def follow(chunks: DataFrame, entries: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every session's chunks in order of ``utterance``, each placed in its book by a cursor: ``how``, ``first_seq``, ``last_seq``, ``partial``.

    ``chunks``: ``session_id``, ``book_id``, ``chunk_id``, ``utterance``, ``text``; ``entries``: ``book_id``, ``seq``, ``text``. The
    sessions of a book meet its entries in one task and share them. Those of a book with many more chunks than entries are dealt
    over several, each with a copy, so that the copies have no more rows than the chunks. Chunks without words or book give
    no row; chunks without session are placed nowhere. Entries of books without chunks are of no use here and best left out before.
    """
    asked = chunks.where("book_id IS NOT NULL AND text IS NOT NULL")
    entries = entries.where("seq IS NOT NULL AND text IS NOT NULL")
    # Few books: each has at least twice BOOK_CHUNKS chunks of its own.
    often = asked.groupBy("book_id").agg(F.count("*").alias("chunks")).where(F.col("chunks") >= 2 * BOOK_CHUNKS)
    long = entries.join(F.broadcast(often), "book_id", "left_semi").groupBy("book_id").agg(F.count("*").alias("entries"))
    parts = F.floor(F.col("chunks") / F.greatest("entries", F.lit(BOOK_CHUNKS))).cast("int")
    dealt = F.broadcast(often.join(long, "book_id").select("book_id", parts.alias("parts")).where("parts > 1"))
    count = F.coalesce("parts", F.lit(1))

    def key(part: Column) -> Column:
        return F.concat(F.col("book_id").cast("string"), F.lit("\0"), part.cast("string")).alias("key")

    said = asked.join(dealt, "book_id", "left").select(key(F.pmod(F.xxhash64("session_id"), count)), "session_id", "utterance", "chunk_id", full_form(F.col("text")).alias("form"))
    given = entries.join(dealt, "book_id", "left").select(F.explode(F.sequence(F.lit(0), count - 1)).alias("part"), "book_id", "seq", full_form(F.col("text")).alias("form")).select(key(F.col("part")), "seq", "form")

    def run(said: pa.Table, book: pa.Table) -> pa.Table:
        forms = Forms(dict(zip(book["seq"].to_pylist(), book["form"].to_pylist())))
        said = said.sort_by([("session_id", "ascending"), ("utterance", "ascending"), ("chunk_id", "ascending")])
        cursor, session, rows = None, None, []
        for reader, chunk, form in zip(*(said[c].to_pylist() for c in ("session_id", "chunk_id", "form"))):
            if cursor is None or reader != session:
                cursor, session = Cursor({}, window, forms), reader
            if form:
                placed = cursor.place(form) if reader is not None else None
                rows.append((chunk, "NONE", None, None, False) if placed is None else (chunk, placed[0], placed[1][0], placed[1][-1], cursor.partial))
        kinds = {"chunk_id": pa.int64(), "how": pa.string(), "first_seq": pa.int32(), "last_seq": pa.int32(), "partial": pa.bool_()}
        return pa.table([pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * 5, kinds.values())], list(kinds))

    return said.groupBy("key").cogroup(given.groupBy("key")).applyInArrow(run, "chunk_id bigint, how string, first_seq int, last_seq int, partial boolean")


def lock_points(hits: DataFrame, order: str = "utterance", after: int = LOCK_AFTER) -> DataFrame:
    """``session_id``, ``book_id``, ``locked_at``: the first chunk at which a book was hit ``after`` times in a row.

    ``hits``: ``session_id``, ``book_id``, ``order``, ``hit``. Runs are islands between misses, counted without a window over a
    whole session.
    """
    keys = ["session_id", "book_id"]
    counted = running_sum(hits, keys, order, F.lit(1), "_at")
    counted = last_known(counted, keys, order, F.when(~F.col("hit"), F.col("_at")), "_missed", before=False)
    streak = F.col("_at") - F.coalesce(F.col("_missed"), F.lit(0))
    return counted.where(F.col("hit") & (streak >= after)).groupBy(*keys).agg(F.min(order).alias("locked_at"))


def first_locks(said: DataFrame, hits: DataFrame, books: DataFrame, after: int = LOCK_AFTER) -> DataFrame:
    """``session_id``, ``book_id``, ``locked_at``: the first chunk at which any book was hit ``after`` times in a row, and the newest such book.

    ``said``: ``session_id``, ``utterance``, ``form``; ``hits``: ``form``, ``book_id`` as ``found_in`` gives them, checkpointed;
    ``books``: ``book_id``, ``indexed_at``. Every utterance of a session counts, those found in no book as misses; of books
    equally new the one with the smallest id wins. Sessions without a lock have no row. Chunks in a row meet the books of
    the rarest of them only, so a phrase that stands in most books is not held against each of them.
    """
    rows = said.where("session_id IS NOT NULL AND utterance IS NOT NULL").select("session_id", "utterance", "form").distinct()
    placed = running_sum(rows.select("session_id", "utterance").distinct(), ["session_id"], "utterance", F.lit(1), "i")
    known = hits.join(books.select("book_id", "indexed_at"), "book_id").select("form", "book_id", "indexed_at").distinct()
    count = known.groupBy("form").agg(F.count("*").alias("n"))
    hit = rows.join(placed, ["session_id", "utterance"]).join(count, "form").select("session_id", "utterance", "i", F.struct("n", "form").alias("f"))
    runs = hit.select("session_id", "utterance", "i", F.array("f").alias("fs"))
    for back in range(1, after):
        before = hit.select("session_id", (F.col("i") + back).alias("i"), "f")
        runs = runs.join(before, ["session_id", "i"]).select("session_id", "utterance", "i", F.concat("fs", F.array("f")).alias("fs"))
    runs = runs.select("session_id", "utterance", F.array_sort(F.array_distinct("fs")).alias("fs"))
    sets = runs.select("fs").distinct()
    fits = sets.select("fs", F.col("fs")[0]["form"].alias("form")).join(known, "form").drop("form")
    for k in range(1, after):
        # A set of fewer forms has none at this place and stays as it is.
        more = fits.where(F.size("fs") > k).withColumn("form", F.try_element_at("fs", F.lit(k + 1))["form"])
        fits = fits.where(F.size("fs") <= k).unionByName(more.join(known.select("form", "book_id"), ["form", "book_id"], "left_semi").drop("form"))
    newest = fits.groupBy("fs").agg(F.min(F.struct((-F.col("indexed_at")).alias("age"), "book_id")).alias("b"))
    first = runs.join(newest, "fs").groupBy("session_id").agg(F.min(F.struct("utterance", "b")).alias("l"))
    return first.select("session_id", F.col("l.b.book_id").alias("book_id"), F.col("l.utterance").alias("locked_at"))


def session_hits(said: DataFrame, entries: DataFrame, books: DataFrame, after: int = LOCK_AFTER) -> DataFrame:
    """``session_id``, ``form``, ``books``: of the books that each chunk of a session lies in, newest first, those that the session may lock on to.

    ``said``: ``session_id``, ``utterance``, ``chunk_id``, ``form``; ``entries``: ``book_id``, ``form``; ``books``: ``book_id``, ``indexed_at``.
    A session can lock on only to the newest book that ``after`` of its chunks in a row lie in. No phrase meets all books that it
    stands in: chunks in a row meet those of the rarest of them, the others are looked up in these alone.
    """
    held = checkpointed(entries.where("form <> '' AND book_id IS NOT NULL").join(books.select("book_id"), "book_id", "left_semi").select("book_id", "form").distinct())
    forms = said.select("form").where("form <> ''").distinct()
    met = checkpointed(_met(forms, held.select("form").distinct(), [], []).select("asked", "held").distinct())
    count = met.join(held.groupBy(F.col("form").alias("held")).agg(F.count("*").alias("n")), "held").groupBy(F.col("asked").alias("form")).agg(F.sum("n").alias("n"))
    placed = running_sum(said, ["session_id"], "utterance", F.lit(1), "i", then=["chunk_id"])
    hit = checkpointed(placed.join(count, "form").select("session_id", "i", F.struct("n", "form").alias("f")))
    runs = hit.select("session_id", "i", F.array("f").alias("fs"))
    for back in range(1, after):
        before = hit.select("session_id", (F.col("i") + back).alias("i"), "f")
        runs = runs.join(before, ["session_id", "i"]).select("session_id", "i", F.concat("fs", F.array("f")).alias("fs"))
    runs = runs.select("session_id", F.transform(F.array_sort(F.array_distinct("fs")), lambda f: f["form"]).alias("fs")).distinct()
    sets = checkpointed(runs.select("fs").distinct().withColumn("id", F.monotonically_increasing_id()))
    rarest = sets.select("id", F.col("fs")[0].alias("asked")).join(met, "asked").select("id", F.col("held").alias("form"))
    fits = checkpointed(rarest.join(held, "form").select("id", "book_id").distinct())
    others = sets.select("id", F.explode(F.slice("fs", 2, after)).alias("form"))
    asked = fits.join(others, "id")
    lacking = asked.join(_lying_in(asked, held), ["book_id", "form"], "left_anti").select("id", "book_id")
    kept = fits.join(lacking, ["id", "book_id"], "left_anti").join(books.select("book_id", "indexed_at"), "book_id")
    newest = kept.groupBy("id").agg(F.min(F.struct((-F.col("indexed_at")).alias("age"), "book_id")).alias("b")).join(sets, "id")
    may = checkpointed(runs.join(newest, "fs").select("session_id", "b.age", "b.book_id").distinct())
    wanted = said.where("form <> ''").select("session_id", "form").distinct().join(may, "session_id")
    found = wanted.join(_lying_in(wanted, held), ["book_id", "form"], "left_semi")
    return found.groupBy("session_id", "form").agg(F.transform(F.array_sort(F.collect_set(F.struct("age", "book_id"))), lambda b: b["book_id"]).alias("books"))


def _lying_in(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """The ``book_id`` and ``form`` of ``wanted`` where the form lies in that book."""
    return _met(wanted.select("book_id", "form").distinct(), held, ["book_id"], []).select("book_id", F.col("asked").alias("form")).distinct()


def replay(cursor: Cursor, chunks: Iterable[str]) -> list[Found]:
    return [cursor.match(c) for c in chunks]
