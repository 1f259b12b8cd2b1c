"""Byte-pair encoding of a corpus with the vocabulary of a public tokenizer."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import spread

#: Characters whose words are held at once, and words whose ids a worker remembers. Both bound
#: memory alone; the result does not depend on them.
SLICE_CHARS = 2_000_000
REMEMBERED = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a rank file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PairEncoder:
    """Encodes many words at once through an index of where each pair of symbols occurs."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.base = max(self.token) + 1
        self.merged: dict[tuple[int, int], int | None] = {}
        self.words_of = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def _rank_of(self, left: int, right: int) -> int | None:
        pair = (left, right)
        if pair not in self.merged:
            self.merged[pair] = self.rank.get(self.token[left] + self.token[right])
        return self.merged[pair]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word.

        All words lie in one line of symbols. Every pair of neighbours that can merge is mapped to
        all its positions; the pair of the lowest rank is merged at each of them, from left to
        right, and only the lists of the pairs it touches change. A word's merges are thus applied
        in ascending rank, as they would be for the word alone.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(r) for r in raw])
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(symbols)
        if not n:
            return [()] * len(words)
        after = np.arange(1, n + 1)
        after[ends[ends > 0] - 1] = -1
        before = np.arange(-1, n - 1)
        before[np.concatenate(([0], ends[:-1]))[[len(r) > 0 for r in raw]]] = -1
        places: dict[tuple[int, int], list[int]] = {}
        active: list[tuple[int, int, int]] = []
        linked = np.flatnonzero(after >= 0)
        if len(linked):
            keys = symbols[linked] * self.base + symbols[linked + 1]
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            for group in np.split(order, cuts):
                left, right = divmod(int(keys[group[0]]), self.base)
                rank = self._rank_of(left, right)
                if rank is not None:
                    places[left, right] = linked[group].tolist()
                    active.append((rank, left, right))
        heapq.heapify(active)
        sym, nxt, prv = symbols.tolist(), after.tolist(), before.tolist()
        while active:
            rank, left, right = heapq.heappop(active)
            positions = places.pop((left, right), None)
            if positions is None:
                continue
            positions.sort()
            for p in positions:
                q = nxt[p]
                if sym[p] != left or q < 0 or sym[q] != right:
                    continue
                sym[p], sym[q] = rank, -1
                r = nxt[q]
                nxt[p] = r
                o = prv[p]
                if r >= 0:
                    prv[r] = p
                    self._add(places, active, rank, sym[r], p)
                if o >= 0:
                    self._add(places, active, sym[o], rank, o)
        done = np.array(sym)
        alive = done >= 0
        kept = done[alive].tolist()
        upto = np.cumsum(alive)[ends - 1] if len(ends) else []
        out, start = [], 0
        for r, stop in zip(raw, upto):
            stop = int(stop) if r else start
            out.append(tuple(kept[start:stop]))
            start = stop
        return out

    def _add(self, places: dict, active: list, left: int, right: int, at: int) -> None:
        rank = self._rank_of(left, right)
        if rank is None:
            return
        held = places.get((left, right))
        if held is None:
            places[left, right] = [at]
            heapq.heappush(active, (rank, left, right))
        else:
            held.append(at)

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        """The ids of each text; the words of all texts are encoded together, each once."""
        split = [self.words_of(t) for t in texts]
        new = list({w for words in split for w in words} - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list({w for words in split for w in words})
        known = self.known
        known.update(zip(new, self.encode_words(new)))
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> PairEncoder:
    return PairEncoder(path, pattern)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs ``(from, to)`` of texts with at most ``limit`` characters, or one text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def token_ids(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, count_only: bool = False
) -> DataFrame:
    """``key`` and ``ids`` (array of int) of each row's text, without special tokens.

    ``path`` is a rank file (default: the byte-level vocabulary of 50,257 ids), ``pattern`` splits
    text into words. A null or empty text has the empty list. Strings of special tokens are
    ordinary text. Whole texts are encoded whatever their length; repeated rows and repeated keys
    give one row each; an empty table gives an empty result; other columns are not read. With
    ``count_only`` the result is ``key`` and ``n_tokens`` instead.
    """
    if path is None:
        path = vocabulary_path()
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids = coder.encode(texts[a:b])
                sizes = np.fromiter(map(len, ids), np.int32, b - a)
                if count_only:
                    value = pa.array(sizes)
                else:
                    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    value = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), value], names=["k", "v"])

    out = spread(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))).mapInArrow(
        run, f"k {key_type}, v int" if count_only else f"k {key_type}, v array<int>"
    )
    return out.select(F.col("k").alias(key), F.col("v").alias("n_tokens" if count_only else "ids"))
