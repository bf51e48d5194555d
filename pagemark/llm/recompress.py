"""Exact removal of repeated word windows, by recompression.

A word goes if a window of size words covers it whose words also start in a document with a
smaller doc_id. Each document's words are recompressed in rounds: in the first, runs of one symbol become
symbols; in each, pairs of neighbouring symbols (one of the left, one of the right half of the alphabet,
by a hash of the symbol) do. Each symbol carries the span of words that decided it, so that equal
windows have equal symbols wherever that span lies inside, and is named by it, alike in all documents.

After each round all documents are asked which names of open symbols several of them share. A
symbol that no other document shares is closed: it never pairs again, rules out all windows around
it, and nothing that holds it is asked about later. So the symbols of later rounds, longer and fewer, are
shared ones only, and reveal where repeats can be. The windows that have no closed symbol inside are
then compared whole across all documents, by a second, independent hash of their words besides the first.

Names are hashes. Symbols have 64 bits, and when two collide they only fail to be closed. Words have 64 bits, and windows
of different words 103; two of n words are confused with a chance of n * n / 2**65, two of n windows with n * n / 2**104.

Nulls: a null text has no words and null ids count as larger than all others. Ties, repeated rows: rows
with the same doc_id never remove each other's words; each gives its own result row. Texts with
fewer words than size stay whole. Very long texts are worked on whole, in one block of their own size. An
empty table gives an empty result. Other columns are ignored, or kept as they are by without_repeats, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import Sums, join2, mix, numbered, word_hashes

RESULT = "doc_id long, mark long, n_words long, n_removed long, kept string"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
#: Rounds of pairing; a symbol spans up to 2 ** ROUNDS words, which must leave room in a window.
ROUNDS = 2
_RUN = np.uint64(0xD6E8FEB86659FD93)


class Symbols:
    """Symbols of some documents, one after the other; bounds: where documents start and the last ends."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        # an edge between documents is a symbol of its own: it never pairs, and no window reaches over it
        edges = np.unique(bounds)
        at = np.arange(len(words)) + np.searchsorted(edges, np.arange(len(words)), "right")
        total = len(words) + len(edges)
        held = np.zeros(total, np.uint64)
        held[at] = words
        self.sums = Sums(held)
        self.name, self.edge = np.zeros(total, np.uint64), np.ones(total, bool)
        self.name[at] = words
        self.edge[at] = False
        self.lo = np.arange(total)
        self.hi = self.lo + 1
        # places back to words; spans that include an edge are inside no window
        self.before = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=total) == 0)])

    def runs(self) -> None:
        name, edge = self.name, self.edge
        same = np.zeros(len(name), bool)
        same[1:] = (name[1:] == name[:-1]) & ~edge[1:] & ~edge[:-1]
        first = np.flatnonzero(~same)
        size = np.diff(np.append(first, len(name)))
        last = first + size - 1
        self.name, self.edge = np.where(size > 1, join2(name[first], size.astype(np.uint64) * _RUN), name[first]), edge[first]
        # that a run ends is decided by the words beside it
        self.lo, self.hi = np.maximum(self.lo[first] - 1, 0), np.minimum(self.hi[last] + 1, len(self.before) - 1)

    def pairs(self, step: int) -> None:
        name, edge, lo, hi = self.name, self.edge, self.lo, self.hi
        right = (mix(name ^ np.uint64(step)) & np.uint64(1)).astype(bool)
        pair, second = np.zeros(len(name), bool), np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~edge[:-1] & ~edge[1:]
        second[1:] = pair[:-1]
        alone = ~pair & ~second & ~edge
        low, high = lo.copy(), hi.copy()
        waits = np.flatnonzero(alone & ~right)
        high[waits] = hi[np.minimum(waits + 1, len(hi) - 1)]
        waits = np.flatnonzero(alone & right)
        low[waits] = lo[np.maximum(waits - 1, 0)]
        k = np.flatnonzero(pair)
        self.name = name.copy()
        self.name[k] = join2(name[k], name[k + 1])
        high[k] = hi[k + 1]
        stay = ~second
        self.name, self.edge, self.lo, self.hi = self.name[stay], edge[stay], low[stay], high[stay]

    def open(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which symbols' spans fit in a window, and the names of those spans: all their words."""
        at = np.flatnonzero(~self.edge & (self.hi - self.lo <= size) & (self.before[self.hi] == self.before[self.lo]))
        return at, self.sums.of(self.lo[at], self.hi[at])

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end word of symbols."""
        return self.lo[at] - self.before[self.lo[at]], self.hi[at] - self.before[self.hi[at]]


class Block:
    """One block's documents, round by round."""

    def __init__(self, tab: pa.Table, size: int, buckets: int):
        self.order, self.data, self.ids = B.block_rows(tab)
        self.size, self.buckets = size, buckets
        self.words, self.counts = word_hashes(self.data)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        n = max(0, len(self.words) - size + 1)
        self.valid = self.doc[:n] == self.doc[size - 1 : size - 1 + n]
        self.closed = np.zeros(n + 1, np.int32)  #: by start of a window, as differences: closed symbols inside
        self.symbols, self.done = Symbols(self.words, self.bounds), 0

    def next_round(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Open symbols after one more round, distinct names of theirs, whether several documents here have each, and which name each symbol has."""
        if not self.done:
            self.symbols.runs()
        self.symbols.pairs(self.done)
        self.done += 1
        at, name = self.symbols.open(self.size)
        (names,), _, several, which = numbered(self.order[self.doc[self.symbols.spans(at)[0]]], name)
        return at, names, several, which

    def close(self, at: np.ndarray, off: np.ndarray) -> None:
        """Close those of the symbols whose names no other document has."""
        at = at[off]
        lo, hi = self.symbols.spans(at)
        n = len(self.valid)
        self.closed += np.bincount(np.minimum(np.maximum(hi - self.size, 0), n), minlength=n + 1).astype(np.int32)
        self.closed -= np.bincount(np.minimum(lo + 1, n), minlength=n + 1).astype(np.int32)
        self.symbols.edge[at] = True

    def replay(self, replies: dict[int, dict[int, bytes]], rounds: int) -> None:
        """Do the first rounds, which have been answered."""
        for step in range(1, rounds + 1):
            at, names, _, which = self.next_round()
            self.close(at, ~B.answered(replies.get(step, {}), self.buckets, names, 1)[which, 0])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and two names of the windows without a closed symbol."""
        at = np.flatnonzero(self.valid & (np.cumsum(self.closed[:-1]) == 0))
        name = Sums(self.words).of(at, at + self.size)
        return at, name, Sums(~self.words, 1).of(at, at + self.size)


def remove_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, mark (Spark's xxhash64 of the text), n_words, n_removed, kept (the words that stay, joined by one space)."""
    if size < 6:
        raise ValueError("size must be 6 at least")
    given, buckets = B.dealt(docs)

    def named(step: int) -> Callable:
        def work(block: int, tab: pa.Table, got: dict) -> Iterator[dict]:
            b = Block(tab, size, buckets)
            b.replay(got, step - 1)
            _, names, several, _ = b.next_round()
            yield from B.asked(block, buckets, names, several)

        return work

    def open_windows(tab: pa.Table, got: dict) -> tuple:
        b = Block(tab, size, buckets)
        b.replay(got, ROUNDS)
        at, window, check = b.windows()
        (check, window), doc, _, which = numbered(b.order[b.doc[at]], check, window)
        return b, at, check, window, doc, which

    def whole(block: int, tab: pa.Table, got: dict) -> Iterator[dict]:
        _, _, check, window, doc, _ = open_windows(tab, got)
        yield from B.asked(block, buckets, check, None, window, doc)

    def last(block: int, tab: pa.Table, got: dict) -> Iterator[dict]:
        b, at, check, _, doc, which = open_windows(tab, got)
        repeat = at[B.answered(got.get(ROUNDS + 1, {}), buckets, check, 2)[which, 0] | (doc[which] < b.order[b.doc[at]])]
        delta = np.zeros(len(b.words) + 1, np.int32)
        np.add.at(delta, repeat, 1)
        np.add.at(delta, repeat + size, -1)
        stay = np.cumsum(delta[:-1]) == 0
        for i, data in enumerate(b.data):
            own, words = stay[b.bounds[i] : b.bounds[i + 1]], data.split()
            kept = words if own.all() else [words[j] for j in np.flatnonzero(own)]
            yield {"doc_id": b.ids[i], "mark": _mark(data), "n_words": len(words), "n_removed": len(words) - len(kept), "kept": b" ".join(kept).decode("utf-8", "replace")}

    replies = B.shared(B.each_block(given, None, named(1), B.REQUEST, B.REQUEST_ARROW), 1)
    for step in range(2, ROUNDS + 1):
        replies = replies.unionByName(B.shared(B.each_block(given, replies, named(step), B.REQUEST, B.REQUEST_ARROW), step))
    replies = replies.unionByName(B.smaller(B.each_block(given, replies, whole, B.REQUEST, B.REQUEST_ARROW), ROUNDS + 1))
    return B.each_block(given, replies, last, RESULT, RESULT_ARROW)


def _mark(data: bytes) -> int:
    value = xxhash.xxh64_intdigest(data, 42)
    return value - (1 << 64) if value >> 63 else value


def digest(result: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """docs, all columns, with repeated words taken out of text, and n_chars brought up to date; other texts stay as they are."""
    cut = remove_repeats(docs.select("doc_id", "text"), size).where("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("kept").alias("_kept")).dropDuplicates(["_id", "_mark"])
    same = docs["doc_id"].cast("long").eqNullSafe(cut["_id"]) & (F.xxhash64(docs["text"]) == cut["_mark"])
    both = docs.join(cut, same, "left")
    text = F.coalesce(cut["_kept"], docs["text"])
    new = {"text": text, "n_chars": F.when(cut["_kept"].isNull(), docs["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return both.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))
