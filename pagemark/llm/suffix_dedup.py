"""Exact substring deduplication over bytes, by bucket-pointer refinement of sampled suffixes.

A byte goes if a string of min_bytes bytes covers it that also starts in a document with a smaller
doc_id. Suffixes of all documents are first put in buckets by a q-gram; every string of min_bytes
bytes is represented by the suffix that starts at its least q-gram (by hash), so equal strings
meet in one bucket. Buckets of one document are done. The rest are refined, each inside its own bucket only: first
by the names of the strings at the fixed outermost offsets, which together span all strings that the suffix
represents: where these agree with a smaller document, all strings are repeats at once. Buckets
that this splits are refined once more, at the full depth of min_bytes bytes. Each refinement works
only on what the one before left open. A name of 2k bytes is made of the names of k bytes at an
offset and k bytes later, down to single bytes, so names of short strings serve those of longer ones.

Names are hashes, alike in all documents, not ranks: no suffix is sorted among all others. A string is named by 39 bits for
its bucket and 64 for its bytes; two different ones are confused with a chance of 2**-64 for each pair that
shares a least q-gram, and of 2**-103 for any other.

Nulls: a null text is empty and null ids count as larger than all others. Ties, repeated rows: rows with
the same doc_id never remove each other's bytes; each gives its own result row. Texts shorter than
min_bytes stay whole. Very long texts are worked on whole, in one block of their own size. An empty table
gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import join2, numbered

#: Bytes of documents that are hashed in one go, to stay in the processor's cache.
CHUNK = 1 << 17
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary"
RESULT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        ("kept", pa.binary()),
    ]
)
_LETTER = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Chunk:
    """Hashes of some documents that lie one after the other."""

    first: int  #: number of the first document in the block
    bounds: np.ndarray  #: where documents start and the last ends
    doc: np.ndarray  #: number of the document, by position of a string's start
    valid: np.ndarray  #: a string starts here and ends in the same document
    gram: np.ndarray  #: hash of the q-gram
    least: np.ndarray  #: hash of the least q-gram of the string
    level: np.ndarray  #: hash of the longest string of a power of two bytes that fits in the string
    run: np.ndarray  #: where the least q-gram or the document changes, by position of a string's start

    def of_runs(self, values: np.ndarray) -> np.ndarray:
        """Values of the runs, for each position."""
        return np.repeat(values, np.diff(np.append(self.run, len(self.least))))

    def hashes(self, length: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the strings that start at at; length: once to twice that of level."""
        rest = length - (1 << (length.bit_length() - 1))
        return join2(self.level[at], self.level[at + rest]) if rest else self.level[at]


def gram_size(min_bytes: int) -> int:
    """Short enough for samples to be few, long enough for chance repeats to be rare."""
    return max(1, min_bytes // 2 - 1)


def chunks(data: list[bytes], min_bytes: int) -> Iterator[Chunk]:
    first = 0
    while first < len(data):
        last, size = first, 0
        while last < len(data) and (last == first or size + len(data[last]) <= CHUNK):
            size += len(data[last])
            last += 1
        if size >= min_bytes:
            sizes = np.array([len(x) for x in data[first:last]], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            n, q = size - min_bytes + 1, gram_size(min_bytes)
            level, k, gram = _LETTER[np.frombuffer(b"".join(data[first:last]), np.uint8)], 1, None
            while True:
                if k <= q < 2 * k:
                    gram = join2(level[: len(level) - q + k], level[q - k :]) if q > k else level
                if 2 * k > min_bytes:
                    break
                level, k = join2(level[:-k], level[k:]), 2 * k
            w = min_bytes - q + 1
            low, span = gram, 1
            while 2 * span <= w:
                low, span = np.minimum(low[:-span], low[span:]), 2 * span
            least = np.minimum(low[:n], low[w - span : w - span + n])
            doc = np.repeat(np.arange(first, last, dtype=np.int32), sizes)
            run = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1])))
            yield Chunk(first, bounds, doc[:n], doc[:n] == doc[min_bytes - 1 :], gram, least, level, run)
        first = last


class Block:
    """One block's documents, step by step."""

    def __init__(self, tab: pa.Table, min_bytes: int, buckets: int):
        self.order, self.data, self.ids = B.block_rows(tab)
        self.size, self.buckets = min_bytes, buckets
        self.chunks = list(chunks(self.data, min_bytes))

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the first refinement: least q-grams, and whether several documents here have each."""
        # a document's strings come before those that reach over its end
        starts = [c.run[c.valid[c.run]] for c in self.chunks]
        name = np.concatenate([np.zeros(0, np.uint64), *(c.least[at] for c, at in zip(self.chunks, starts, strict=True))])
        doc = np.concatenate([np.zeros(0, np.int64), *(self.order[c.doc[at]] for c, at in zip(self.chunks, starts, strict=True))])
        (self.distinct,), _, several, which = numbered(doc, name)
        self.which = np.split(which, np.cumsum([len(x) for x in starts]))[: len(starts)]  #: number of the bucket of each run with strings
        return self.distinct, several

    def strings_in(self, buckets: np.ndarray, k: int) -> np.ndarray:
        """Strings of a chunk whose buckets are among some (a truth value for each bucket)."""
        c = self.chunks[k]
        there = c.valid[c.run]
        of_run = np.zeros(len(c.run), bool)
        of_run[there] = buckets[self.which[k]]
        return c.valid & c.of_runs(of_run)

    def suffixes(self, open_: np.ndarray, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled suffixes in open buckets: position, bucket, key of what all their strings span (0 if cut off), first and last string."""
        n, w = len(c.valid), self.size - gram_size(self.size) + 1
        top = np.where(open_, c.least, np.uint64(0))
        pad = np.zeros(w - 1, np.uint64)
        high, span = np.concatenate([pad, top, pad]), 1
        while 2 * span <= w:
            high, span = np.maximum(high[:-span], high[span:]), 2 * span
        m = min(len(c.gram), n + w - 1)
        reach = np.maximum(high[:m], high[w - span : w - span + m])
        at = np.flatnonzero((reach == c.gram[:m]) & (reach != 0))
        doc = np.searchsorted(c.bounds, at, "right") - 1
        lo = np.maximum(at - w + 1, c.bounds[doc])
        hi = np.minimum(at, c.bounds[doc + 1] - self.size)
        whole = (lo == at - w + 1) & (hi == at)
        key = np.zeros(len(at), np.uint64)
        some = lo[whole]
        key[whole] = join2(c.hashes(self.size, some), c.hashes(self.size, some + w - 1)) | np.uint64(1)
        return at, c.gram[at], key, lo, hi

    def spans(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Second refinement: distinct (bucket, key) of the suffixes, and their smallest document."""
        names, keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        self.found = [self.suffixes(self.strings_in(kept, k), c) for k, c in enumerate(self.chunks)]
        for c, (_, name, key, lo, _) in zip(self.chunks, self.found, strict=True):
            names.append(name)
            keys.append(key)
            docs.append(self.order[c.doc[lo]])
        (name, key), doc, _ = B.least((np.concatenate(names), np.concatenate(keys)), np.concatenate(docs))
        return name, key, doc

    def after_spans(self, replies: dict[int, bytes], name: np.ndarray, key: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
        """For each chunk: strings found to be repeats, and those that are still open."""
        bits = B.answered(replies, self.buckets, name, 2)
        split = np.zeros(len(self.distinct), bool)
        split[np.searchsorted(self.distinct, np.unique(name[bits[:, 1]]))] = True
        pair = join2(name, key)
        order = np.argsort(pair)
        pair = pair[order]
        for i, c in enumerate(self.chunks):
            _, nm, k, lo, hi = self.found[i]
            found = np.searchsorted(pair, join2(nm, k))
            which = order[found] if len(order) else found
            mine = self.order[c.doc[lo]]
            gone = (k != 0) & (bits[which, 0] | (doc[which] < mine)) if len(order) else np.zeros(0, bool)
            delta = np.zeros(len(c.valid) + 1, np.int32)
            np.add.at(delta, lo[gone], 1)
            np.add.at(delta, hi[gone] + 1, -1)
            repeat = np.cumsum(delta[:-1]) > 0
            yield c, repeat, ~repeat & self.strings_in(split, i)

    def strings(self, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Third refinement: bucket, hash and smallest document of the distinct open strings, and which of them each open string is."""
        at = [np.flatnonzero(still) for _, _, still in parts]
        some = [(c.least[x], c.hashes(self.size, x), self.order[c.doc[x]]) for (c, _, _), x in zip(parts, at, strict=True)]
        name, key, doc = (np.concatenate([np.zeros(0, kind), *(x[k] for x in some)]) for k, kind in enumerate((np.uint64, np.uint64, np.int64)))
        (name, key), doc, _, which = numbered(doc, name, key)
        return name, key, doc, which


def suffix_dedup(docs: DataFrame, min_bytes: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start and length of maximal removed runs), kept (the bytes that stay)."""
    if min_bytes < 4:
        raise ValueError("min_bytes must be 4 at least")
    given, buckets = B.dealt(docs)

    def first(block: int, tab: pa.Table, _: dict) -> Iterator[dict]:
        names, several = Block(tab, min_bytes, buckets).names()
        yield from B.asked(block, buckets, names, several)

    def opened(b: Block, got: dict) -> np.ndarray:
        names, _ = b.names()
        return B.answered(got.get(1, {}), buckets, names, 1)[:, 0]

    def second(block: int, tab: pa.Table, got: dict) -> Iterator[dict]:
        b = Block(tab, min_bytes, buckets)
        name, key, doc = b.spans(opened(b, got))
        yield from B.asked(block, buckets, name, None, key, doc)

    def parts(b: Block, got: dict) -> list[tuple]:
        return list(b.after_spans(got.get(2, {}), *b.spans(opened(b, got))))

    def third(block: int, tab: pa.Table, got: dict) -> Iterator[dict]:
        b = Block(tab, min_bytes, buckets)
        name, key, doc, _ = b.strings(parts(b, got))
        yield from B.asked(block, buckets, name, None, key, doc)

    def last(block: int, tab: pa.Table, got: dict) -> Iterator[dict]:
        b = Block(tab, min_bytes, buckets)
        known = parts(b, got)
        name, _, doc, which = b.strings(known)
        bits = B.answered(got.get(3, {}), buckets, name, 2)[:, 0]
        done = past = 0
        for c, repeat, still in known:
            at = np.flatnonzero(still)
            mine = which[past : past + len(at)]
            past += len(at)
            repeat[at[bits[mine] | (doc[mine] < b.order[c.doc[at]])]] = True
            delta = np.zeros(int(c.bounds[-1]) + 1, np.int32)
            starts = np.flatnonzero(repeat & c.valid)
            np.add.at(delta, starts, 1)
            np.add.at(delta, starts + min_bytes, -1)
            gone = np.cumsum(delta[:-1]) > 0
            yield from rows(b, range(done, c.first), None, None)
            done = c.first + len(c.bounds) - 1
            yield from rows(b, range(c.first, done), c.bounds, gone)
        yield from rows(b, range(done, len(b.data)), None, None)

    replies = B.shared(B.each_block(given, None, first, B.REQUEST, B.REQUEST_ARROW), 1)
    for step, work in ((2, second), (3, third)):
        asked = B.each_block(given, replies, work, B.REQUEST, B.REQUEST_ARROW)
        replies = replies.unionByName(B.smaller(asked, step))
    return B.each_block(given, replies, last, RESULT, RESULT_ARROW)


def rows(b: Block, numbers: range, bounds: np.ndarray | None, gone: np.ndarray | None) -> Iterator[dict]:
    for k, i in enumerate(numbers):
        data, spans = b.data[i], []
        if gone is not None:
            own = gone[bounds[k] : bounds[k + 1]]
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                spans = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                data = np.frombuffer(data, np.uint8)[~own].tobytes()
        yield {"doc_id": b.ids[i], "n_bytes": len(b.data[i]), "n_removed": len(b.data[i]) - len(data), "spans": spans, "kept": data}


def digest(result: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return result.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
