"""Benchmark decontamination by a prefix-filtered set join.

A window is size consecutive words of a benchmark item (all of a shorter item). Its tokens are its
shingles of up to five words. An exact occurrence must hold every token, so one token is a
sufficient prefix: the window's rarest, by its count over all documents. Documents meet windows
only at that token; the window's place follows from the token's offset in it, and must fit the
document (positional and length bounds). The rest is verified word for word through the tokens at
all other offsets.

The benchmark is taken in parts of at most PART_CHARS characters (one item at least), each sent to
all tasks; a larger benchmark means more passes over the documents, not larger parts.

Nulls: a null text has no words; an item without words is never met; a null item_id is ignored.
Items with equal ids count once. Repeated document rows each give a row. Ties: of equally rare tokens the first
in the window is its prefix, which decides no hit. Very long texts are read whole, a text at a time. Empty tables: no
rows, or rows with nothing hit. Other columns are ignored, or kept as they are by clean, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, group_starts, keep, table_lower_words

SHINGLE = 5
PART_CHARS = 8_000_000
_MAP = table_lower_words()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_MAP).split()


@dataclass
class Tokens:
    """Shingles of a part of the benchmark, built word by word so that their numbers are exact."""

    words: dict[bytes, int]  #: from 1; 0 is any other word
    levels: list[np.ndarray]  #: for each length from 2: sorted codes (shorter shingle, next word)
    first: list[int]  #: for each length from 1: number of the first token of the length

    @staticmethod
    def of(words: dict[bytes, int], codes: list[np.ndarray]) -> Tokens:
        """codes: the items' words by number."""
        levels: list[np.ndarray] = []
        now, first, count = codes, [0], len(words) + 1
        for k in range(2, SHINGLE + 1):
            first.append(first[-1] + count)
            pairs = [n[: max(0, len(c) - k + 1)] * (len(words) + 1) + c[k - 1 :] if len(c) >= k else c[:0] for n, c in zip(now, codes, strict=True)]
            levels.append(np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64))
            now = [np.searchsorted(levels[-1], p) + 1 for p in pairs]
            count = len(levels[-1]) + 1
        return Tokens(words, levels, first)

    @property
    def total(self) -> int:
        """Numbers of all tokens are below."""
        return self.first[-1] + len(self.levels[-1]) + 2

    def at(self, codes: np.ndarray, lengths: set[int]) -> dict[int, np.ndarray]:
        """For each length: the token that starts at each word, -1 where there is none."""
        out, now, start = {}, codes, np.flatnonzero(codes)
        now = codes[start]
        for k in range(1, max(lengths, default=0) + 1):
            if k > 1:
                level = self.levels[k - 2]
                fits = start + k - 1 < len(codes)
                start, now = start[fits], now[fits]
                code = now * (len(self.words) + 1) + codes[start + k - 1]
                found = np.searchsorted(level, code)
                found[found == len(level)] = 0
                good = level[found] == code if len(level) else np.zeros(len(code), bool)
                start, now = start[good], found[good] + 1
            if k in lengths:
                out[k] = np.full(len(codes), -1, np.int64)
                out[k][start] = self.first[k - 1] + now
        return out


@dataclass
class Prefixes:
    """Windows by their rarest token."""

    tokens: np.ndarray  #: sorted, each once
    starts: np.ndarray  #: where each one's windows begin, and where the last one's end
    windows: np.ndarray
    offsets: np.ndarray  #: of the token in each window


@dataclass
class Part:
    """Windows of some items, as arrays. Windows of the same words are one."""

    tokens: Tokens
    windows: np.ndarray  #: tokens at offsets 0, 1, ... of each window; -1 beyond its last
    sizes: np.ndarray  #: words in each window
    owners: np.ndarray  #: numbers of the items that have each window, window by window
    starts: np.ndarray  #: where each window's owners begin, and where the last one's end
    ids: list[str]
    lengths: set[int]  #: of tokens

    @staticmethod
    def of(rows: list[tuple[str, bytes]], size: int) -> Part:
        words: dict[bytes, int] = {}
        names, codes = [], []
        for i, text in sorted(rows):
            found = words_of(text)
            if found:
                names.append(i)
                codes.append(np.fromiter((words.setdefault(w, len(words) + 1) for w in found), np.int64, len(found)))
        tokens = Tokens.of(words, codes)
        ids = sorted(set(names))
        number = {x: k for k, x in enumerate(ids)}
        lengths = {min(SHINGLE, size, len(c)) for c in codes}
        # by words in a window: the windows of all items that have such, a row each
        rows_of: dict[int, list[np.ndarray]] = {}
        owner_of: dict[int, list[np.ndarray]] = {}
        for i, c in zip(names, codes, strict=True):
            n = min(size, len(c))
            k = min(SHINGLE, n)
            at = tokens.at(c, {k})[k][: len(c) - k + 1].astype(np.int32)
            rows_of.setdefault(n, []).append(np.lib.stride_tricks.sliding_window_view(at, n - k + 1))
            owner_of.setdefault(n, []).append(np.full(len(c) - n + 1, number[i], np.int64))
        wide = max((x[0].shape[1] for x in rows_of.values()), default=1)
        parts, owners, before = [], [], 0
        for n in sorted(rows_of):
            every = np.ascontiguousarray(np.concatenate(rows_of.pop(n)))
            keys, which = np.unique(every.view(f"V{4 * every.shape[1]}").ravel(), return_inverse=True)
            one = np.full((len(keys), wide), -1, np.int32)
            one[:, : every.shape[1]] = keys.view(np.int32).reshape(len(keys), -1)
            parts.append((one, np.full(len(keys), n, np.int32)))
            owners.append(np.unique((which.ravel() + before) * max(1, len(ids)) + np.concatenate(owner_of.pop(n))))
            before += len(keys)
        pairs = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        window, owner = np.divmod(pairs, max(1, len(ids)))
        empty = np.zeros((0, wide), np.int32)
        return Part(
            tokens, np.concatenate([x for x, _ in parts]) if parts else empty, np.concatenate([n for _, n in parts]) if parts else empty[:, 0],
            owner.astype(np.int32), np.searchsorted(window, np.arange(before + 1)), ids, lengths,
        )

    def prefixes(self, counts: np.ndarray) -> Prefixes:
        """Windows by their rarest token (of equally rare ones the first); counts: how many each token has. Windows that no document can hold are left out."""
        some = [np.zeros(0, np.int64)] * 3
        for at in range(0, len(self.windows), 1 << 16):
            rows = self.windows[at : at + (1 << 16)]
            offset = np.argmin(np.where(rows >= 0, counts[rows], np.iinfo(np.int64).max), axis=1)
            token = rows[np.arange(len(rows)), offset]
            there = np.flatnonzero(counts[token])
            some = [np.append(a, b) for a, b in zip(some, (token[there], there + at, offset[there]), strict=True)]
        order = np.argsort(some[0], kind="stable")
        token = some[0][order]
        starts = group_starts(token)
        return Prefixes(token[starts], np.append(starts, len(token)), some[1][order], some[2][order])

    def verified(self, at: np.ndarray, token: np.ndarray, n_words: int, prefixes: Prefixes) -> tuple[dict[int, int], set[int]]:
        """Start -> length of the windows that a document holds, and the items' numbers."""
        hits: dict[int, int] = {}
        got: set[int] = set()
        found = np.minimum(np.searchsorted(prefixes.tokens, token), len(prefixes.tokens) - 1)
        met = np.flatnonzero(prefixes.tokens[found] == token)
        pairs = set(zip(at.tolist(), token.tolist(), strict=True)) if len(met) else set()
        for i, r in zip(met.tolist(), found[met].tolist(), strict=True):
            for p in range(prefixes.starts[r], prefixes.starts[r + 1]):
                w = prefixes.windows[p]
                start, n = int(at[i] - prefixes.offsets[p]), int(self.sizes[w])
                if start < 0 or start + n > n_words:
                    continue
                if all((start + j, x) in pairs for j, x in enumerate(self.windows[w].tolist()) if x >= 0):
                    hits[start] = max(n, hits.get(start, 0))
                    got.update(self.owners[self.starts[w] : self.starts[w + 1]].tolist())
        return hits, got


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items, some at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("binary").alias("data")).where("id IS NOT NULL AND data IS NOT NULL").distinct()
    some: list[tuple[str, bytes]] = []
    for x in rows.toLocalIterator():
        if some and sum(len(t) for _, t in some) + len(x.data) > PART_CHARS:
            yield some
            some = []
        some.append((x.id, bytes(x.data)))
    if some:
        yield some


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark(F.col("text")).alias("mark"), F.col("text").cast("binary").alias("data"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, mark, n_words, n_hit, runs (first word and length of maximal hit runs), item_ids; one row for each document row.

    mark is a hash of the text.
    """
    given = _documents(docs)
    parts = _parts(benchmark)
    first = next(parts, [])
    second = next(parts, None)
    if second is None:  # one pass tells all; no second Python worker is needed for its runs
        return _occurrences(given, first, size, _runs, _RUNS)
    found = [_occurrences(given, rows, size) for rows in chain([first, second], parts)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    merged = every.groupBy("doc_id", "mark").agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("lengths")).alias("lengths"),
        F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
        (F.count("*") / len(found)).cast("int").alias("times"),
    )
    return merged.mapInArrow(_runs, _RUNS)


_FOUND = "doc_id long, mark long, n_words long, starts array<long>, lengths array<long>, item_ids array<string>"
_RUNS = "doc_id long, mark long, n_words long, n_hit long, runs array<struct<start:long,length:long>>, item_ids array<string>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for batch in few(batches):
        out: dict[str, list] = {x: [] for x in ("doc_id", "mark", "n_words", "n_hit", "runs", "item_ids")}
        for row in batch.to_pylist():
            runs: list[dict[str, int]] = []
            for start, length in sorted(zip(row["starts"], row["lengths"], strict=True)):
                if runs and start <= runs[-1]["start"] + runs[-1]["length"]:
                    runs[-1]["length"] = max(runs[-1]["length"], start + length - runs[-1]["start"])
                else:
                    runs.append({"start": start, "length": length})
            row |= {"runs": runs, "n_hit": sum(x["length"] for x in runs), "item_ids": sorted(row["item_ids"])}
            for x in out:
                out[x] += [row[x]] * row.get("times", 1)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(out[x], pa.int64()) for x in ("doc_id", "mark", "n_words", "n_hit")), pa.array(out["runs"], kind), pa.array(out["item_ids"], pa.list_(pa.string()))], list(out)
        )


def _occurrences(given: DataFrame, items: list[tuple[str, bytes]], size: int, then: Callable = iter, schema: str = _FOUND) -> DataFrame:
    """doc_id, mark, n_words, starts, lengths, item_ids of one part of the benchmark; or what then makes of them."""
    part = given.sparkSession.sparkContext.broadcast(Part.of(items, size))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, lengths = part.value.tokens, part.value.lengths
        number = tokens.words.get
        for batch in few(batches):
            words = [words_of(x) for x in batch["data"].to_pylist()]
            # one word that no item has parts the documents
            codes = np.fromiter((number(w, 0) for doc in words for w in (*doc, b"")), np.int64)
            starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
            at, token = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for found in tokens.at(codes, lengths).values():
                at.append(np.flatnonzero(found >= 0))
                token.append(found[at[-1]])
            where, what = np.concatenate(at), np.concatenate(token)
            order = np.argsort(where, kind="stable")
            where, what = where[order], what[order]
            cuts = np.searchsorted(where, starts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "mark": batch["mark"],
                    "n_words": pa.array(np.diff(starts) - 1),
                    "at": pa.array([(where[a:b] - s).astype("<i8").tobytes() for a, b, s in zip(cuts, cuts[1:], starts, strict=False)], pa.binary()),
                    "token": pa.array([what[a:b].astype("<i8").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                }
            )

    met = keep(given.mapInArrow(read, "doc_id long, mark long, n_words long, at binary, token binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            tokens, n = np.unique(np.frombuffer(b"".join(batch["token"].to_pylist()), "<i8"), return_counts=True)
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array(n, pa.int64())})

    # as many rows as the part has tokens, at most
    counted = met.select("token").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(part.value.tokens.total, np.int64)
    counts[counted["token"].to_numpy()] = counted["n"].to_numpy()
    prefixes = given.sparkSession.sparkContext.broadcast(part.value.prefixes(counts))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, prefix = part.value, prefixes.value
        for batch in few(batches):
            starts, lengths, items = [], [], []
            for n_words, a, t in zip(*(batch[x].to_pylist() for x in ("n_words", "at", "token")), strict=True):
                at, token = np.frombuffer(a, "<i8"), np.frombuffer(t, "<i8")
                hits, got = p.verified(at, token, n_words, prefix) if len(at) and len(prefix.tokens) else ({}, set())
                starts.append(list(hits))
                lengths.append(list(hits.values()))
                items.append([p.ids[k] for k in got])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["mark"], batch["n_words"], pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "mark", "n_words", "starts", "lengths", "item_ids"],
            )

    return met.mapInArrow(lambda batches: then(match(batches)), schema)


def digest(result: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return result.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs, all columns, without those that hold a window of the benchmark."""
    bad = decontaminate(docs.select("doc_id", "text"), benchmark, size).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (_mark(docs["text"]) == bad["_mark"])
    return docs.join(bad, same, "left_anti")


def _mark(text: Column) -> Column:
    return F.xxhash64(text)
