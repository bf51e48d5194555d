"""Packing of tokenised documents into as few sequences as possible, by bin completion.

Documents are tokenised once; what does not fit a sequence is cut into full pieces, of which only
the first may be shorter. Only the lengths matter for packing, and there are at most as many as a
sequence has tokens, so the plan is made from their counts: take the longest piece left and
enumerate, by rising waste, the undominated fillings of the rest of its sequence. A filling is
dominated if some of its pieces can give way to one longer piece that is left, or several to one as
long. Best-fit packing gives the first incumbent; branch and bound over the fillings, each repeated as often
as the counts allow or less often, looks for a better one and drops a branch as soon as its waste
cannot beat the incumbent. It stops when a lower bound is met, or after STEPS fillings. As the search from the top never comes back
to its first sequences, the best plan so far is then completed anew in places, RESTARTS times: a few of its sequences, a loose one among them, are taken
apart and filled again around the largest piece each time, by fillings of least waste; what needs fewer sequences, or as many
with the waste more in one place, takes their place, and where it needs fewer in all copies of them. A Plan tells its sequences and the bound, so that the gap is known. A plan is a list of sequence shapes with a
number of copies each: its size does not grow with the corpus. Every piece then finds its place
from its rank among the pieces of its length, by shuffles alone.

Very long texts are tokenised whole, a few texts at a time. Ties: pieces of one length take places in the
order of id, row and piece; equal plans are told apart by which was found first.

Nulls: a null text is empty; every document has one token (the end) at least. Repeated rows are
packed each. A null doc_id is kept. An empty table gives an empty result. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import json
import logging
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, keep, partitions

END = 2
ROOM = 1024
#: Fillings that branch and bound looks at; the incumbent stands if they run out, and the gap to the bound is told.
STEPS = 20_000
#: Times that some sequences are filled again, how many at most, how many of the loosest one is chosen from, and rounds between looking for those.
RESTARTS, SOME, LOOSEST, LOOK = 4_000, 8, 6, 20
# How byte-level BPE parts a text before it merges; equal in both libraries for all characters up to U+024F.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ORDINARY = "\x00-ɏ‐-‧"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


class Coder:
    """Ids of a tokenizer's file, as little-endian bytes.

    Texts of ordinary characters are encoded by the faster of two libraries where ranks say that it gives the same
    ids as the one that the file is made for; all others by that one.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            special = [x["content"] for x in json.load(file)["added_tokens"]]
        self.odd = re.compile("|".join([f"[^{ORDINARY}]", *map(re.escape, special)]))
        self.fast = None if ranks is None else tiktoken.Encoding("file", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of_file(cls, path: str, ranks: Broadcast[dict[bytes, int] | None]) -> Coder:
        """The coder of a file, made once in a worker."""
        if path not in _CODERS:
            _CODERS[path] = cls(path, ranks.value)
        return _CODERS[path]

    def of(self, text: str) -> bytes:
        if self.fast is None or self.odd.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


@lru_cache(8)
def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Ids of a byte-level BPE file's tokens, if merging by the rank of the joined token is merging by the file's list; else null.

    It is if each token, put together by tokens of lower rank alone, comes to the pair that the file lists
    for it: what is joined into a token was joined in its span as if that stood alone, as no merge has reached
    over its edges; so whenever a token is made, it is made of the listed pair.
    """
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, special = told["model"], {x["content"] for x in told["added_tokens"]}
    if told["normalizer"] or told["pre_tokenizer"] != BYTE_LEVEL or model["type"] != "BPE":
        return None
    # printable bytes stand for themselves, the others for characters from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    listed = {}
    for x in model["merges"]:
        left, right = (bytes(letter[c] for c in part) for part in (x if isinstance(x, list) else x.split(" ")))
        listed[left + right] = (left, right)
    in_order = [ranks[x] for x in listed]
    if in_order != sorted(in_order) or len(listed) != len(model["merges"]) or len(ranks) != len(listed) + 256:
        return None
    return ranks if all(_joined(token, ranks) == list(pair) for token, pair in listed.items()) else None


def _joined(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """A token's bytes joined by ranks below its own, the lowest first."""
    parts, most = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, k = min((ranks.get(a + b, most), i) for i, (a, b) in enumerate(pairwise(parts)))
        if rank >= most:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


_CODERS: dict[str, Coder] = {}


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 of each piece of each document; row is the same for pieces of one row."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    ranks = docs.sparkSession.sparkContext.broadcast(merge_ranks(tokenizer))  # of the file's tokens

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of_file(tokenizer, ranks)
        end = np.array([END], "<u4").tobytes()
        row = 0
        for batch in few(batches):
            out: dict[str, list] = {x: [] for x in ("doc_id", "row", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = coder.of(text) + end
                n, at, k = len(ids) // 4, 0, 0
                row += 1
                size = n % room or room
                while at < n:
                    out["doc_id"].append(doc_id)
                    out["row"].append(row)
                    out["piece"].append(k)
                    out["start"].append(at)
                    out["length"].append(size)
                    out["ids_crc32"].append(zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)]))
                    at, k, size = at + size, k + 1, room
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return given.mapInArrow(work, _PIECES)


Shape = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit(counts: dict[int, int], room: int) -> list[tuple[Shape, int]]:
    """Best-fit decreasing by lengths: each sequence takes the longest piece that still fits."""
    left, plan = dict(counts), []
    lengths = sorted(left)
    while lengths:
        shape: dict[int, int] = {}
        free = room
        while (k := bisect_right(lengths, free)) > 0:
            # the longest that fits and is not used up by this shape
            while k and left[lengths[k - 1]] <= shape.get(lengths[k - 1], 0):
                k -= 1
            if not k:
                break
            x = lengths[k - 1]
            many = min(free // x, left[x] - shape.get(x, 0))
            shape[x] = shape.get(x, 0) + many
            free -= many * x
        copies = min(left[x] // m for x, m in shape.items())
        plan.append((tuple(sorted(shape.items(), reverse=True)), copies))
        for x, m in shape.items():
            left[x] -= m * copies
        lengths = [x for x in lengths if left[x]]
    return plan


def lower_bound(counts: dict[int, int], room: int) -> int:
    """Sequences that are needed at least: pieces of over half the room stand alone, and what is at least so long cannot go into less room than that."""
    best = -(-sum(x * n for x, n in counts.items()) // room)
    large = {x: n for x, n in counts.items() if 2 * x > room}
    for least in (x for x in counts if 2 * x <= room):
        spare = sum((room - x) * n for x, n in large.items() if x <= room - least)
        small = sum(x * n for x, n in counts.items() if least <= x and 2 * x <= room)
        best = max(best, sum(large.values()) + max(0, -(-(small - spare) // room)))
    return max(best, sum(large.values()))


def dominated(filling: Shape, free: int, left: dict[int, int]) -> bool:
    """Can some pieces of a filling of free give way to one longer piece that is left, or several to one as long?"""
    full = (1 << (free + 1)) - 1
    one = several = 0
    for x, m in filling:  # sums of one piece and of several, as bits
        for _ in range(m):
            several |= ((several | one) << x) & full
            one |= 1 << x
    waste = free - sum(x * m for x, m in filling)
    longer = several | _shifted((several | one) << 1, waste - 1) if waste else several
    taken = dict(filling)
    return any(longer >> x & 1 for x, n in left.items() if x <= free and n > taken.get(x, 0))


def _shifted(bits: int, most: int) -> int:
    """bits moved up by 0 to most places, together."""
    done = 0
    while done < most:
        step = min(done + 1, most - done)
        bits |= bits << step
        done += step
    return bits


def fillings(free: int, left: dict[int, int]) -> Iterator[Shape]:
    """All fillings of free with the pieces left, one after the other by rising waste."""
    lengths = sorted(x for x, n in left.items() if n and x <= free)
    full = (1 << (free + 1)) - 1
    reach = [1]  # sums of the shortest lengths, as bits
    for x in lengths:
        sums, rest, many = reach[-1], left[x], 1
        while rest and x * many <= free:
            many = min(many, rest)
            sums |= (sums << (x * many)) & full
            rest, many = rest - many, 2 * many
        reach.append(sums)

    def exactly(total: int, k: int) -> Iterator[Shape]:
        if not total:
            yield ()
            return
        for j in range(min(k, bisect_right(lengths, total)), 0, -1):
            if not reach[j] >> total & 1:
                return
            x = lengths[j - 1]
            for m in range(min(left[x], total // x), 0, -1):
                if reach[j - 1] >> (total - m * x) & 1:
                    for rest in exactly(total - m * x, j - 1):
                        yield ((x, m), *rest)

    for total in range(free, -1, -1):
        if reach[-1] >> total & 1:
            yield from exactly(total, len(lengths))


@dataclass
class Plan:
    shapes: list[tuple[Shape, int]]  #: with how many copies of each
    sequences: int
    bound: int  #: sequences that any plan needs

    @property
    def gap(self) -> int:
        return self.sequences - self.bound


def _choices(left: dict[int, int], room: int) -> Iterator[tuple[Shape, int] | None]:
    """Sequences around the longest piece left, with copies from as many as there can be down to one; None for a dominated filling."""
    longest = max(x for x, n in left.items() if n)
    left[longest] -= 1
    found = fillings(room - longest, left)
    while True:
        filling = next(found, None)
        off = filling is None or dominated(filling, room - longest, left)
        left[longest] += 1  # as it was while others look at it
        if filling is None:
            return
        if off:
            yield None
        else:
            shape: dict[int, int] = {longest: 1}
            for x, m in filling:
                shape[x] = shape.get(x, 0) + m
            copies = min(left[x] // m for x, m in shape.items())
            while copies:
                yield tuple(sorted(shape.items(), reverse=True)), copies
                copies //= 2
        left[longest] -= 1


def complete(counts: dict[int, int], room: int = ROOM, steps: int = STEPS) -> Plan:
    """Shapes and copies that hold all pieces in as few sequences as found: bin completion, branch and bound."""
    total = sum(x * n for x, n in counts.items())
    bound, shapes = lower_bound(counts, room), best_fit(counts, room)
    best = sum(n for _, n in shapes)
    left, plan, used, waste = dict(counts), [], 0, 0
    open_ = [_choices(left, room)] if best > bound else []

    def take(shape: Shape, copies: int) -> None:
        nonlocal used, waste
        for x, m in shape:
            left[x] -= m * copies
        used += copies
        waste += copies * (room - sum(x * m for x, m in shape))

    while open_ and steps and best > bound:
        steps -= 1
        choice = next(open_[-1], ())
        if choice is None:
            continue
        if not choice:
            open_.pop()
            if plan:
                shape, copies = plan.pop()
                take(shape, -copies)
            continue
        take(*choice)
        if not any(left.values()) and used < best:
            best, shapes = used, [*plan, choice]
        # what is wasted for good must leave room for a better plan
        if any(left.values()) and waste <= (best - 1) * room - total:
            plan.append(choice)
            open_.append(_choices(left, room))
        else:
            take(choice[0], -choice[1])
    if best > bound:
        shapes = refilled(shapes, room, bound)
        best = sum(n for _, n in shapes)
    return Plan(shapes, best, bound)


def _filled(pool: dict[int, int], room: int, rng: random.Random) -> list[Shape]:
    """Sequences for a few pieces: around the largest one left, by one of the fillings of least waste."""
    left, out = dict(pool), []
    while there := [x for x, n in left.items() if n]:
        longest = max(there)
        left[longest] -= 1
        found = fillings(room - longest, left)
        best = next(found)
        for _ in range(rng.randrange(4)):
            other = next(found, None)
            if other is None or _size(other) < _size(best):
                break
            best = other
        shape = Counter({longest: 1})
        for x, m in best:
            left[x] -= m
            shape[x] += m
        out.append(tuple(sorted(shape.items(), reverse=True)))
    return out


def _size(shape: Shape) -> int:
    return sum(x * m for x, m in shape)


def refilled(plan: list[tuple[Shape, int]], room: int, bound: int, restarts: int = RESTARTS) -> list[tuple[Shape, int]]:
    """A plan of as many sequences or fewer, by filling a few of them again at a time. The same plan gives the same result."""
    rng, held = random.Random(1), Counter()
    for shape, n in plan:
        held[shape] += n
    total = held.total()
    for k in range(restarts):
        if total <= bound:
            break
        if k % LOOK == 0:
            keys = sorted(s for s in held if s != ((room, 1),))
            loose = sorted(keys, key=_size)[:LOOSEST]
        some = Counter(s for s in (rng.choice(loose), *(rng.choice(keys) for _ in range(rng.randrange(2, SOME)))) if held[s])
        some = Counter({s: min(m, held[s]) for s, m in some.items()})
        pool: Counter[int] = Counter()
        for shape, n in some.items():
            for x, m in shape:
                pool[x] += m * n
        new = Counter(_filled(pool, room, rng))
        tight = lambda plan: sum(_size(s) ** 2 * n for s, n in plan.items())
        fewer = some.total() - new.total()
        if fewer < 0 or fewer == 0 and tight(new) < tight(some):
            continue
        times = min(held[s] // n for s, n in some.items()) if fewer else 1
        for s, n in some.items():
            held[s] -= n * times
        for s in [s for s in some if not held[s]]:
            del held[s]
        for s, n in new.items():
            held[s] += n * times
        total -= fewer * times
    return sorted(held.items())


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    cut = keep(pieces(docs, tokenizer, room).withColumn("part", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(4 * partitions(docs.sparkSession))).cast("int")))
    # how many of each length there are in each part: lengths times parts, however large the corpus
    there = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = dict(there.groupBy("length").agg(F.sum("n")).collect())
    plan = complete(counts, room)
    logging.getLogger(__name__).info("%d sequences; no plan needs fewer than %d", plan.sequences, plan.bound)
    spark = docs.sparkSession
    slots, taken, base = [], dict.fromkeys(counts, 0), 0
    for shape, copies in plan.shapes:
        offset = 0
        for x, m in shape:
            slots.append((x, taken[x], base, m, offset))
            taken[x] += m * copies
            offset += m * x
        base += copies
    # no more slots than the plan has shapes times pieces: it is made of room lengths, not of the corpus
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for x, *slot in slots:
        by_length.setdefault(x, []).append(tuple(slot))
    places = spark.sparkContext.broadcast({x: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for x, v in by_length.items()})
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = there.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "row", "piece", "ids_crc32")
    ranked = cut.withColumn("k", F.row_number().over(within) - 1).join(starts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("k") + F.col("before")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, seq, many, off = places.value[int(x)]
                i = np.searchsorted(first, rank[at], "right") - 1
                k = rank[at] - first[i]
                sequence[at] = seq[i] + k // many[i]
                offset[at] = off[i] + k % many[i] * x
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
