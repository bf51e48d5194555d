"""Questions that blocks of documents put to the whole corpus.

Documents are dealt into blocks by a hash of their id and text, so no id is one block. A block names what it holds (hashes of
substrings), each name once with the smallest doc_id that has it, and sends the names, packed, to
buckets by name. A bucket sees every block that has a name and answers with a bit or two for
each, in the order it got them. However many documents share a passage, a block sends its names
once, so no bucket holds a hot group whole. Nothing is sampled, and all of it is shuffles that
Spark can redo when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_starts, mix, spread

#: UTF-8 bytes of documents in a block, and for each bucket; fewer than these many of each are not made.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
LEAST_BLOCKS, LEAST_BUCKETS = 64, 32
REQUEST = "bucket int, block int, names binary, keys binary, docs binary, base long"
REPLY = "block int, step int, bucket int, bits binary"
#: A document without an id counts as one after all others.
NO_ID = np.iinfo(np.int64).max


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """block, doc_id, data (the text's UTF-8 bytes); and how many buckets the blocks ask."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(LEAST_BLOCKS, size // BLOCK_BYTES)
    blocks = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("data"),
    )
    return blocks, max(LEAST_BUCKETS, size // BUCKET_BYTES)


def block_rows(tab: pa.Table) -> tuple[np.ndarray, list[bytes], list]:
    """Order keys, texts and ids of a block's documents, by id and then text."""
    ids, data = tab["doc_id"].to_pylist(), [x or b"" for x in tab["data"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], data[i]))
    ids = [ids[i] for i in order]
    return np.array([NO_ID if x is None else x for x in ids], np.int64), [data[i] for i in order], ids


def least(keys: tuple[np.ndarray, ...], docs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys, sorted; the smallest document of each; whether several documents have it."""
    order = np.lexsort((docs, *reversed(keys)))
    keys = [k[order] for k in keys]
    docs = docs[order]
    at = group_starts(*keys)
    if not len(at):
        return [k[:0] for k in keys], docs[:0], np.zeros(0, bool)
    last = np.append(at[1:], len(docs)) - 1
    return [k[at] for k in keys], docs[at], docs[last] != docs[at]


def pack5(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack5(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def scrambled(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 39-bit name inside the bucket."""
    mixed = mix(names)
    return (mixed % np.uint64(buckets)).astype(np.int64), mixed >> np.uint64(25)


def asked(
    block: int, buckets: int, names: np.ndarray, flags: np.ndarray | None = None, keys: np.ndarray | None = None, docs: np.ndarray | None = None
) -> Iterator[dict]:
    """Rows of REQUEST. names decide the bucket; they go as 39 bits and a flag, or not at all where keys are the names."""
    bucket, short = scrambled(names, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = group_starts(bucket)
    for lo, hi in zip(at, np.append(at, len(bucket))[1:], strict=True):
        some = order[lo:hi]
        row = {"bucket": int(bucket[lo]), "block": block, "names": None, "keys": None, "docs": None, "base": None}
        if keys is None or keys is not names:
            row["names"] = pack5((short[some] << np.uint64(1)) | (0 if flags is None else flags[some].astype(np.uint64)))
        if keys is not None:
            row["keys"] = keys[some].astype("<u8").tobytes()
            base = int(docs[some].min())
            wide = int(docs[some].max()) - base >= 2**32
            row |= {"docs": (docs[some] - base).astype("<u8" if wide else "<u4").tobytes(), "base": base}
        yield row


def answered(replies: dict[int, bytes], buckets: int, names: np.ndarray, bits: int) -> np.ndarray:
    """Bits of the replies, in the order of names: an array of len(names) x bits."""
    bucket, _ = scrambled(names, buckets)
    order = np.argsort(bucket, kind="stable")
    got = [np.zeros((0, bits), np.uint8)]
    count = np.bincount(bucket, minlength=buckets)
    for b in np.flatnonzero(count):
        got.append(np.unpackbits(np.frombuffer(replies[int(b)], np.uint8), count=int(count[b]) * bits).reshape(-1, bits))
    out = np.zeros((len(names), bits), bool)
    out[order] = np.concatenate(got)
    return out


def _received(tab: pa.Table) -> tuple[list[int], list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
    blocks, names = tab["block"].to_pylist(), tab["names"].to_pylist()
    keys = [np.frombuffer(x, "<u8") for x in tab["keys"].to_pylist() if x is not None]
    docs = [
        np.frombuffer(d, "<u4" if len(d) * 2 == len(k) else "<u8").astype(np.int64) + base
        for d, k, base in zip(tab["docs"].to_pylist(), tab["keys"].to_pylist(), tab["base"].to_pylist(), strict=True)
        if d is not None
    ]
    sizes = np.array([len(x) // 5 for x in names] if not keys else [len(x) for x in keys], np.int64)
    return blocks, names, np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(docs) if docs else np.zeros(0, np.int64), sizes


def _replied(blocks: list[int], sizes: np.ndarray, bits: np.ndarray, step: int, bucket: int) -> pa.Table:
    cuts = np.split(bits, np.cumsum(sizes)[:-1])
    n = len(blocks)
    return pa.table(
        {
            "block": pa.array(blocks, pa.int32()),
            "step": pa.array([step] * n, pa.int32()),
            "bucket": pa.array([bucket] * n, pa.int32()),
            "bits": pa.array([np.packbits(x.ravel()).tobytes() for x in cuts], pa.binary()),
        }
    )


def shared(requests: DataFrame, step: int) -> DataFrame:
    """For each name: does another document have it, here or in another block?"""

    def reduce(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        blocks, names, _, _, sizes = _received(tab)
        values = np.concatenate([unpack5(x) for x in names])
        order = np.argsort(values, kind="stable")
        at = group_starts(values[order] >> np.uint64(1))
        several = (np.diff(np.append(at, len(values))) > 1) | np.maximum.reduceat(values[order] & np.uint64(1), at).astype(bool)
        bits = np.zeros(len(values), np.uint8)
        bits[order] = spread(several, at, len(values))
        return _replied(blocks, sizes, bits, step, key[0].as_py())

    return requests.groupBy("bucket").applyInArrow(reduce, REPLY)


def smaller(requests: DataFrame, step: int) -> DataFrame:
    """For each key: has another block a document with a smaller id that has it?

    Where names come too, a second bit tells whether documents with the name differ in key (key 0
    differs from all).
    """

    def reduce(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        blocks, names, keys, docs, sizes = _received(tab)
        named = names[0] is not None
        name = np.concatenate([unpack5(x) for x in names]) if named else np.zeros(len(keys), np.uint8)
        order = np.lexsort((docs, keys, name))
        name, k, d = name[order], keys[order], docs[order]
        at = group_starts(name, k)
        first = spread(d[at], at, len(d))
        bits = np.zeros((len(keys), 1 + named), np.uint8)
        bits[order, 0] = first < d
        if named:
            by = group_starts(name)
            last = np.append(by[1:], len(k)) - 1
            bits[order, 1] = spread((k[by] != k[last]) | (k[by] == 0), by, len(k))
        return _replied(blocks, sizes, bits, step, key[0].as_py())

    return requests.groupBy("bucket").applyInArrow(reduce, REPLY)


def each_block(
    docs: DataFrame, replies: DataFrame | None, work: Callable[[int, pa.Table, dict[int, dict[int, bytes]]], Iterator[dict]], schema: str, arrow: pa.Schema
) -> DataFrame:
    """work(block, its documents, replies by step and bucket) for each block."""

    def table(block: int, tab: pa.Table, got: dict[int, dict[int, bytes]]) -> pa.Table:
        return pa.Table.from_pylist(list(work(block, tab, got)), arrow)

    if replies is None:
        return docs.groupBy("block").applyInArrow(lambda key, tab: table(key[0].as_py(), tab, {}), schema)

    def both(key: tuple[pa.Scalar, ...], tab: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[int, dict[int, bytes]] = {}
        for step, bucket, bits in zip(*(right[c].to_pylist() for c in ("step", "bucket", "bits")), strict=True):
            got.setdefault(step, {})[bucket] = bits
        return table(key[0].as_py(), tab, got)

    return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(both, schema)


REQUEST_ARROW = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int32()), ("names", pa.binary()), ("keys", pa.binary()), ("docs", pa.binary()), ("base", pa.int64())]
)
