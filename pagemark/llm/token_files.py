"""Token ids of a corpus in binary files, coded by a static range asymmetric numeral system (rANS).

Texts are dealt by ranges of their ids and tokenised once. Ids are counted over the whole corpus; the counts, brought
to a sum of 2**SCALE, are the one frequency table that all files share. A task codes the ids of its range in blocks of
BLOCK ids, each on its own: LANES states take turns, so a step codes one id in each lane, backwards, and words of 32 bits that
leave a state go to the block's stream in the order in which decoding wants them back. Every CHECKPOINT steps the
states are kept with their place in the stream: decoding can begin at each checkpoint, and segments between them are decoded
in different tasks. A segment has a checksum of its bytes and one of its ids.

A folder holds files of up to FILE_BLOCKS blocks, named by range and number, so their names are in the order of the ids, and
`frequencies`. A file: MAGIC; for each block its documents (ids, a flag for those that are null, how many ids of each
are here; compressed), then its segments (states, words); an index as JSON with the places, sizes and checksums of all of these; its length and
checksum; MAGIC. A file is written under a hidden name and then renamed, so one that a lost executor has begun is never read. Paths are those
that pyarrow opens (local and shared folders, HDFS, S3, GCS).

Very long texts are tokenised whole, one at a time, and go over as many blocks as they need. Nulls: a null text is empty, a null id comes first.
Ties and repeated rows: each row is a document of its own, equal ids in the order of their texts. Every document has one id (END)
at least. An empty table gives no files but the frequencies, and an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, keep, partitions
from .packing import END, Coder, merge_ranks

#: Bits of the sum of frequencies; a vocabulary may be half as large.
SCALE = 19
#: States that take turns, steps between checkpoints, ids of a block and blocks of a file.
LANES, CHECKPOINT, BLOCK, FILE_BLOCKS = 2048, 256, 1 << 21, 64
#: Ids of a lane at least, so that states of short blocks do not outweigh their words.
LANE_IDS = 64
#: Least state between steps; a state is less than LOW << WORD.
LOW, WORD = 1 << 20, 32
MAGIC = b"rANSids1"


# ---------------------------------------------------------------- coding


def normalised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies with a sum of 2**scale: at least 1 for each id that occurs, 0 for others."""
    there = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(there):
        return out
    total = 1 << scale
    if 2 * len(there) > total:
        raise ValueError(f"{len(there)} different ids are too many for 2**{scale}")
    some = counts[there].astype(np.float64)
    exact = some / some.sum() * (total - len(there))
    whole = np.floor(exact).astype(np.int64)
    rest = total - len(there) - int(whole.sum())
    whole[np.argsort(whole - exact, kind="stable")[:rest]] += 1  # the largest remainders; ties by id
    out[there] = whole + 1
    return out


@dataclass
class Table:
    """Frequencies, and what coding looks up."""

    frequency: np.ndarray

    def __post_init__(self) -> None:
        self.scale = int(self.frequency.sum()).bit_length() - 1
        self.first = np.cumsum(self.frequency) - self.frequency
        self.id = np.repeat(np.arange(len(self.frequency), dtype=np.uint16 if len(self.frequency) <= 1 << 16 else np.uint32), self.frequency)
        # for coding, in floating point
        total = float(1 << max(0, self.scale))
        self.size, self.start = self.frequency.astype(np.float64), self.first.astype(np.float64)
        self.most, self.rest = self.size * (float(LOW << WORD) / total), total - self.size


@dataclass
class Segment:
    states: np.ndarray
    words: np.ndarray
    n: int


def encoded(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> list[Segment]:
    """Segments of a block, in order. States stay below 2**52, so floating point is exact."""
    x = np.full(lanes, float(LOW))
    unit = float(1 << WORD)
    steps = -(-len(ids) // lanes)
    out, words = [], []
    for step in range(steps - 1, -1, -1):
        s = ids[step * lanes : (step + 1) * lanes]
        some = x[: len(s)]
        full = np.flatnonzero(some >= table.most.take(s))
        low = some[full]
        high = np.floor(low / unit)
        words.append((low - high * unit).astype(np.uint32))
        some[full] = high
        some += np.floor(some / table.size.take(s)) * table.rest.take(s) + table.start.take(s)
        if step % every == 0:
            out.append(Segment(x.astype(np.int64), np.concatenate(words[::-1]), min(len(ids), (step + every) * lanes) - step * lanes))
            words = []
    return out[::-1]


def decoded(segment: Segment, table: Table) -> np.ndarray:
    """The ids of a segment."""
    x, words, lanes, at = segment.states.copy(), segment.words.astype(np.int64), len(segment.states), 0
    out = np.empty(segment.n, table.id.dtype)
    mask = (1 << table.scale) - 1
    for k in range(0, segment.n, lanes):
        some = x[: min(lanes, segment.n - k)]
        slot = some & mask
        s = table.id.take(slot)
        out[k : k + len(s)] = s
        some >>= table.scale
        some *= table.frequency.take(s)
        some += slot
        some -= table.first.take(s)
        low = np.flatnonzero(some < LOW)
        some[low] = (some[low] << WORD) | words[at : at + len(low)]
        at += len(low)
    return out.astype(np.uint32)


# ---------------------------------------------------------------- files


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a path or URI as Spark writes it."""
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class Writer:
    """Files of one range, block by block."""

    def __init__(self, folder: str, part: int, table: Table, every: int = CHECKPOINT, most: int = FILE_BLOCKS):
        self.system, self.folder = opened(folder)
        self.part, self.table, self.number = part, table, 0
        self.every, self.most = every, most
        self.out = None
        self.index: list[dict] = []

    def _write(self, data: bytes) -> dict:
        place = {"at": self.out.tell(), "size": len(data), "crc": zlib.crc32(data)}
        self.out.write(data)
        return place

    def block(self, ids: np.ndarray, docs: list[int | None], sizes: list[int], back: int, ends: bool) -> None:
        """back: ids of the first document in earlier blocks; ends: the last document ends in this block."""
        if self.out is None:
            self.hidden = f"{self.folder}/_{uuid.uuid4().hex}"
            self.out = self.system.open_output_stream(self.hidden)
            self.out.write(MAGIC)
        head = b"".join([np.array([x or 0 for x in docs], "<i8").tobytes(), np.array([x is None for x in docs], np.uint8).tobytes(), np.array(sizes, "<u4").tobytes()])
        entry = {"docs": len(docs), "ids": len(ids), "back": back, "ends": ends, "head": self._write(zlib.compress(head, 1)), "segments": []}
        done = 0
        for x in encoded(ids, self.table, min(LANES, max(1, len(ids) // LANE_IDS)), self.every):
            place = self._write(x.states.astype("<u8").tobytes() + x.words.astype("<u4").tobytes())
            entry["segments"].append(place | {"lanes": len(x.states), "ids": x.n, "ids_crc": zlib.crc32(np.ascontiguousarray(ids[done : done + x.n], "<u4"))})
            done += x.n
        self.index.append(entry)
        if len(self.index) == self.most:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        index = json.dumps({"part": self.part, "number": self.number, "blocks": self.index}).encode()
        self.out.write(index + len(index).to_bytes(8, "little") + zlib.crc32(index).to_bytes(4, "little") + MAGIC)
        self.out.close()
        self.system.move(self.hidden, f"{self.folder}/ids-{self.part:010d}-{self.number:06d}")
        self.out, self.index, self.number = None, [], self.number + 1


def index_of(path: str) -> dict:
    system, inside = opened(path)
    with system.open_input_file(inside) as file:
        end = file.size()
        tail = file.read_at(20, end - 20) if end >= 28 else b""
        size, crc = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:12], "little")
        index = file.read_at(size, end - 20 - size) if tail[12:] == MAGIC and 0 < size <= end - 28 else b""
    if not index or zlib.crc32(index) != crc:
        raise ValueError(f"{path} is not a whole file of token ids")
    return json.loads(index)


def _part(file: pa.NativeFile, place: dict, path: str) -> bytes:
    data = file.read_at(place["size"], place["at"])
    if len(data) != place["size"] or zlib.crc32(data) != place["crc"]:
        raise ValueError(f"{path} is damaged at {place['at']}")
    return data


def write_table(folder: str, table: Table) -> None:
    system, inside = opened(folder)
    system.create_dir(inside, recursive=True)
    data = np.concatenate([[table.scale], table.frequency]).astype("<u4").tobytes()
    with system.open_output_stream(f"{inside}/frequencies") as out:
        out.write(data + zlib.crc32(data).to_bytes(4, "little"))


def read_table(folder: str) -> Table:
    system, inside = opened(folder)
    with system.open_input_file(f"{inside}/frequencies") as file:
        data = file.read()
    if zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError(f"the frequencies of {folder} are damaged")
    return Table(np.frombuffer(data[:-4], "<u4")[1:].astype(np.int64))


# ---------------------------------------------------------------- Spark

_TOKENS = "part long, doc_id long, wide boolean, ids binary"


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """part, doc_id, ids (little-endian, unsigned, with END; of 16 bits, or where wide of 32) of each row: ranges of ids, in order inside a part."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    # rows of one id or one text are told apart, so that no range is all of them
    by = ["doc_id", F.xxhash64("text"), "row"]
    dealt = given.repartitionByRange(partitions(spark), *by).sortWithinPartitions("doc_id", "text", "row").select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    ranks = spark.sparkContext.broadcast(merge_ranks(tokenizer))  # of the file's tokens

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = Coder.of_file(tokenizer, ranks), np.array([END], "<u4").tobytes()
        for batch in few(batches):
            wide, narrow = [], []
            for text in batch["text"].to_pylist():
                ids = np.frombuffer(coder.of(text) + end, "<u4")
                wide.append(bool(ids.max() >> 16))
                narrow.append(ids.tobytes() if wide[-1] else ids.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch["part"], batch["doc_id"], pa.array(wide), pa.array(narrow, pa.binary())], ["part", "doc_id", "wide", "ids"])

    return dealt.mapInArrow(work, _TOKENS)


def _ids(wide: bool, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if wide else "<u2")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; no more rows than the vocabulary come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            wide, data = batch["wide"].to_pylist(), batch["ids"].to_pylist()
            for kind in (False, True):
                own = np.bincount(_ids(kind, b"".join(x for w, x in zip(wide, data, strict=True) if w == kind)))
                longer, shorter = (own, total) if len(own) > len(total) else (total, own)
                longer[: len(shorter)] += shorter
                total = longer
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["id", "n"])

    rows = tokens.select("wide", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(rows["id"].to_numpy().max()) + 1 if len(rows) else 0, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def write_ids(tokens: DataFrame, folder: str, block: int = BLOCK, every: int = CHECKPOINT, most: int = FILE_BLOCKS) -> int:
    """Writes tokens (of `tokenised`, kept) to a folder; how many files there are. block: ids of a block; every: steps between checkpoints; most: blocks of a file."""
    table = Table(normalised(id_counts(tokens)))
    write_table(folder, table)
    frequency = tokens.sparkSession.sparkContext.broadcast(table.frequency)  # as long as the vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out = Table(frequency.value), None
        held, docs, sizes, size, back = [], [], [], 0, 0

        def flush(before: int) -> None:
            """before: ids of the last document so far, if it goes on in the next block, else 0."""
            nonlocal held, docs, sizes, size, back
            if docs:
                out.block(np.concatenate(held), docs, sizes, back, not before)
            held, docs, sizes, size, back = [], [], [], 0, before

        for batch in few(batches):
            for doc_id, wide, data in zip(batch["doc_id"].to_pylist(), batch["wide"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                out = out or Writer(folder, batch["part"][0].as_py(), table, every, most)
                ids, done = _ids(wide, data), 0
                while done < len(ids):
                    some = ids[done : done + block - size]
                    held.append(some)
                    docs.append(doc_id)
                    sizes.append(len(some))
                    size, done = size + len(some), done + len(some)
                    if size == block:
                        flush(done if done < len(ids) else 0)
        if out is not None:
            flush(0)
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([out.number if out else 0], pa.int64())], ["files"])

    return tokens.mapInArrow(write, "files long").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).first().n


_SEGMENTS = "path string, part long, number long, block long, segment long, ids long, docs long, skipped long, head string, place string, back long, ends boolean"
_PIECES = "start long, doc_id long, none boolean, at long, n long, crc long, whole boolean"


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of all files of a folder, from their indexes: what a decoding task needs to know of each, with the ids before its file's range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SEGMENTS.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in _SEGMENTS.split(", ")]
        for batch in batches:
            for path in batch["path"].to_pylist():
                index, rows = index_of(path), []
                for b, block in enumerate(index["blocks"]):
                    skipped = 0
                    for s, place in enumerate(block["segments"]):
                        rows.append((path, index["part"], index["number"], b, s, place["ids"], block["docs"], skipped, json.dumps(block["head"]), json.dumps(place), block["back"], block["ends"]))
                        skipped += place["ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*").load(folder).select("path")
    found = files.mapInArrow(work, _SEGMENTS)
    # ids before each segment: first inside its range, then over the ranges, of which there are no more than tasks wrote
    inside = Window.partitionBy("part").orderBy("number", "block", "segment").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("ids_before", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    ranges = found.groupBy("part").agg(F.sum("ids").alias("of_part"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("part", F.coalesce(F.sum("of_part").over(over), F.lit(0)).alias("start"))
    return found.join(starts, "part")


def _crc_shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 registers after n more zero bytes each, by squaring the one-byte step as a matrix over two elements."""
    rows = np.array([0xEDB88320, *(1 << k for k in range(31))], np.uint64)  # one bit
    times = lambda m, v: np.bitwise_xor.reduce(np.where((v[..., None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1), m, np.uint64(0)), axis=-1)
    out, n = crc.astype(np.uint64), n.astype(np.uint64)
    for _ in range(3):
        rows = times(rows, rows)
    while n.any():
        out = np.where(n & np.uint64(1), times(rows, out), out)
        rows, n = times(rows, rows), n >> np.uint64(1)
    return out


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of texts one after the other, from (bytes, CRC-32) of each."""
    total = 0
    for size, crc in parts:
        total = int(_crc_shift(np.array([total]), np.array([size]))[0]) ^ crc
    return total


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a folder, from its files alone."""
    table = spark.sparkContext.broadcast(read_table(folder).frequency)  # as long as the vocabulary
    dealt = segments(spark, folder)
    dealt = dealt.repartition(partitions(spark), "path", "block", "segment")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, path, file = Table(table.value), None, None
        for batch in batches:
            for x in batch.to_pylist():
                if x["path"] != path:
                    if file is not None:
                        file.close()
                    path = x["path"]
                    system, inside = opened(path)
                    file = system.open_input_file(inside)
                place, head = json.loads(x["place"]), json.loads(x["head"])
                data = _part(file, place, path)
                lanes = place["lanes"]
                ids = decoded(Segment(np.frombuffer(data, "<u8", lanes).astype(np.int64), np.frombuffer(data, "<u4", offset=8 * lanes), place["ids"]), codes)
                if zlib.crc32(ids) != place["ids_crc"]:
                    raise ValueError(f"{path} does not decode to what was written at {place['at']}")
                yield _pieces(x, ids, zlib.decompress(_part(file, head, path)))
        if file is not None:
            file.close()

    found = keep(dealt.mapInArrow(work, _PIECES))  # a few numbers a document, used twice; files are decoded once
    whole = found.where("whole").select("doc_id", "none", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    # documents that several segments share: a few for each segment
    parts = found.where("NOT whole").groupBy("start").agg(
        F.first("doc_id").alias("doc_id"), F.first("none").alias("none"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("parts")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [crc_joined([(4 * y["n"], y["crc"]) for y in x]) for x in batch["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "none", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "none", "start", "n_tokens", "ids_crc32"])

    joined = parts.select("doc_id", "none", "start", "n_tokens", "parts").mapInArrow(join, "doc_id long, none boolean, start long, n_tokens long, ids_crc32 long")
    return whole.unionAll(joined).select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def _pieces(x: dict, ids: np.ndarray, head: bytes) -> pa.RecordBatch:
    """What a segment holds of each of its documents."""
    n = x["docs"]
    doc_ids = np.frombuffer(head, "<i8", n)
    none = np.frombuffer(head, np.uint8, n, offset=8 * n).astype(bool)
    ends = np.cumsum(np.frombuffer(head, "<u4", n, offset=9 * n).astype(np.int64))
    begins = np.append(0, ends[:-1])
    lo, hi = x["skipped"], x["skipped"] + len(ids)
    some = np.arange(np.searchsorted(ends, lo, "right"), np.searchsorted(begins, hi, "left"))
    first, last = np.maximum(begins[some], lo), np.minimum(ends[some], hi)
    whole = (first == begins[some]) & (last == ends[some])
    if x["back"]:
        whole &= some > 0
    if not x["ends"]:
        whole &= some < n - 1
    begins[0] -= x["back"]
    data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((first - lo).tolist(), (last - lo).tolist(), strict=True)]
    block = x["start"] + x["ids_before"] - lo
    columns = [block + begins[some], doc_ids[some], none[some], block + first, last - first, np.array(crc, np.int64), whole]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _PIECES.split(", ")])


def round_trip(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents, written to a folder and read back; the folder stays."""
    write_ids(keep(tokenised(docs, tokenizer)), folder)
    return read_ids(docs.sparkSession, folder)
