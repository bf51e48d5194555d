"""Small helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that are worked on at a time.
FEW = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Where none is set, as in tests, a session on one machine gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that is spent, wherever Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Shuffle partitions for each file of a slim table.
SLIM = 4


def keep(df: DataFrame, slim: bool = False) -> DataFrame:
    """df, computed once and written to the shared folder; what was shuffled for it is let go.

    slim: of a few numbers a row, so that a file can take SLIM shuffle partitions.
    """
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = df.coalesce(max(1, partitions(spark) // SLIM)) if slim else df
    shared_folder(spark)
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)


def few(batches: Iterator[pa.RecordBatch], rows: int = FEW) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of a batch's texts stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def bucket_of_id(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal digits, modulo modulus: the folds of the labelled tables."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def table_lower_words() -> bytes:
    """Byte map that lower-cases A-Z and blanks every ASCII byte that is no letter or digit."""
    return bytes(
        c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
    )


#: Bytes of texts whose words are hashed in one go.
WORD_CHUNK = 1 << 18
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_SEEDS = {}


def _seeds(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for bytes, and powers of a random number and of its inverse."""
    if which not in _SEEDS or len(_SEEDS[which][1]) < size:
        rng = np.random.default_rng(1000 + which)
        base = int(rng.integers(0, 2**61)) * 8 + 3
        power = lambda x: np.cumprod(np.append(np.uint64(1), np.full(max(size, 2 * WORD_CHUNK), x, np.uint64)))
        _SEEDS[which] = (rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), power(base), power(pow(base, -1, 2**64)))
    return _SEEDS[which]


def word_hashes(texts: list[bytes], which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between white space of all texts, and how many words each text has.

    which: hashes of different numbers are independent.
    """
    hashes, counts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < WORD_CHUNK):
            size += len(texts[end]) + 1
            end += 1
        data = np.frombuffer(b" ".join(texts[at:end]) + b" ", np.uint8)
        letters, powers, inverses = _seeds(which, len(data))
        blank = _BLANK[data]
        before = np.append(True, blank[:-1])
        first, last = np.flatnonzero(before & ~blank), np.flatnonzero(blank & ~before)
        sums = np.append(np.uint64(0), np.cumsum(letters[data] * powers[: len(data)]))
        hashes.append(mix((sums[last] - sums[first]) * inverses[first] + (last - first).astype(np.uint64)))
        bounds = np.cumsum([len(x) + 1 for x in texts[at:end]])
        counts.append(np.diff(np.searchsorted(first, np.append(0, bounds))))
        at = end
    return np.concatenate(hashes), np.concatenate(counts)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    out = values ^ (values >> np.uint64(32))
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


class Sums:
    """Hashes of all stretches of a sequence of 64-bit hashes, each by two lookups."""

    def __init__(self, values: np.ndarray, which: int = 0):
        _, powers, self.inverses = _seeds(which, len(values) + 1)
        self.sums = np.append(np.uint64(0), np.cumsum(mix(values) * powers[: len(values)]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the stretches from lo to hi (not included)."""
        out = self.sums[hi] - self.sums[lo]
        out *= self.inverses[lo]
        return mix(out)


def join2(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order-sensitive combination of two arrays of 64-bit hashes."""
    out = left * np.uint64(0x9E3779B97F4A7C15)
    out += right * np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    return out


def group_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins in arrays that are sorted by them."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_keys[0]), bool)
    new[0] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def spread(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """values of groups, one for each member."""
    return np.repeat(values, np.diff(np.append(starts, length)))


def numbered(docs: np.ndarray, *keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted; the smallest document of each; whether several documents have it; which of them each row has."""
    order = np.lexsort((docs, *reversed(keys)))
    sorted_ = [k[order] for k in keys]
    at = group_starts(*sorted_)
    which = np.zeros(len(order), np.int64)
    which[order] = spread(np.arange(len(at)), at, len(order))
    first, last = order[at], order[np.append(at[1:], len(order))[: len(at)] - 1]
    return [k[at] for k in sorted_], docs[first], docs[first] != docs[last], which
