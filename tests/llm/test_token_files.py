"""Token files: coding and files against what was put in."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.errors import PythonException
from tokenizers import Tokenizer

from pagemark.llm import queries, token_files
from pagemark.llm.common import keep

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def plain(rows, tokenizer):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def written(spark, df, folder, **sizes):
    token_files.write_ids(keep(token_files.tokenised(df, TOKENIZER)), folder, **sizes)
    return token_files.read_ids(spark, folder)


def test_documents(spark, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_token_files(spark, DATA).collect()), key=str) == plain(rows, tokenizer)


def test_odd_documents_in_small_blocks(spark, tokenizer, tmp_path):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(12_000))
    rows = [(None, None), (None, "a"), (3, None), (3, "x"), (3, "x"), (1, long), (0, ""), (7, "é€𝄞<|endoftext|> \n"), *((i, long[: rng.randrange(4_000)]) for i in range(10, 40)), (50, long * 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part long").repartition(3)
    folder = str(tmp_path / "ids")
    assert sorted(map(tuple, written(spark, df, folder, block=5_000, every=4, most=3).collect()), key=str) == plain(rows, tokenizer)
    names = sorted(x for x in os.listdir(folder) if x.startswith("ids-"))
    index = token_files.index_of(f"{folder}/{names[0]}")
    assert len(names) > 4 and not [x for x in os.listdir(folder) if x.startswith("_")] and max(len(b["segments"]) for b in index["blocks"]) > 10
    none = str(tmp_path / "none")
    assert token_files.round_trip(df.limit(0), TOKENIZER, none).count() == 0 and os.listdir(none) != []


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some words {i} " * 400) for i in range(20)], "doc_id long, text string")
    folder = str(tmp_path / "ids")
    written(spark, df, folder, block=5_000, every=4)
    name = f"{folder}/{sorted(x for x in os.listdir(folder) if x.startswith('ids-'))[0]}"
    with open(name, "rb") as file:
        data = file.read()
    for spoilt in (data[:50] + bytes([data[50] ^ 1]) + data[51:], data[:-1], data[: len(data) // 2]):
        with open(name, "wb") as file:
            file.write(spoilt)
        for crc in os.listdir(folder):
            assert not crc.endswith(".crc")
        with pytest.raises(PythonException):
            token_files.read_ids(spark, folder).collect()
    with open(name, "wb") as file:
        file.write(data)
    assert token_files.read_ids(spark, folder).count() == 20


@pytest.mark.parametrize("n", [1, 5, 64, 3_000, 70_000])
def test_coding(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n) % 50_257, np.full(n, 7), rng.integers(0, 1_000, n)):
        counts = np.bincount(ids, minlength=1_001)
        table = token_files.Table(token_files.normalised(counts))
        assert table.frequency.sum() == 1 << token_files.SCALE and ((table.frequency > 0) == (counts > 0)).all()
        for lanes, every in ((1, 50), (7, 3), (1024, 2)):
            found = token_files.encoded(ids, table, lanes, every) if n <= 3_000 or lanes > 7 else []
            for k, x in enumerate(found):  # each segment alone
                at = k * lanes * every
                assert (token_files.decoded(x, table) == ids[at : at + lanes * every]).all()
        if n == 70_000:
            share = counts[counts > 0] / n
            entropy = -(share * np.log2(share)).sum()
            assert sum(32 * len(x.words) for x in found) / n < entropy + 0.1


def test_frequencies_have_bounds():
    assert token_files.normalised(np.zeros(3, np.int64)).tolist() == [0, 0, 0]
    assert token_files.normalised(np.array([10**15, 0, 1]), 4).tolist() == [15, 0, 1]
    with pytest.raises(ValueError, match="too many"):
        token_files.normalised(np.ones(9, np.int64), 4)


def test_checksums_of_parts():
    rng = random.Random(1)
    for _ in range(50):
        data = rng.randbytes(rng.randrange(3_000))
        cuts = sorted([0, len(data), *(rng.randrange(len(data) + 1) for _ in range(3))])
        assert token_files.crc_joined([(b - a, zlib.crc32(data[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]) == zlib.crc32(data)
