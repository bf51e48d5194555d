"""Manifests against trees that are built level by level."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pagemark.llm import merkle

DATA = "/root/testdata/sf0.001"


def hashed(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([hashed(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for row in tree[:-1]:
        a = i // 3 * 3
        out.append((row[a:i], row[i + 1 : a + 3]))
        i //= 3
    return out


def leaf(row):
    return hashlib.sha256(b"".join(b"-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}".encode() for c in merkle.COLUMNS)).hexdigest()


def plain(rows):
    by = {}
    for row in rows:
        by.setdefault(row["source"], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for some in by.values():
        some.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    root = top[-1][0]
    for k, s in enumerate(names):
        for i, row in enumerate(by[s]):
            way, value = path(trees[s], i) + path(top, k), leaf(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["text"] is not None:
                value = leaf(row | {"text": row["text"].replace("\n", "")})
            for left, right in way:
                value = hashed([*left, value, *right])
            yield row["doc_id"], leaf(row), trees[s][-1][0], root, hashed([x for a, b in way for x in a + b]), value, value == root


def same(df):
    rows = [r.asDict() for r in df.select(*merkle.COLUMNS).collect()]
    got = sorted(map(tuple, merkle.verified_documents(df).collect()), key=str)
    return got == (sorted(plain(rows), key=str) if rows else [])


def test_documents(spark):
    assert same(spark.read.parquet(f"{DATA}/documents.parquet"))


@pytest.mark.parametrize("n", [0, 1, 3, 10, 82, 250])
def test_odd_rows_over_many_partitions_and_rounds(spark, n, monkeypatch):
    monkeypatch.setattr(merkle, "RUN", 4)
    monkeypatch.setattr(merkle, "FAN", 3)
    rng = random.Random(n)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(4, n // 4)))
    rows = [(rng.choice([i, i, None, 3]), rng.choice(["a\nb", None, "", "c"]), rng.choice(["en", None]), rng.choice([None, "", *"aaaaa", "b", "é"]), rng.choice([None, 2])) for i in range(n)]
    df = spark.createDataFrame(rows + rows[:n // 5], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        assert same(df.withColumns({c: F.lit(1) for c in ("tree", "leaf", "part", "place", "row", "tampered", "order_id", "n", "start")}))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_merging_ranges_is_like_adding_leaves():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 120)
        values = [hashed([str(i)]) for i in range(n)]
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(rng.randrange(6)))})
        ranges, made = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            r = merkle.Range(a, a)
            for v in values[a:b]:
                r.add(v, made)
            ranges.append(r)
        while len(ranges) > 1:
            k = rng.randrange(len(ranges) - 1)
            ranges[k : k + 2] = [ranges[k].merge(ranges[k + 1], made)]
        tree = levels(values)
        assert ranges[0].close(made) == tree[-1][0]
        assert sorted(made) == sorted((h, i, v) for h, row in enumerate(tree) if h for i, v in enumerate(row))


def test_node_records_and_paths(spark):
    leaves = spark.createDataFrame([(b"a", i, hashed([str(i)]), i) for i in range(20)] + [(None, i, hashed([f"n{i}"]), i) for i in range(7)], "tree binary, order_id long, leaf string, row long")
    got = {(r.tree, r.height, r["index"]): r.digest for r in merkle.node_records(leaves).collect()}
    for name, n, letter in ((b"a", 20, ""), (None, 7, "n")):
        tree = levels([hashed([f"{letter}{i}"]) for i in range(n)])
        assert {k[1:]: v for k, v in got.items() if k[0] == name} == {(h, i): v for h, row in enumerate(tree) if h for i, v in enumerate(row)}
    found, root = merkle.manifest(leaves, "row long")
    rows = found.collect()
    assert len(rows) == 27 and {merkle.folded(r.leaf, r.path) for r in rows} == {root}
    assert merkle.folded(hashed(["x"]), rows[0].path) != root
