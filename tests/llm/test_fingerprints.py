"""Fingerprints, their likeness and edited texts of a whole table, sample by sample in plain loops."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import xxhash
from pyspark.sql import functions as F

from pagemark.llm import fingerprints

DATA = "/root/testdata/sf0.001"


def draws(term, k):
    """ln c, r, b and the hash of one term for one sample."""
    seed = xxhash.xxh64_intdigest(term.to_bytes(8, "little"), 42)
    one, two = (xxhash.xxh64_intdigest((2 * k + i).to_bytes(4, "little"), seed) for i in (0, 1))
    uniform = lambda bits, size: (bits + 0.5) * 2.0**-size
    r = -math.log(uniform(one >> 32, 32) * uniform(one & 0xFFFFFFFF, 32))
    c = -math.log(uniform(two >> 40, 24) * uniform((two >> 16) & 0xFFFFFF, 24))
    return math.log(c), r, uniform(two & 0xFFFF, 16), one


KNOWN: dict = {}


def signature(text, samples=32):
    weights = collections.Counter()
    for word in re.split(r"[ \t\n\x0B\f\r]+", text):
        weights[word] += len(word)
    out = []
    for k in range(samples):
        best = None
        for word, weight in weights.items():
            if not weight:
                continue
            term = xxhash.xxh64_intdigest(word.encode(), 42)
            if (term, k) not in KNOWN:
                KNOWN[term, k] = draws(term, k)
            log_c, r, b, seen = KNOWN[term, k]
            t = math.floor(math.log(weight) / r + b)
            bid = (int((log_c - r * (t - b + 1) + 128) * 2.0**34), (seen >> 43) ^ (t & 0x1FFFFF))
            best = bid if best is None or bid < best else best
        out.append(None if best is None else best[1])
    return out


def plain(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    made = []
    for i, (d, text) in enumerate(rows):
        after, cut = rows[(i + 1) % len(rows)][1], len(text) // 4
        made.append((d, text, text[: len(text) - cut] + after[:cut]))
    signs = [(signature(t), signature(e)) for _, t, e in made]
    shown = lambda s: "" if s[0] is None else "".join(f"{x:06X}" for x in s)
    like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    for i, (d, text, edited) in enumerate(made):
        yield d, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(signs[i][0]), shown(signs[i][1]), like(*signs[i]), like(signs[i][0], signs[(i + 1) % len(made)][0])


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sorted(map(tuple, fingerprints.edited_documents(docs).select(*COLUMNS).collect()))
    assert got == sorted(plain([(r.doc_id, r.text) for r in docs.collect()]))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one two  two\tthree"), (5, "one two  two\tthree"), (6, "é" * 9 + " 𝄞 x"), (None, "last of all"), (-7, "first of all, with a negative id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("bucket", "row", "order", "ghost", "_words")}).repartition(3)
    got = sorted(map(tuple, fingerprints.edited_documents(df).select(*COLUMNS).collect()), key=str)
    assert got == sorted(plain(rows), key=str)
    assert fingerprints.edited_documents(df.limit(0)).count() == 0
