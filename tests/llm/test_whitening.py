"""Whitened embeddings against plain linear algebra on exact sums."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows):
    good = sorted((i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v))
    n, sums = len(good), [sum(c) for c in zip(*(v for _, v in good), strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for _, v in good]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for _, v in good])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)[:32]
    return [i for i, _ in good], n, deviation, centred, np.trace(cov), e[order], u[:, order]


def held(got, rows, atol):
    ids, n, deviation, centred, trace, e, u = plain(rows)
    k = got.component.max()
    assert len(got) == n * k and set(got.n) == {n} and got.identity_error.max() <= 1e-4
    got = got.sort_values(["vec_id", "component"])
    assert got.vec_id.tolist() == np.repeat(ids, k).tolist() and got.deviation.tolist() == np.repeat(deviation, k).tolist()
    want, w = centred @ u[:, :k] / np.sqrt(e[:k]), got.whitened.to_numpy().reshape(n, k)
    assert np.allclose(w * np.sign((w * want).sum(0)), want, atol=atol)
    assert np.allclose(got.explained.to_numpy().reshape(n, k), e[:k] / trace, rtol=1e-6)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_embeddings(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = queries.op11_whitening(spark, folder).toPandas()
    assert got.component.max() == 32
    held(got, rows, 1e-9)


def test_expands_only_where_residuals_fail(spark):
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    for fall, expanded in ((0.5, False), (0.97, True)):
        values = (turn * np.where(np.arange(90) < 12, 1, 0 if not expanded else 1) * fall ** np.arange(90) * 3e4) @ rng.standard_normal((90, 400))
        rows = [(i, v) for i, v in enumerate(values.T.tolist())]
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        found = whitening.fit(whitening.usable(df), rank=8)
        assert found.expanded is expanded and len(found.values) == 8
        whole = np.floor(values.T * 64)
        e, u = np.linalg.eigh(np.cov(whole.T, bias=True))
        assert np.allclose(found.values, e[::-1][:8], rtol=1e-9)
        assert np.allclose(np.abs((found.components * u[:, ::-1][:, :8]).sum(0)), 1, atol=1e-9)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((60, 5)).tolist())]
    odd = [(100, None), (101, []), (102, [None] * 5), (103, [1.0, float("nan"), 0.0, 0.0, 0.0]), (104, [float("inf")] * 5), (105, [1.0, 2.0])]
    rows += [rows[0]] * 30
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: F.lit(1) for c in ("vector", "n", "component", "row", "cells")}).repartition(4)
    got = whitening.whitened(df).toPandas()
    assert len(got) == 90 * 5 and len(got[got.vec_id == 0].drop_duplicates()) == 5 and got.vec_id.max() == 59
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, SCHEMA))
    assert make([]).count() == make(rows[:1]).count() == make([rows[0]] * 9).count() == make(odd[:5]).count() == 0
    two = make([(None, [1e300, 0.0]), (2, [-1e300, 0.0])]).collect()
    assert len(two) == 2 and {r.deviation for r in two} == {None} and {round(abs(r.whitened), 9) for r in two} == {1.0}


def test_deviations_are_exact():
    x = np.array([[1_000_000, 1_000_064], [999_000, 1_000_001]])
    for n, sums in ((2, [1_999_000, 2_000_065]), (3_000_000_000, [3 * 10**15 + 5, 3 * 10**15 - 7])):
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
        assert whitening.deviations(x, n, sums) == [v if v < 2**63 else None for v in want]
