"""Whitening against numpy's eigenvectors of the covariance and exact integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def used(rows):
    return [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) and abs(c) < whitening.EXACT for c in v)]


def check(rows, out):
    """Every row of out against whole numbers and an eigenvector solver; the rows of one length are one set."""
    by_width = {}
    for i, v in used(rows):
        by_width.setdefault(len(v), []).append((i, [math.floor(1024 * c) + 100_000 for c in v]))
    by_width.pop(0, None)
    assert len(out) == sum(len(x) * min(8, d) for d, x in by_width.items())
    for d, x in by_width.items():
        n, s = len(x), [sum(v[k] for _, v in x) for k in range(d)]
        exact = [[n * v[k] - s[k] for k in range(d)] for _, v in x]
        centred = np.array([[float(c) for c in row] for row in exact]) / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        total = values.sum()
        mine = sorted((r for r in out if r.width == d), key=lambda r: (str(r.vec_id), r.deviation or -1, r.component))
        want = sorted(((str(i), dev if (dev := sum(c * c for c in row)) < 1 << 63 else None, k) for (i, _), row in zip(x, exact, strict=True) for k in range(1, min(8, d) + 1)), key=lambda r: (r[0], r[1] or -1, r[2]))
        assert [(str(r.vec_id), r.deviation, r.component) for r in mine] == want
        assert {r.n for r in mine} == {n} and all(0 <= r.identity_error < 1e-9 for r in mine) and len({r.identity_error for r in mine}) == 1
        for k in range(min(8, d)):
            e, got = values[k], [r for r in mine if r.component == k + 1]
            assert all(r.explained == pytest.approx(e / total if total else 0, rel=1e-8, abs=1e-12) for r in got)
            if total <= 0 or e < 1e-12 * values[0]:
                assert all(abs(r.whitened) < 1e-6 for r in got)
            elif all(abs(e - o) > 1e-3 * values[0] for j, o in enumerate(values) if j != k):
                a = sorted(float(c @ vectors[:, k]) / e**0.5 for c in centred)
                b = sorted(r.whitened for r in got)
                assert np.allclose(a, b, atol=1e-7) or np.allclose([-c for c in a[::-1]], b, atol=1e-7)


def run(spark, rows, partitions=3, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema).withColumn("id", F.lit("x")).withColumn("vector", F.lit(1)).repartition(partitions)
    out = whitening.whiten(docs)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return docs, out



@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_whole_table_matches_eigenvectors(spark, partitions):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(400, 12)) * np.geomspace(3, 0.05, 12) @ np.linalg.qr(draw.normal(size=(12, 12)))[0] + 7
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(500, None), (501, [1.0] * 11 + [None]), (502, [float("nan")] * 12), (503, [1.0] * 11 + [float("inf")]), (504, [1e300] * 12), (None, [0.5] * 12), (3, rows[3][1]), (None, [0.5] * 12)]
    _, out = run(spark, rows, partitions)
    got = out.withColumn("width", F.lit(12)).collect()
    check(rows, got)
    assert all(r.vec_id not in range(500, 505) for r in got)


def test_several_lengths_and_flat_sets(spark):
    draw = random.Random(1)
    rows = [(k, [draw.gauss(0, 1) for _ in range(3)]) for k in range(50)] + [(100 + k, [draw.gauss(0, 5) for _ in range(20)]) for k in range(9)]
    rows += [(200, [1.0, 2.0]), (201, [1.0, 2.0])] + [(300, [4.0])] + [(400, []), (401, [])]
    _, out = run(spark, rows)
    widths = F.when(F.col("vec_id") < 100, 3).when(F.col("vec_id") < 200, 20).when(F.col("vec_id") < 300, 2).otherwise(1)
    got = out.withColumn("width", widths).collect()
    check(rows, got)
    assert {(r.whitened, r.explained, r.deviation) for r in got if r.width < 3} == {(0.0, 0.0, 0)}


def test_large_entries_stay_exact(spark):
    far = float((1 << 42) + 1) / 1024
    rows = [(k, [far * (k % 3), 2.0**41 * (-1) ** k, 2.0**39 * (k % 7)]) for k in range(30)]
    _, out = run(spark, rows)
    check(rows, out.withColumn("width", F.lit(3)).collect())
    assert out.where("deviation IS NULL").count() == 90


def test_empty_tables(spark):
    assert run(spark, [])[1].collect() == []
    assert run(spark, [(1, None), (2, [None])])[1].collect() == []


def test_small_blocks_and_pieces_change_nothing(spark, monkeypatch):
    draw = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(draw.normal(size=(60, 5)))] + [(100 + k, v.tolist()) for k, v in enumerate(draw.normal(size=(40, 4)))]
    whole = {(r.vec_id, r.component): (r.deviation, round(r.whitened, 9)) for r in run(spark, rows)[1].collect()}
    for name, value in {"BLOCK_NUMBERS": 10, "HELD_NUMBERS": 30, "FIT_NUMBERS": 1, "FAN": 2}.items():
        monkeypatch.setattr(whitening, name, value)
    assert {(r.vec_id, r.component): (r.deviation, round(r.whitened, 9)) for r in run(spark, rows, 9)[1].collect()} == whole


def test_jacobi_finds_singular_values_of_a_graded_matrix():
    draw = np.random.default_rng(6)
    q, _ = np.linalg.qr(draw.normal(size=(40, 10)))
    w, _ = np.linalg.qr(draw.normal(size=(10, 10)))
    a = q * np.geomspace(1e6, 1e-3, 10) @ w.T
    v, lengths = whitening.jacobi(np.linalg.qr(a, mode="r"))
    assert np.allclose(lengths, np.linalg.svd(a, compute_uv=False), rtol=1e-6)
    assert np.allclose(v.T @ v, np.eye(10), atol=1e-13)
    r = np.linalg.qr(a, mode="r") @ v
    cosines = r.T @ r / np.outer(lengths, lengths)
    assert np.abs(cosines - np.eye(10)).max() < 1e-5  # the product itself rounds by 1e-16 of its largest column


def test_embeddings_of_the_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    check(rows, out.withColumn("width", F.lit(64)).collect())
