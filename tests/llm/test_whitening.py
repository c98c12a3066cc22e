"""Whitening against numpy's eigenvectors of the whole covariance."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from skein.llm import whitening


def integers(vectors):
    fine = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    return [[math.floor(256 * c) for c in v] for v in fine]


def brute(x, k=4):
    """n, sums, eigenvalues, unit columns and trace of the different rows of x."""
    own = sorted(set(map(tuple, x)))
    n, sums = len(own), [sum(c) for c in zip(*own, strict=True)]
    z = np.array(own, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    return n, sums, values[::-1][:k], vectors[:, ::-1][:, :k], float((z * z).sum() / n)


def same_up_to_sign(got, want, tolerance):
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() <= tolerance


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_query(spark, sf):
    rows = whitening.op11_subspace_whitening(spark, f"/root/testdata/sf{sf}").collect()
    table = pq.read_table(f"/root/testdata/sf{sf}/embeddings.parquet").to_pydict()
    x = integers(table["embedding"])
    n, sums, values, vectors, trace = brute(x)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == 4 * len(x)
    want = (np.array(x) - np.array(sums) / n) @ vectors / np.sqrt(values)
    same_up_to_sign(np.array([[got[v, c].whitened for c in range(1, 5)] for v in table["vec_id"]]), want, 1e-8)
    for v, row in zip(table["vec_id"], x, strict=True):
        assert got[v, 1].deviation == sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) and got[v, 1].n == n
    for c in range(4):
        (explained,) = {r.explained for r in rows if r.component == c + 1}
        assert explained == pytest.approx(values[c] / trace, rel=1e-12)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10


def test_residuals_certify_every_component(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    for block in (1, 64):
        model = whitening.fit(table, k=3, block=block)
        assert (model.residuals <= whitening.ENOUGH * model.values[0]).all() and len(model.values) == 3
        _, _, values, vectors, _ = brute(integers([r.embedding for r in table.collect()]), 3)
        assert np.allclose(model.values, values, rtol=1e-12)
        same_up_to_sign(model.vectors, vectors, 1e-8)


def frame(spark, vectors):
    rows = [(k if k != 3 else None, v, "d", "x") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, deviation string, integers string")


def test_awkward_rows(spark):
    draw = np.random.default_rng(3)
    good = [draw.standard_normal(5).tolist() for _ in range(40)]
    odd = [None, [], [None] * 5, [float("nan")] * 5, [float("inf")] + [0.0] * 4, [1.0, None, 0.0, 0.0, 0.0], [1.0, 2.0], [3e38] * 5]
    table = frame(spark, good + odd + good[:1] * 30)  # copies count once
    model = whitening.fit(table)
    x = integers(good)
    n, sums, values, vectors, _ = brute(x)
    assert (model.n, model.sums) == (n, sums) == (40, sums)
    assert np.allclose(model.values, values, rtol=1e-12)
    rows = whitening.whiten(table, model).collect()
    assert len(rows) == 70 and sum(r.vec_id is None for r in rows) == 1 and {r.integers for r in rows} == {"x"}
    same_up_to_sign(np.array([r.whitened for r in rows]), (np.array(integers([r.embedding for r in rows])) - np.array(sums) / n) @ vectors / np.sqrt(values), 1e-9)


def test_few_directions_and_none(spark):
    flat = frame(spark, [[float(k), 2.0 * k, 0.0] for k in range(10)])
    model = whitening.fit(flat)
    assert len(model.values) == 1 and model.identity_error < 1e-12
    assert [len(r.whitened) for r in whitening.whiten(flat, model).collect()] == [1] * 10
    for table in (frame(spark, [[1.0, 2.0]] * 5), frame(spark, [])):
        model = whitening.fit(table)
        assert not len(model.values) and all(r.whitened == [] and r.deviation == 0 for r in whitening.whiten(table, model).collect())
    big = frame(spark, [[1e9, 0.0], [0.0, 1e9], [0.0, 0.0]])
    model = whitening.fit(big)
    assert len(model.values) == 2 and {r.deviation for r in whitening.whiten(big, model).collect()} == {None}
    tied = frame(spark, [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])
    assert np.allclose(whitening.fit(tied).values, [128.0**2 * 2, 128.0**2 * 2])
