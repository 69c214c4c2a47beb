"""Whitened embeddings against a plain solution of the same eigenproblem."""

import math

import numpy as np
import pytest
from conftest import DATA

from hitprism.llm import queries as q
from hitprism.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, n string, row string"


def brute(rows, k=4):
    """{vec_id: (n, deviation, projections up to sign, explained)}"""
    x = {i: [math.floor(256 * c) for c in v] for i, v in rows
         if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, x.values()))), float)
    sums = [sum(int(v[i]) for v in set(map(tuple, x.values()))) for i in range(fit.shape[1])]
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / len(fit)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return {i: (len(fit), sum((len(fit) * a - s) ** 2 for a, s in zip(v, sums)),
                (np.array(v) - fit.mean(axis=0)) @ vectors / np.sqrt(values), values / np.trace(cov)) for i, v in x.items()}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows)
    found = {}
    for r in q.embedding_whitening(spark, DATA).collect():
        found.setdefault(r.vec_id, {})[r.component] = r
    assert set(found) == set(want)
    signs = [np.sign(found[rows[0][0]][c].whitened * want[rows[0][0]][2][c - 1]) for c in (1, 2, 3, 4)]
    for i, (n, deviation, projected, explained) in want.items():
        assert sorted(found[i]) == [1, 2, 3, 4]
        for c, r in found[i].items():
            assert (r.n, r.deviation) == (n, deviation)
            assert r.whitened * signs[c - 1] == pytest.approx(projected[c - 1], abs=1e-8)
            assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)
            assert r.identity_error < 1e-9


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64])
def test_eigenvectors(d):
    a = np.random.default_rng(d).standard_normal((d, d))
    close = np.linalg.qr(a)[0] * ([5, 5, 5.00000001, 4] + [1] * d)[:d] @ np.linalg.qr(a)[0].T
    for matrix in (a @ a.T, close, np.eye(d), np.zeros((d, d)), np.diag(np.arange(d))):
        k = min(4, d)
        values, vectors = w.leading_components(matrix, k)
        size = max(np.abs(matrix).max(), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:k]).max() <= 1e-12 * size
        assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-12 * size
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12


def test_edges(spark):
    good = [(1, [0.0, 1.0, 2.0]), (2, [1.0, -1.0, 2.0]), (2, [1.0, -1.0, 2.0]), (None, [0.5, -0.0, 2.0]), (9, [0.25, 3.0, 2.0])]
    bad = [(3, None), (4, [1.0, None, 2.0]), (5, [math.nan, 1.0, 2.0]), (6, [math.inf, 1.0, 2.0]), (7, [])]
    df = spark.createDataFrame([(i, v, "mine", "mine") for i, v in good + bad], SCHEMA).repartition(3)
    got = w.whiten(df).collect()
    assert sorted((r.vec_id for r in got), key=str) == [1, 2, 2, 9, None]
    assert all(r["row"] == "mine" and r.n == 4 for r in got)
    # the third dimension does not vary: two components have variance
    assert all(r.whitened[2] is None and None not in r.whitened[:2] and len(r.whitened) == 3 for r in got)
    assert all(sum(r.explained) == pytest.approx(1) and r.identity_error < 1e-9 for r in got)
    same = [r.whitened for r in got if r.vec_id == 2]
    assert same[0] == same[1]

    one = w.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", "")], SCHEMA)).first()
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, [None, None], [None, None], None)
    assert w.whiten(df.limit(0)).columns == ["vec_id", "embedding", "row", "n", "deviation", "whitened", "explained", "identity_error"]
    assert w.whiten(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        w.whiten(spark.createDataFrame([(1, [1.0], "", ""), (2, [1.0, 2.0], "", "")], SCHEMA))


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e15, 0.0], "", ""), (2, [-1e15, 1.0], "", ""), (3, [3e3, 1.0], "", "")]
    got = {r.vec_id: r for r in w.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v, *_ in rows}
    sums = [sum(v[d] for v in x.values()) for d in (0, 1)]
    for i, v in x.items():
        exact = sum((3 * a - s) ** 2 for a, s in zip(v, sums))
        assert got[i].deviation == (exact if exact < 1 << 63 else None)
    assert got[1].deviation is None and got[3].deviation is not None
