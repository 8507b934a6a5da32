"""Whitening against numpy's own eigenvectors, its parts against plain counts, and its cases."""

import math

import numpy as np
import pytest
from flamelake.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>"


def plain(vectors):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    matrix = np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1])
    values, turns = np.linalg.eigh(matrix)
    return x, np.trace(matrix), values[::-1], turns[:, ::-1]


def check(rows, given, wanted=8):
    """Rows of the operator against numpy over ``given`` = [(vec_id, vector)]."""
    x, trace, values, turns = plain([v for _, v in given])
    n, total = len(x), [int(s) for s in x.sum(axis=0)]
    wanted = min(wanted, x.shape[1])
    assert len(rows) == n * wanted
    by = {(r["vec_id"], r["component"]): r for r in rows}
    for (vec, _), own in zip(given, x.astype(int).tolist()):
        assert by[vec, 1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(own, total)) and by[vec, 1]["n"] == n
    for k in range(wanted):
        white = np.array([by[vec, k + 1]["whitened"] for vec, _ in given])
        expected = (x - x.mean(axis=0)) @ turns[:, k] / math.sqrt(values[k])
        sign = 1 if white @ expected > 0 else -1
        assert np.abs(white - sign * expected).max() < 1e-8
        assert by[given[0][0], k + 1]["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
    assert max(r["identity_error"] for r in rows) < 1e-9


def test_query_equals_numpy(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.op11_whitening(spark, SF).collect(), given)


def test_dropped_rows_and_other_columns(spark):
    random = np.random.default_rng(1)
    good = [(n, v) for n, v in enumerate(random.standard_normal((40, 5)).astype(np.float32).astype(float).tolist())]
    bad = [(90, None), (91, []), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [float("nan")] * 5), (94, [float("inf")] + [0.0] * 4), (95, [1.0, 2.0]), (96, [3e38] * 5)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in good + bad], SCHEMA + ", whitened string, n int").repartition(3)
    rows = whitening.components(frame).collect()
    check(rows, good)
    assert {r["vec_id"] for r in rows} == set(range(40))


def test_repeated_ids_and_rows(spark):
    given = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [2.0, 0.0]), (3, [5.0, 4.0])]
    rows = whitening.components(spark.createDataFrame(given, SCHEMA)).collect()
    assert len(rows) == 8 and sum(r["vec_id"] == 1 for r in rows) == 4
    x = np.floor(1024 * np.array([v for _, v in given])) + 100_000
    assert rows[0]["explained"] == pytest.approx(np.linalg.eigvalsh(np.cov(x.T, bias=True))[-1] / np.trace(np.cov(x.T, bias=True)))


@pytest.mark.parametrize("given", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [0.5] * 3), (2, [0.5] * 3)]])
def test_without_variance(spark, given):
    assert whitening.components(spark.createDataFrame(given, SCHEMA)).collect() == []


def test_large_values_leave_no_wrong_deviation(spark):
    given = [(1, [1e9, 0.0]), (2, [-1e9, 5.0]), (3, [0.0, 9.0]), (4, [1.0, 2.0])]
    rows = {(r["vec_id"], r["component"]): r for r in whitening.components(spark.createDataFrame(given, SCHEMA)).collect()}
    assert rows[1, 1]["deviation"] is None
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in given]
    total = [sum(c) for c in zip(*x)]
    expected = sum((4 * a - s) ** 2 for a, s in zip(x[2], total))
    assert rows[3, 1]["deviation"] == expected


@pytest.mark.parametrize("seed", range(4))
def test_inertia_counts(seed):
    random = np.random.default_rng(seed)
    half = random.standard_normal((30, 30))
    matrix = half + half.T
    assert whitening.negatives(matrix) == int((np.linalg.eigvalsh(matrix) < 0).sum())
    assert whitening.negatives(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1


def spectrum(values, seed=0):
    turns, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (turns * values) @ turns.T


@pytest.mark.parametrize(
    "values",
    [
        [9.0] * 3 + [5.0] * 12 + [1.0] * 5,  # the cut lies in a cluster
        [1e9, 1e5, 10.0, 1.0, 1e-3] + [0.0] * 6,
        list(np.linspace(1, 2, 40)),
        [3.0, 3.0 + 1e-12, 2.0],
    ],
)
def test_leading_of_hard_spectra(spark, values):
    matrix = spectrum(np.array(values))
    found, vectors = whitening.leading(spark, matrix, 8)
    expected = np.sort(values)[::-1][:8]
    assert np.abs(found - expected).max() < 1e-13 * max(values) * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(expected))).max() < 1e-9
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * max(values)


def test_intervals_hold_the_counted_values(spark):
    values = np.random.default_rng(3).random(50)
    parts = whitening.intervals(spectrum(values), 8)
    assert sum(count for _, _, count in parts) >= 8
    for low, high, count in parts:
        assert count == int(((values > low) & (values <= high)).sum())
    # One projection keeps what lies inside and dampens what lies outside.
    low, high, count = parts[-1]
    (made,) = whitening.project(spark, spectrum(values), [(low, high, np.eye(50))])
    assert np.linalg.eigvalsh((made + made.T) / 2)[-count:].min() > 0.45
