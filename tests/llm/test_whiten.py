"""Contour integration and whitening against a dense eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidewatch.llm import feast, whiten
from tidewatch.llm.queries import QUERIES
from tests.llm.corpora import FOLDER, clashing

VECTORS = "vec_id long, embedding array<float>, label int"


def local(matrix):
    def solve(nodes):
        out = {}
        for node in nodes:
            out[node.interval] = out.get(node.interval, 0) + feast.term(matrix, node)
        return out
    return solve


def matrices():
    random = np.random.default_rng(3)
    for size in (1, 2, 5, 24):
        x = random.normal(size=(3 * size, size))
        turn = np.linalg.qr(random.normal(size=(size, size)))[0]
        steps = turn @ np.diag(np.round(np.linspace(1, 4, size))) @ turn.T  # equal eigenvalues
        yield from (x.T @ x, x.T @ x * 1e-9, 3 * np.eye(size), (steps + steps.T) / 2,
                    x[:1].T @ x[:1])


@pytest.mark.parametrize("wanted, most", [(4, 8), (4, 1), (9, 3)])
def test_greatest_equals_dense_solver(wanted, most):
    for matrix in matrices():
        expected = np.linalg.eigvalsh(matrix)[::-1][:wanted]
        values, vectors = feast.greatest(matrix, wanted, local(matrix), most)
        top = expected[0]
        assert np.abs(values - expected).max() < 1e-12 * top
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * top


def test_inertia_counts_signs():
    random = np.random.default_rng(5)
    for _ in range(100):
        size = random.integers(1, 10)
        a = random.normal(size=(size, size))
        a += a.T
        a[:size // 3] = a[:, :size // 3] = 0
        signs = np.linalg.eigvalsh(a)
        assert feast.inertia(a) == ((signs < -1e-12).sum(), (abs(signs) <= 1e-12).sum(),
                                    (signs > 1e-12).sum())


def test_zero_matrix_and_fewer_dimensions():
    values, _ = feast.greatest(np.zeros((3, 3)), 4, local(np.zeros((3, 3))))
    assert values.tolist() == [0, 0, 0]


def test_an_eigenvalue_missed_by_the_block_is_found():
    """A solver that at first drops a vector of the space: the count of the interval tells."""
    matrix, calls = np.diag([9.0, 8.0, 7.0, 1.0, 0.5, 0.2, 0.1, 0.0]), []
    whole = local(matrix)

    def lossy(nodes):
        calls.append(1)
        out = whole(nodes)
        if len(calls) < 4:
            for part in out.values():
                part[1] = 0
        return out

    values, _ = feast.greatest(matrix, 3, lossy)
    assert np.allclose(values, [9, 8, 7], rtol=1e-13) and len(calls) >= 4


def expected(rows, components=4):
    """Brute force: exact deviations, components of a dense solver."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]
    fit = [list(x) for x in sorted({tuple(x) for _, x in kept})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    centred = np.array(fit) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums)),
            (np.array(x) - mean) @ vectors / np.sqrt(values)) for i, x in kept]
    return n, values / np.trace(centred.T @ centred / n), out


def check(found, rows):
    n, explained, out = expected(rows)
    found = sorted(found.collect(), key=lambda r: (r["vec_id"], r["component"]))
    wide = len(explained)
    assert len(found) == wide * len(out)
    signs = np.array([[r["whitened"] for r in found[i * wide:(i + 1) * wide]] for i in range(len(out))])
    exact = np.array([w for _, _, w in sorted(out, key=lambda o: o[0])])
    turn = np.sign((signs * exact).sum(axis=0))
    assert np.abs(signs - exact * turn).max() < 1e-9
    for i, (vec_id, deviation, _) in enumerate(sorted(out, key=lambda o: o[0])):
        for c, row in enumerate(found[i * wide:(i + 1) * wide]):
            assert (row["vec_id"], row["component"], row["n"], row["deviation"]) == (
                vec_id, c + 1, n, deviation)
            assert abs(row["explained"] - explained[c]) < 1e-12 and row["identity_error"] < 1e-9


def test_whitened_equals_brute_force(spark):
    random = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in random.normal(size=6) * [9, 5, 3, 2, 1, 1]])
            for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # copies count once
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 6),
           (203, [float("inf")] * 6), (204, []), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], VECTORS)
    check(whiten.whitened(df), rows)
    check(whiten.whitened(clashing(df.selectExpr("*", "'x' AS x", "1 AS v", "2 AS cell"))), rows)


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"])
            for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, FOLDER), rows)


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [(None, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [3.0, 1.0])]
    found = whiten.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == [
        (0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r["n"] for r in found} == {3}


def test_no_variance_and_empty_tables_give_no_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)
    assert whiten.whitened(one).count() == 0
    assert whiten.whitened(one.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(5)], VECTORS)
    assert {r["component"] for r in whiten.whitened(line).collect()} == {1}


def test_entries_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [3e30, 1.0], 0), (2, [-3e30, 2.0], 0), (3, [0.0, 0.0], 0)], VECTORS)
    found = whiten.whitened(df).collect()
    assert {r["vec_id"]: r["deviation"] for r in found}[1] is None
    assert all(math.isfinite(r["whitened"]) for r in found)
