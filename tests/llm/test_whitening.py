import math

import numpy as np

from demandspark.llm import whitening as op

SCHEMA = "vec_id long, embedding array<float>, label int, x string, size int"


def brute(rows, k=4):
    kept = []
    for vec_id, vector in rows:
        if not vector or any(c is None or not math.isfinite(c) for c in vector):
            continue
        kept.append((vec_id, tuple(math.floor(256 * float(np.float32(c))) for c in vector)))
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array(fit, float) - np.array(sums) / n
    v = centred.T @ centred / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    out = {}
    for vec_id, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        y = (np.array(x, float) - np.array(sums) / n) @ basis[:, :k]
        for c in range(min(k, d)):
            white = y[c] / math.sqrt(values[c]) if values[c] > 1e-9 else None
            out.setdefault((vec_id, c + 1), []).append((n, deviation, white, values[c] / values.sum()))
    return out


def compare(got, want, tolerance=1e-9):
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.component), []).append(r)
    assert rows.keys() == want.keys()
    for c in {c for _, c in want}:
        keys = [k for k in want if k[1] == c]
        biggest = max(keys, key=lambda k: abs(want[k][0][2] or 0))
        sign = 1.0 if not want[biggest][0][2] else math.copysign(1, want[biggest][0][2] * rows[biggest][0].whitened)
        for k in keys:
            assert len(rows[k]) == len(want[k])
            for r, (n, deviation, white, share) in zip(sorted(rows[k], key=lambda r: r.deviation), sorted(want[k], key=lambda w: w[1]), strict=True):
                assert (r.n, r.deviation) == (n, deviation)
                assert abs(r.explained - share) < 1e-10
                assert (r.whitened is None) == (white is None)
                assert white is None or abs(sign * r.whitened - white) < tolerance


def random_rows(n=400, d=12):
    rng = np.random.default_rng(3)
    made = (rng.normal(size=(n, d)) * np.linspace(1.0, 0.1, d)).astype(np.float32).tolist()
    return [(i, v) for i, v in enumerate(made)] + [(5, made[7]), (None, made[8]), (None, made[8])] + [(900 + i, made[3]) for i in range(200)]


def test_against_numpy_with_odd_rows(spark):
    rows = random_rows()
    odd = [(800, None), (801, []), (802, [1.0, None] * 6), (803, [float("nan")] * 12), (804, [float("inf")] * 12), (805, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, "clash", 3) for i, v in rows + odd], SCHEMA).repartition(5)
    got = op.whitened(df).collect()
    compare(got, brute(rows))
    assert {r.identity_error for r in got} and max(r.identity_error for r in got) < 1e-10


def test_few_dimensions_constant_ones_and_one_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, "", 0), (2, [3.0, 2.0], 0, "", 0), (3, [2.0, 2.0], 0, "", 0)], SCHEMA)
    got = sorted(op.whitened(df).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in got] == [(i, c) for i in (1, 2, 3) for c in (1, 2)]
    assert [r.whitened is None for r in got] == [False, True] * 3 and got[0].explained == 1.0
    alone = op.whitened(df.where("vec_id = 1")).collect()
    assert len(alone) == 2 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in alone)


def test_empty_table(spark):
    assert op.whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op.whitened(spark.createDataFrame([(1, None, 0, "", 0)], SCHEMA)).collect() == []


def test_exact_deviation_beyond_doubles(spark):
    rows = [(i, [float(2**20 + i), float(i * i)]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 1, "", 0) for i, v in rows], SCHEMA)
    got = {r.vec_id: r.deviation for r in op.whitened(df).collect()}
    assert got == {k[0]: w[0][1] for k, w in brute(rows, 2).items()}


def test_refinement_of_clustered_eigenvalues():
    rng = np.random.default_rng(8)
    basis = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for values in (
        np.linspace(1, 100, 40),
        np.concatenate([np.linspace(5, 9, 30), 20 + np.arange(10) * 1e-9]),  # beyond float32
        np.concatenate([np.full(20, 3.0), np.full(20, 7.0)]),  # equal ones
        np.concatenate([[1e6, 1e6 + 1e-4, 1e6 + 2e-4], np.linspace(1, 2, 37)]),
        np.concatenate([np.zeros(20), np.linspace(1, 2, 20)]),
    ):
        a = basis * values @ basis.T
        a = (a + a.T) / 2
        found, x = op.eigen(a)
        scale = np.abs(values).max()
        assert np.abs(found - np.sort(values)[::-1]).max() < 1e-13 * scale * 10
        assert np.abs(x.T @ x - np.eye(40)).max() < 1e-13
        assert np.abs(a @ x - x * found).max() < 2e-14 * scale * 10


def test_refinement_goes_beyond_float32():
    rng = np.random.default_rng(9)
    made = rng.normal(size=(500, 64))
    a = np.cov(made.T)
    crude = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    error = lambda x: np.abs(x.T @ a @ x - np.diag(np.diag(x.T @ a @ x))).max()
    assert error(crude) > 1e-8 and error(op.eigen(a)[1]) < 1e-13


def test_lists_as_output(spark):
    df = spark.createDataFrame([(i, v, 1, "", 0) for i, v in random_rows()], SCHEMA)
    found = op.vectors(df)
    rows = op.transform(found, op.fit(found, 6), as_lists=True).collect()
    assert len(rows) == len(random_rows()) and all(len(r.whitened) == 6 for r in rows)
