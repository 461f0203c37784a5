import numpy as np
import pytest

from skinnyla.functions.hashing import omega
from skinnyla.operators import diagnostics, grouped, relational, sparse
from skinnyla.operators.qr import qt_times, reduce_tree, tsqr
from skinnyla.operators.ssvd import sketch_sparse, ssvd
from skinnyla.sources import matrices as mx

A = np.random.default_rng(100).integers(0, 1000, (100, 5)).astype(float)
R = np.linalg.qr(A)[1]
R = np.where(np.diag(R) < 0, -1, 1)[:, None] * R


@pytest.fixture(scope="session")
def sample_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("sample") / "part-00000"
    path.write_text("".join(" ".join(str(int(x)) for x in row) + " \n" for row in A))
    return str(path)


@pytest.fixture(scope="module")
def sample(spark, sample_path):
    return mx.from_text(spark, sample_path)


def sketched_sigma(k, p, q):
    """The singular values that the random matrix, its kp columns and q power iterations must give."""
    right = omega(5, min(k + p, 5))
    for _ in range(q + 1):
        right = A.T @ np.linalg.qr(A @ right)[0]
    return np.linalg.svd(right)[1][:k]


def dense(frame, column, key="row_id"):
    return np.array([r[column] for r in frame.orderBy(key).collect()])


def matrix(spark, a):
    return mx.Matrix(spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(a)], "row_id long, v array<double>"), a.shape[1])


@pytest.mark.parametrize("schedule", ["1", "4,1", "8,2,1", None])
@pytest.mark.parametrize("parts", [1, 9])
def test_tree_shape_does_not_matter(spark, sample, schedule, parts):
    m = mx.Matrix(sample.rows.repartition(parts), 5)
    qr = tsqr(m, schedule, keep_q=True)
    assert np.allclose(qr.matrix, R, atol=1e-6) and np.allclose(tsqr(m, schedule).matrix, R, atol=1e-6)
    q, a = dense(qr.q(), "q"), dense(sample.rows, "v")
    assert np.allclose(q @ qr.matrix, a, atol=1e-9) and np.allclose(q.T @ q, np.eye(5), atol=1e-12)
    assert diagnostics.orthogonality(qr) < 1e-12
    assert max(r.mean_abs for r in diagnostics.residual(sample, qr, 10).collect()) < 1e-9


def test_many_chunks_in_a_task(spark):
    a = np.random.default_rng(1).normal(size=(9000, 3))
    from skinnyla.operators import qr as module

    old, module.group_rows = module.group_rows, lambda *_: 1000
    try:
        qr = tsqr(matrix(spark, a), None, True)
        q = dense(qr.q(), "q")
    finally:
        module.group_rows = old
    assert np.allclose(q @ qr.matrix, a) and np.allclose(q.T @ q, np.eye(3)) and (np.diag(qr.matrix) > 0).all()


def test_rank_deficient_and_zero_columns(spark):
    a = np.random.default_rng(2).normal(size=(50, 4))
    a[:, 2], a[:, 3] = a[:, 0] + a[:, 1], 0
    qr = tsqr(matrix(spark, a), "2,1", True)
    assert np.allclose(dense(qr.q(), "q") @ qr.matrix, a) and (np.diag(qr.matrix) >= 0).all()


def test_wrong_shapes(spark):
    wide = matrix(spark, np.ones((2, 3)))
    with pytest.raises(ValueError):
        tsqr(wide, keep_q=True)
    with pytest.raises(ValueError):
        qt_times(matrix(spark, np.ones((4, 2))), matrix(spark, np.ones((5, 2))))
    with pytest.raises(ValueError):
        tsqr(mx.Matrix(wide.rows.limit(0), 3))
    with pytest.raises(ValueError):
        ssvd(wide, 4)
    square = tsqr(matrix(spark, np.array([[2.0, 1.0], [0.0, 3.0]])), keep_q=True)
    assert np.allclose(square.matrix, [[2, 1], [0, 3]])


def test_qt_products(spark, sample):
    qr = qt_times(sample, sample, "4,1")
    assert np.allclose(qr.qt_b_matrix(), R, atol=1e-6)
    b = np.random.default_rng(3).normal(size=(100, 2))
    got = qt_times(sample, matrix(spark, b)).qt_b_matrix()
    a = dense(sample.rows, "v")
    assert np.allclose(got, np.linalg.solve(np.array(tsqr(sample).matrix).T, a.T @ b), atol=1e-8)


@pytest.mark.parametrize(("k", "p", "q"), [(5, 0, 0), (5, 15, 2), (2, 1, 0), (2, 1, 1), (2, 2, 2)])
def test_singular_values(spark, sample, k, p, q):
    s = ssvd(sample, k, p, q, "4,1")
    assert np.allclose(s.sigma, sketched_sigma(k, p, q), rtol=1e-9)
    assert (s.sigma <= np.linalg.svd(A)[1][:k] * (1 + 1e-12)).all()
    u, v = dense(s.u(), "u"), dense(s.v(spark), "v", "col_id")
    assert np.allclose(u.T @ u, np.eye(k), atol=1e-9) and np.allclose(v.T @ v, np.eye(k), atol=1e-6 if p else 1e-9)
    half = dense(s.u(True), "u") @ dense(s.v(spark, True), "v", "col_id").T
    assert np.allclose(half, u * s.sigma @ v.T)
    if k == 5:
        assert np.allclose(half, dense(sample.rows, "v"), atol=1e-6)


def test_svd_of_low_rank_has_no_nan(spark):
    a = np.outer(np.arange(1, 21), [1.0, 2.0, 3.0])
    s = ssvd(matrix(spark, a), 3, 5, 1)
    assert s.sigma[1:] == pytest.approx([0, 0], abs=1e-9) and np.isfinite(s.v_matrix).all() and np.isfinite(dense(s.u(), "u")).all()
    assert np.allclose(dense(s.u(), "u") * s.sigma @ s.v_matrix.T, a)


def test_sparse_sketch_and_relational_products(spark, sample):
    y = {(r.row_id, r.s): r.y for r in sketch_sparse(sample.coo(), 5, 3).collect()}
    want = dense(sample.rows, "v") @ omega(5, 3)
    assert all(y[i, j] == pytest.approx(want[i, j]) for i in range(100) for j in range(3))
    a = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 1, 3)], "i int, j int, val long")
    got = {(r.i, r.j): r.val for r in relational.gemm(a, a, False, True).collect()}
    assert got == {(0, 0): 5, (0, 1): 6, (1, 0): 6, (1, 1): 9}
    assert {(r.i, r.j): r.val for r in relational.add(a, a).collect()} == {(0, 0): 2, (0, 1): 4, (1, 1): 6}
    g = {(r.i, r.j): r.val for r in relational.gram(sample.rows).collect()}
    assert len(g) == 15 and all(v == (A.T @ A)[ij] for ij, v in g.items())


def test_grouped_and_tree(spark):
    a = np.random.default_rng(5).normal(size=(60, 2))
    df = spark.createDataFrame([(f"g{i % 3}", float(x), float(y)) for i, (x, y) in enumerate(a)], "g string, x double, y double")
    for r in grouped.grouped_r(df, "g", ["x", "y"], 4).collect():
        own = a[[i for i in range(60) if f"g{i % 3}" == r.g]]
        assert np.allclose(np.array(r.r).reshape(2, 2).T @ np.array(r.r).reshape(2, 2), own.T @ own)
    f = mx.random_upper(spark, 3, 10).selectExpr("cast(key as long) group_id", "data r")
    one = np.array(f.first().r).reshape(3, 3)
    assert np.allclose(reduce_tree(f, 3, "4,1"), one * np.sqrt(10))


def test_rows_that_do_not_match_are_errors(spark):
    a = np.random.default_rng(7).normal(size=(10, 2))
    m = matrix(spark, a)
    shifted = mx.Matrix(m.rows.selectExpr("row_id + 1 AS row_id", "v"), 2)
    twice = mx.Matrix(m.rows.selectExpr("CASE WHEN row_id = 3 THEN 2 ELSE row_id END AS row_id", "v"), 2)
    for x, y in ((m, shifted), (shifted, m), (m, twice), (twice, m), (twice, twice)):
        with pytest.raises(ValueError, match="the same ids"):
            qt_times(x, y)
    with pytest.raises(Exception, match="does not hold 2 numbers"):
        diagnostics.residual(shifted, tsqr(m, keep_q=True)).collect()
    for keep_q in (False, True):
        with pytest.raises(ValueError, match="tall"):
            tsqr(matrix(spark, np.ones((2, 3))), keep_q=keep_q)
        with pytest.raises(ValueError, match="no rows"):
            tsqr(mx.Matrix(m.rows.limit(0), 2), keep_q=keep_q)


@pytest.mark.parametrize("passes", [0, 2])
def test_sparse_rows_give_what_dense_rows_give(spark, passes):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(300, 40)) * (rng.random((300, 40)) < 0.1)
    a[0] += 1e-3
    elements = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    elements += [(5, 7, 2.0), (5, 7, -2.0), (301, 3, 0.0)]
    frame = spark.createDataFrame(elements, "row_id long, col_id long, val double").repartition(5)
    own = ssvd(sparse.from_elements(frame, 40), 3, 6, passes, "4,1")
    full = a[np.abs(a).sum(axis=1) > 0]
    want = ssvd(matrix(spark, full), 3, 6, passes)
    assert np.allclose(own.sigma, want.sigma, rtol=1e-9) and np.allclose(own.v_matrix, want.v_matrix, atol=1e-8)
    assert np.allclose(dense(own.u(), "u"), dense(want.u(), "u"), atol=1e-8)
    right = omega(40, 9)
    for _ in range(passes + 1):
        right = full.T @ np.linalg.qr(full @ right)[0]
    assert np.allclose(own.sigma, np.linalg.svd(right)[1][:3])
    plan = own.qr.blocks
    assert max(len(r.cols) for r in plan.select("cols").collect()) < 0.3 * full.size


def test_sparse_errors_and_many_chunks(spark, monkeypatch):
    with pytest.raises(Exception, match="not below 3"):
        sparse.from_elements(spark.createDataFrame([(0, 3, 1.0)], "row_id long, col_id int, val double"), 3).rows.collect()
    rng = np.random.default_rng(2)
    a = rng.normal(size=(5000, 6)) * (rng.random((5000, 6)) < 0.5)
    a[:, 0] = 1
    monkeypatch.setattr(sparse, "group_rows", lambda *_: 700)
    frame = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row_id long, col_id int, val double")
    qr = sparse.sketched(sparse.from_elements(frame, 6), np.eye(6), "3,1")
    assert np.allclose(qr.qt_b_matrix(), qr.matrix, atol=1e-8) and np.allclose(dense(qr.q(), "q") @ qr.matrix, a, atol=1e-9)


def test_products_of_blocks(spark):
    a = np.random.default_rng(3).integers(-5, 6, (200, 4)).astype(float)
    a[:, 2] = 0
    rows = matrix(spark, a).rows.repartition(6).selectExpr("row_id", "v", "slice(v, 1, 2) AS q")
    got = {(r.i, r.j): r.val for r in relational.gram(rows).collect()}
    assert got == {(i, j): float(a[:, i] @ a[:, j]) for i in range(4) for j in range(i, 4)}
    got = {(r.col_id, r.s): r.val for r in relational.outer_sum(rows, "v", "q").collect()}
    assert got == {(i, j): float(a[:, i] @ a[:, j]) for i in (0, 1, 3) for j in range(2)}
    assert relational.gram(rows.limit(0)).count() == 0


def test_blocks_of_v_and_residuals_as_text(spark, sample, tmp_path):
    svd = ssvd(sample, 2)
    blocks = svd.v_blocks(spark, 2).orderBy("block_id").collect()
    assert [b.m for b in blocks] == [2, 2, 1] and np.allclose(np.concatenate([np.reshape(b.data, (b.m, 2)) for b in blocks]), svd.v_matrix)
    diagnostics.write_residual(sample, tsqr(sample, keep_q=True), f"{tmp_path}/residual", 30)
    lines = [r.value.split("\t") for r in spark.read.text(f"{tmp_path}/residual").collect()]
    assert sorted(int(k) for k, _ in lines) == [1, 2, 3] and all(float(x) < 1e-9 for _, x in lines)
