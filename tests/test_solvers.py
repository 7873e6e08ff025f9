"""Solvers against dense algebra, between the two spaces, and their observable contracts."""

import numpy as np
import pytest

from krylark.functions import formats
from krylark.model import SolveError, SparseMatrix, Status
from krylark.operators import algebra
from krylark.operators.krylov import KRYLOV, RELAXATIONS, Stop, colors_of
from krylark.operators.solve import cache_info, clear_cache, make_preconditioner, run, solve, solve_batched, solve_vjp
from krylark.operators.spaces import LocalSpace
from krylark.sources import generators as gen


def poisson(n, s=0.0):
    r, c, v = [], [], []
    for y in range(n):
        for x in range(n):
            i = y * n + x
            for ok, d, w in ((y > 0, -n, -1 - s / 2), (x > 0, -1, -1 - s / 2), (True, 0, 4.0), (x < n - 1, 1, -1 + s / 2), (y < n - 1, n, -1 + s / 2)):
                if ok:
                    r.append(i), c.append(i + d), v.append(w)
    return LocalSpace(n * n, r, c, v)


@pytest.mark.parametrize("name", sorted(KRYLOV))
@pytest.mark.parametrize("inner", ["NOSOLVER", "BLOCK_JACOBI", "CHEBYSHEV", {"solver": "AMG"}, {"solver": "AMG", "algorithm": "AGGREGATION", "selector": "SIZE_4"}])
def test_krylov_reaches_the_dense_solution(name, inner):
    sp = poisson(12)
    b = np.linspace(0.5, 1.5, sp.n)
    x, stop = run(sp, b, np.zeros(sp.n), {"solver": name, "preconditioner": inner, "tolerance": 1e-11, "max_iters": 400})
    assert stop.status == Status.SUCCESS and len(stop.history) == stop.iterations + 1
    np.testing.assert_allclose(x, np.linalg.solve(sp.dense(), b), rtol=1e-7)


@pytest.mark.parametrize("name", ["BICGSTAB", "PBICGSTAB", "GMRES", "FGMRES", "IDR"])
def test_nonsymmetric(name):
    sp = poisson(12, 1.0)
    b = np.ones(sp.n)
    x, stop = run(sp, b, np.zeros(sp.n), {"solver": name, "preconditioner": "BLOCK_JACOBI", "tolerance": 1e-11, "max_iters": 500})
    assert stop.status == Status.SUCCESS
    np.testing.assert_allclose(x, np.linalg.solve(sp.dense(), b), rtol=1e-7)
    _, cg = run(sp, b, np.zeros(sp.n), {"solver": "CG", "max_iters": 100})
    assert cg.status != Status.SUCCESS


@pytest.mark.parametrize("name", sorted(set(RELAXATIONS) - {"NOSOLVER"}))
def test_relaxations_reduce_every_residual(name):
    sp = poisson(8)
    b = np.ones(sp.n)
    x, stop = run(sp, b, np.zeros(sp.n), {"solver": name, "tolerance": 1e-8, "max_iters": 3000})
    assert stop.status == Status.SUCCESS
    assert all(q <= p * (1 + 1e-12) for p, q in zip(stop.history[1:], stop.history[2:]))
    np.testing.assert_allclose(sp.mul(x), b, atol=1e-6)


def test_dilu_is_the_product_of_its_factors():
    sp = poisson(5)
    color = colors_of(sp.n, sp.r, sp.c)
    a = sp.dense()
    order = np.argsort(color, kind="stable")
    p = a[np.ix_(order, order)]
    e = np.diag(p).copy()
    for i in range(len(e)):
        e[i] -= sum(p[i, j] * p[j, i] / e[j] for j in range(i))
    m = (np.diag(e) + np.tril(p, -1)) @ np.diag(1 / e) @ (np.diag(e) + np.triu(p, 1))
    r = np.random.default_rng(0).standard_normal(sp.n)
    got = RELAXATIONS["MULTICOLOR_DILU"](sp, {})(r)
    np.testing.assert_allclose(got[order], np.linalg.solve(m, r[order]), rtol=1e-9)


def test_published_curve_of_plain_cg():
    sp = LocalSpace(100, *zip(*[(i, j, 4.0 if i == j else -1.0) for i in range(100) for j in (i - 1, i, i + 1) if 0 <= j < 100]))
    x, stop = run(sp, np.ones(100), np.zeros(100), {"solver": "CG", "convergence": "ABSOLUTE", "tolerance": 1e-6})
    assert stop.iterations == 12 and stop.history[-1] == pytest.approx(3.2810e-07, rel=1e-3)
    np.testing.assert_allclose(x[:4], [0.36602542, 0.46410164, 0.490381, 0.4974226], rtol=1e-6)
    _, relative = run(sp, np.ones(100), np.zeros(100), {"solver": "CG"})
    assert relative.iterations == 10


def test_criteria():
    for kind, history, met in (("ABSOLUTE", [10.0, 1e-3], False), ("RELATIVE_INI", [1e4, 1e-3], True), ("RELATIVE_MAX_CORE", [1.0, 1e4, 1e-3], True), ("COMBINED_REL_INI_ABS", [1.0, 1e-7], True)):
        stop = Stop(kind, 1e-6)
        stop.history = history
        assert stop.met(history[-1]) is met
    with pytest.raises(ValueError):
        Stop("SOMETIMES")


def test_both_spaces_agree(spark):
    a, b = gen.poisson_matrix(spark, 6, 0.5), gen.rhs_linear(spark, 36)
    for name in ("PBICGSTAB", "FGMRES"):
        options = {"solver": name, "preconditioner": "BLOCK_JACOBI", "tolerance": 1e-10, "max_iters": 60}
        local, li = solve(a, b, None, options, strategy="local")
        table, ti = solve(a, b, None, options, strategy="table", num_partitions=2)
        assert li["status"] == ti["status"] == Status.SUCCESS and abs(li["iterations"] - ti["iterations"]) <= 1
        left, right = ({r.i: r.x for r in x.collect()} for x in (local, table))
        assert left.keys() == right.keys() and all(abs(left[k] - right[k]) < 1e-7 for k in left)


@pytest.mark.parametrize("inner", ["MULTICOLOR_ILU", "DENSE_LU_SOLVER", {"solver": "PCG", "preconditioner": "MULTICOLOR_ILU"}, {"solver": "AMG", "smoother": "MULTICOLOR_ILU"}])
def test_tables_replace_no_preconditioner(spark, monkeypatch, inner):
    a, b = gen.poisson_matrix(spark, 4), gen.rhs_ones(spark, 16)
    options = {"solver": "PBICGSTAB", "preconditioner": inner}
    with pytest.raises(ValueError, match="one task only"):
        solve(a, b, None, options, strategy="table", num_partitions=2)
    assert solve(a, b, None, options)[1]["status"] == Status.SUCCESS
    monkeypatch.setattr("krylark.operators.solve.LOCAL_ENTRIES", 10)
    with pytest.raises(ValueError, match="one task only"):
        solve(a, b, None, options)


def _same(left, right, tolerance):
    left, right = ({r.i: r.x for r in x.collect()} for x in (left, right))
    assert left.keys() == right.keys() and all(abs(left[k] - right[k]) < tolerance for k in left)


@pytest.mark.parametrize("inner", [{"solver": "AMG", "driver_rows": 4}, {"solver": "AMG", "algorithm": "AGGREGATION", "selector": "SIZE_2", "driver_rows": 4, "cycle": "CG"}, "MULTICOLOR_DILU", "MULTICOLOR_GS", "CF_JACOBI"])
def test_methods_of_one_task_run_on_tables(spark, inner):
    a, b = gen.poisson_matrix(spark, 4, 0.5), gen.rhs_ones(spark, 16)
    options = {"solver": "PBICGSTAB", "preconditioner": inner, "tolerance": 1e-6, "max_iters": 60}
    x, info = solve(a, b, None, options, strategy="table", num_partitions=2)
    assert info["status"] == Status.SUCCESS and info["iterations"] < 20
    _same(x, solve(a, b, None, options | {"tolerance": 1e-10})[0], 1e-4)
    if "AMG" in str(inner):
        rows = [level[1] for level in info["grid"]]
        assert len(rows) > 2 and all(p > q for p, q in zip(rows, rows[1:]))


def test_table_steps_of_multigrid_equal_the_local_ones(spark):
    """Interpolation and the Galerkin product by joins against the arrays, on the coarse rows that tables choose."""
    from krylark.operators import amg
    from krylark.operators.spaces import TableSpace, strong_entries

    a = gen.poisson_matrix(spark, 6, 0.7)
    sp = TableSpace(a, None, 2)
    strong = strong_entries(sp.a, 0.5).select("r", "c")
    coarse = amg.table_coarse_rows(sp, strong)
    mask = np.array([r.coarse for r in coarse.orderBy("i").collect()])
    local = poisson(6, 0.7)
    sr, sc = amg.strength(local, 0.5)
    assert 0 < mask.sum() < 30
    names = np.flatnonzero(mask)
    p = np.zeros((36, 36))
    for r in amg.table_distance_two(sp, strong, coarse).collect():
        p[r.i, r.j] += r.w
    pi, pj, pv = amg.distance_two(local, mask, sr, sc)
    want = np.zeros((36, 36))
    want[pi, names[pj]] = pv
    np.testing.assert_allclose(p, want, atol=1e-12)
    got = np.zeros((36, 36))
    for r in amg.table_galerkin(sp.a, amg.table_distance_two(sp, strong, coarse)).collect():
        got[r.r, r.c] += r.v
    np.testing.assert_allclose(got, want.T @ local.dense() @ want, atol=1e-12)
    sp.close()


def test_blocks_on_tables(spark):
    a = gen.kron(gen.poisson_matrix(spark, 3), formats.to_matrix(spark, [[3.0, 1.0], [0.5, 2.0]]))
    b = gen.rhs_ones(spark, 18)
    for options in ({"solver": "PBICGSTAB", "preconditioner": "BLOCK_JACOBI"}, {"solver": "PBICGSTAB", "preconditioner": {"solver": "AMG", "algorithm": "AGGREGATION", "driver_rows": 6}}):
        options |= {"tolerance": 1e-7}
        x, info = solve(a, b, None, options, strategy="table", num_partitions=2, block_dim=2)
        local, li = solve(a, b, None, options, block_dim=2)
        assert info["status"] == li["status"] == Status.SUCCESS
        assert abs(info["iterations"] - li["iterations"]) <= (1 if options["preconditioner"] == "BLOCK_JACOBI" else 10)
        _same(x, local, 1e-4)


def test_shapes_are_checked(spark):
    a = gen.tridiagonal_matrix(spark, 8, 4.0)
    with pytest.raises(ValueError, match="b has rows"):
        solve(a, gen.rhs_ones(spark, 9))
    with pytest.raises(ValueError, match="x0 has rows"):
        solve(a, gen.rhs_ones(spark, 8), gen.rhs_ones(spark, 10))


def test_statistics_have_the_grids(spark, tmp_path):
    a, b = gen.poisson_matrix(spark, 8), gen.rhs_ones(spark, 64)
    path = str(tmp_path / "stats.txt")
    _, info = solve(a, b, save_stats_file=path)
    text = open(path).read()
    assert info["grid"][0] == (0, 64, a.nnz()) and len(info["grid"]) > 2
    assert "AMG GRID STATISTICS" in text and all(f"{rows:>12} {entries:>12}" in text for _, rows, entries in info["grid"])


def test_lanes_and_preconditioners_of_one_task_are_counted(spark, monkeypatch):
    from pyspark.sql import functions as F

    a, b = gen.tridiagonal_matrix(spark, 8, 4.0), gen.rhs_ones(spark, 8)
    monkeypatch.setattr("krylark.operators.solve.LOCAL_ENTRIES", 10)
    with pytest.raises(ValueError, match="lane"):
        solve_batched(a.df.withColumn("batch", F.lit(0)), b.withColumn("batch", F.lit(0)), 8)
    with pytest.raises(ValueError, match="one task"):
        make_preconditioner(a)


def test_a_dense_coarse_solver_is_not_replaced(spark, monkeypatch):
    from krylark.operators import amg

    monkeypatch.setattr(amg, "DENSE_ROWS", 5)
    with pytest.raises(ValueError, match="dense coarse solver"):
        amg.Hierarchy(poisson(8), {"max_levels": 2})


def test_status_warm_start_and_errors(spark):
    a, b = gen.tridiagonal_matrix(spark, 64), gen.rhs_ones(spark, 64)
    _, info = solve(a, b, None, {"solver": "CG", "max_iters": 1})
    assert info["status"] == Status.NOT_CONVERGED and info["iterations"] == 1 and len(info["residual_history"]) == 2
    x, cold = solve(a, b, None, {"solver": "CG", "convergence": "ABSOLUTE", "tolerance": 1e-8})
    _, warm = solve(a, b, x, {"solver": "CG", "convergence": "ABSOLUTE", "tolerance": 1e-7})
    assert warm["iterations"] < cold["iterations"]
    singular = formats.to_matrix(spark, [[1.0, 1.0], [1.0, 1.0]])
    with pytest.raises(SolveError):
        solve(singular, gen.rhs_ones(spark, 2), None, {"solver": "DENSE_LU_SOLVER"})
    with pytest.raises(ValueError):
        solve(gen.tridiagonal_matrix(spark, 9), gen.rhs_ones(spark, 9), block_dim=2)
    with pytest.raises(ValueError):
        solve(formats.to_matrix(spark, [[1.0, 0.0]]), b)


def test_gradients_by_finite_differences(spark):
    n, dense = 5, None
    a = gen.tridiagonal_matrix(spark, n, 4.0)
    dense = np.zeros((n, n))
    for r in a.df.collect():
        dense[r.r, r.c] = r.v
    b = np.linspace(1, 2, n)
    bdf = spark.createDataFrame(list(enumerate(b.tolist())), "i long, x double")
    options = {"solver": "BICGSTAB", "tolerance": 1e-13}
    x, _ = solve(a, bdf, None, options)
    grad_b, grad_a, grad_0 = solve_vjp(a, x, gen.rhs_ones(spark, n), options)
    loss = lambda m, v: np.linalg.solve(m, v).sum()
    h = 1e-6
    for r in grad_b.collect():
        e = np.eye(n)[r.i] * h
        assert r.x == pytest.approx((loss(dense, b + e) - loss(dense, b - e)) / (2 * h), rel=1e-5)
    for r in grad_a.collect():
        e = np.zeros((n, n))
        e[r.r, r.c] = h
        assert r.v == pytest.approx((loss(dense + e, b) - loss(dense - e, b)) / (2 * h), rel=1e-5)
    assert {r.x for r in grad_0.collect()} == {0.0}


def test_batches_have_their_own_status(spark):
    one, two = (gen.tridiagonal_matrix(spark, 8, d).df for d in (2.0, 4.0))
    from pyspark.sql import functions as F

    a = one.withColumn("batch", F.lit(0)).unionByName(two.withColumn("batch", F.lit(1)))
    b = gen.rhs_ones(spark, 8)
    b = b.withColumn("batch", F.lit(0)).unionByName(b.withColumn("x", F.lit(2.0)).withColumn("batch", F.lit(1)))
    rows = solve_batched(a, b, 8, {"solver": "CG", "max_iters": 3}).collect()
    assert {r.status for r in rows if r.batch == 0} == {int(Status.NOT_CONVERGED)} or len(rows) == 16


def test_preconditioner_and_cache(spark):
    a = gen.poisson_matrix(spark, 8)
    r = gen.rhs_ones(spark, 64)
    z = make_preconditioner(a)(r)
    left = algebra.spmv(a, z).join(r.toDF("i", "b"), "i").selectExpr("sum(pow(b - x, 2)) as e").first().e
    assert left < 0.3 * 64
    clear_cache()
    first, _ = solve(a, r, None, {"tolerance": 1e-10}, reuse_setup=True)
    assert cache_info()["size"] == 1
    twice = SparseMatrix(a.df.selectExpr("r", "c", "2 * v as v"), a.meta)
    for options in ({}, {"preconditioner": {"solver": "AMG", "algorithm": "AGGREGATION"}}, {"preconditioner": "MULTICOLOR_DILU"}):
        options = {"tolerance": 1e-10} | options
        for m, scale in ((a, 1.0), (twice, 0.5), (a, 1.0)):
            x, _ = solve(m, r, None, options, reuse_setup=True)
            _same(x, first.selectExpr("i", f"{scale} * x as x"), 1e-8)
        assert cache_info()["size"] == 1
    clear_cache()
    assert cache_info()["size"] == 0


def _tri(n, d):
    return LocalSpace(n, *zip(*[(i, j, d if i == j else -1.0) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n]))


def _cg(sp, b):
    return run(sp, b, np.zeros(sp.n), {"solver": "CG", "tolerance": 1e-10, "max_iters": 500})[0]


def test_descent_over_the_right_hand_side():
    """The adjoint solve drives x to a target: losses, gradient norms and the step count of the published run."""
    from krylark.operators.solve import gradient_descent

    sp, target = _tri(64, 4.0), np.linspace(0, 1, 64)

    def step(b):
        gap = _cg(sp, b) - target
        return float(gap @ gap), _cg(sp, 2 * gap)

    log = gradient_descent(step, np.ones(64), 1.0, 100, 1e-3, lambda g: float(np.linalg.norm(g)))
    assert len(log) == 56
    for (loss, norm, _), want in zip(log, ((5.5413, 2.2774), (1.5938, 1.1939), (0.5020, 0.6397))):
        assert (loss, norm) == pytest.approx(want, abs=1e-4)


def test_descent_over_a_matrix_parameter():
    from krylark.operators.solve import gradient_descent

    b = np.ones(64)
    target = _cg(_tri(64, 4.0), b)

    def step(d):
        sp = _tri(64, d)
        x = _cg(sp, b)
        adjoint = _cg(sp, 2 * (x - target) / 64)
        return float(np.mean((x - target) ** 2)), float(-adjoint @ x)

    log = gradient_descent(step, 8.0, 2.0, 100, 1e-3, abs)
    assert len(log) == 86
    assert log[0][:2] == pytest.approx((0.1082, 0.0181), abs=1e-4)
    assert log[-1][2] - 2.0 * step(log[-1][2])[1] == pytest.approx(4.0049, abs=1e-4)


def test_published_solutions():
    cases = ((poisson(4), [0.8333334, 1.1666667, 1.1666667, 0.8333334]), (poisson(4, 0.5), [0.5736315, 0.8630174, 0.95168453, 0.7778139]), (poisson(32), [2.0437262, 3.587453, 4.8288155]), (poisson(32, 2.0), [0.25, 0.375, 0.4375]))
    for sp, want in cases:
        x, stop = run(sp, np.ones(sp.n), np.zeros(sp.n), {"solver": "PBICGSTAB", "preconditioner": {"solver": "AMG"}, "tolerance": 1e-10, "max_iters": 200})
        assert stop.status == Status.SUCCESS
        np.testing.assert_allclose(x[:len(want)], want, rtol=1e-6)


def test_blocks_need_block_relaxations():
    """The coupled system of a Poisson grid and [[2, 1], [1, 2]]: block Jacobi needs no more steps than point Jacobi."""
    p, m = poisson(8), np.array([[2.0, 1.0], [1.0, 2.0]])
    r, c = (np.repeat(x, 4) * 2 + np.tile(y, len(x)) for x, y in ((p.r, [0, 0, 1, 1]), (p.c, [0, 1, 0, 1])))
    sp = LocalSpace(128, r, c, np.repeat(p.v, 4) * np.tile(m.ravel(), len(p.v)))
    b = np.linspace(0.5, 1.5, 128)
    steps = {}
    for k in (1, 2):
        x, stop = run(sp, b, np.zeros(128), {"solver": "BLOCK_JACOBI", "block_dim": k, "tolerance": 1e-8, "max_iters": 3000})
        steps[k] = stop.iterations if stop.status == Status.SUCCESS else 10**6
        if k == 2:
            np.testing.assert_allclose(x, np.linalg.solve(sp.dense(), b), rtol=1e-5)
    assert steps[2] <= steps[1]
    x, stop = run(sp, b, np.zeros(128), {"solver": "PBICGSTAB", "block_dim": 2, "preconditioner": {"solver": "AMG", "algorithm": "AGGREGATION", "selector": "SIZE_2", "min_coarse_rows": 16}, "tolerance": 1e-10})
    assert stop.status == Status.SUCCESS and stop.iterations < 30
