"""Systems beyond one task: vectors in the driver, the matrix in blocks."""

import pytest

from krylark.model import Status, matrix
from krylark.operators.solve import solve
from krylark.sources import generators as gen

CASES = [
    {"solver": "PCGF", "preconditioner": {"solver": "AMG", "algorithm": "AGGREGATION", "selector": "MULTI_PAIRWISE", "cycle": "CG", "driver_rows": 4}},
    {"solver": "PCGF", "preconditioner": {"solver": "AMG", "algorithm": "AGGREGATION", "selector": "SIZE_8", "cycle": "F", "driver_rows": 2}},
    {"solver": "PCG", "preconditioner": "MULTICOLOR_DILU"},
    {"solver": "PBICGSTAB", "preconditioner": "MULTICOLOR_GS"},
    {"solver": "PCG", "preconditioner": {"solver": "MULTICOLOR_GS", "symmetric_GS": 1}},
    {"solver": "PBICGSTAB", "preconditioner": {"solver": "AMG", "algorithm": "AGGREGATION", "selector": "SIZE_4", "cycle": "W", "driver_rows": 2}},
    {"solver": "PBICGSTAB", "preconditioner": "MULTICOLOR_ILU"},
    {"solver": "PCG", "preconditioner": {"solver": "AMG", "algorithm": "AGGREGATION", "selector": "SIZE_2", "driver_rows": 4}},
    {"solver": "CHEBYSHEV"},
]


@pytest.mark.parametrize("options", CASES)
def test_systems_beyond_one_task_run_on_blocks(spark, monkeypatch, options):
    """Without the loop over tables, where each product is a shuffle and a checkpoint; the solution is the local one's."""
    skew = 0.0 if options["solver"].startswith("PCG") else 0.5
    a, b = gen.poisson_matrix(spark, 6, skew), gen.rhs_linear(spark, 36)
    options = options | {"tolerance": 1e-11, "max_iters": 200}
    want = {r.i: r.x for r in solve(a, b, None, options, strategy="local")[0].collect()}
    monkeypatch.setattr("krylark.operators.solve.LOCAL_ENTRIES", 10)
    monkeypatch.setattr("krylark.operators.solve._solve_table", None)
    x, info = solve(a, b, None, options, strategy="spread" if "ILU" in str(options) else "auto")
    got = {r.i: r.x for r in x.collect()}
    assert info["status"] == Status.SUCCESS and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
    if "AMG" in str(options):
        rows = [level[1] for level in info["grid"]]
        assert len(rows) > 2 and all(p > q for p, q in zip(rows, rows[1:]))


@pytest.mark.parametrize("options", [CASES[3], CASES[4], CASES[2], CASES[2] | {"solver": "PBICGSTAB"}, CASES[6]])
def test_sweeps_take_fewer_jobs_than_colors(spark, monkeypatch, options):
    """Of a matrix with many more entries than a task takes: a sweep goes by groups of colors, and the solution is the local one's."""
    from krylark.operators import blocks

    n = 40
    near = [(i, j) for i in range(n) for j in range(n) if 0 < abs(i - j) <= 6 or (i * j) % 7 == 1]
    skew = 0.0 if options["solver"] == "PCG" else 0.3
    a = matrix(spark.createDataFrame([(i, j, -1.0 - skew * (i > j)) for i, j in near if i != j] + [(i, i, 40.0) for i in range(n)], "r long, c long, v double"), n, symmetric=not skew)
    b = gen.rhs_linear(spark, n)
    options = options | {"tolerance": 1e-11, "max_iters": 200}
    want = {r.i: r.x for r in solve(a, b, None, options, strategy="local")[0].collect()}
    seen, by_groups = [], blocks.BlockSpace._by_groups
    monkeypatch.setattr(blocks, "SWEPT", 150)
    monkeypatch.setattr(blocks.BlockSpace, "_by_groups", lambda self, m: seen.append(by_groups(self, m)) or seen[-1])
    x, info = solve(a, b, None, options, strategy="blocks")
    got = {r.i: r.x for r in x.collect()}
    assert info["status"] == Status.SUCCESS and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert all(1 < len(rows) < len(group) for group, rows, *_ in seen) and seen


@pytest.mark.parametrize("options", CASES)
def test_products_of_what_the_driver_holds_take_no_job(spark, monkeypatch, options):
    """The matrix is copied to the driver once; products, sweeps and pairings are jobs only for matrices beyond that."""
    from krylark.operators import blocks

    a, b = gen.poisson_matrix(spark, 6, 0.0), gen.rhs_linear(spark, 36)
    options = options | {"tolerance": 1e-11, "max_iters": 200}
    built, jobs, make, context = [], [], blocks.Blocks._take, type(spark.sparkContext)
    job = context.runJob
    monkeypatch.setattr(blocks.Blocks, "_take", lambda self, rdd, *x: (make(self, rdd, *x), built.append(rdd.getNumPartitions()))[0])
    monkeypatch.setattr(context, "runJob", lambda self, *x, **y: jobs.append(1) or job(self, *x, **y))
    x, info = solve(a, b, None, options, strategy="blocks")
    assert info["status"] == Status.SUCCESS and len(jobs) <= sum(built)
    want = {r.i: r.x for r in solve(a, b, None, options, strategy="local")[0].collect()}
    assert all(abs(r.x - want[r.i]) < 1e-8 for r in x.collect())
    assert not blocks._LIVE


@pytest.mark.parametrize("options", [CASES[1], CASES[2], CASES[3]])
def test_blocks_that_the_driver_does_not_hold(spark, monkeypatch, options):
    from krylark.operators import blocks

    a, b = gen.poisson_matrix(spark, 6, 0.0), gen.rhs_linear(spark, 36)
    options = options | {"tolerance": 1e-11, "max_iters": 200}
    want = {r.i: r.x for r in solve(a, b, None, options, strategy="local")[0].collect()}
    monkeypatch.setattr(blocks, "DRIVEN", -1)
    x, info = solve(a, b, None, options, strategy="blocks", num_partitions=2)
    assert info["status"] == Status.SUCCESS and all(abs(r.x - want[r.i]) < 1e-8 for r in x.collect())


@pytest.mark.parametrize("options", [CASES[7], CASES[2], CASES[8]])
def test_tasks_have_several_blocks(spark, monkeypatch, options):
    """A product has no more tasks than cores as long as a task's entries allow it, however many blocks there are."""
    from krylark.operators import blocks

    a, b = gen.poisson_matrix(spark, 6, 0.0), gen.rhs_linear(spark, 36)
    options = options | {"tolerance": 1e-11, "max_iters": 200}
    want = {r.i: r.x for r in solve(a, b, None, options, strategy="local")[0].collect()}
    made, of = [], blocks.BlockSpace.of.__func__
    monkeypatch.setattr(blocks, "ENTRIES", 7)
    monkeypatch.setattr(blocks, "DRIVEN", -1)
    monkeypatch.setattr(blocks.BlockSpace, "of", classmethod(lambda cls, *x: made.append(of(cls, *x)) or made[-1]))
    x, info = solve(a, b, None, options, strategy="blocks")
    assert info["status"] == Status.SUCCESS and all(abs(r.x - want[r.i]) < 1e-8 for r in x.collect())
    cores = spark.sparkContext.defaultParallelism
    assert len(made[0].blocks.rows) > cores and made[0].blocks.rdd.getNumPartitions() <= cores


def test_entries_of_a_task_are_bounded(spark, monkeypatch):
    from krylark.operators import blocks

    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(blocks, "ENTRIES", 10)
    monkeypatch.setattr(blocks, "TASK_ENTRIES", 40)
    for parts in range(1, 20 * cores):
        tasks = blocks.tasks_for(spark.sparkContext, parts)
        assert 1 <= tasks <= parts and -(-parts // tasks) * blocks.ENTRIES <= blocks.TASK_ENTRIES


def test_a_solution_is_written_without_a_table_in_the_driver(spark):
    import numpy as np
    from krylark.operators.blocks import solution

    for n in (0, 1, 120_000):
        x = np.sqrt(np.arange(n))
        df = solution(spark, x, 3)
        assert "LocalTableScan" not in df._jdf.queryExecution().executedPlan().toString()
        got = df.toPandas()
        assert got["i"].tolist() == list(range(n)) and np.array_equal(got["x"].to_numpy(), x)


@pytest.mark.parametrize("v", [[1.0, -40.0, 32767.0], [0.5, 2.0**-20], [0.1], [40000.0, float("inf")], [-0.0, 1.0], [float("nan"), 1.0], [1e300, 1.0], []])
def test_narrow_values_are_exact(v):
    import numpy as np
    from krylark.operators.blocks import _narrow

    small = _narrow(np.array(v))
    assert np.array_equal(small.astype(float), np.array(v), equal_nan=True) and (np.signbit(small.astype(float)) == np.signbit(np.array(v))).all()
