"""Formats, configuration, operators' patterns, Matrix Market files and streaming solves."""

import json
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from krylark.functions import formats
from krylark.model import matrix
from krylark.operators import algebra, amg, partition
from krylark.plans import config, linop
from krylark.sources import generators as gen
from krylark.sources.matrix_market import format_stats, read_matrix_market, write_matrix_market


def dense(a):
    out = np.zeros(a.shape)
    for r in a.df.collect():
        out[r.r, r.c] += r.v
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([0.0, 0.0, 1.0, -2.5]), min_size=3, max_size=3), min_size=2, max_size=5))
def test_round_trips(spark, rows):
    a = formats.to_matrix(spark, rows)
    want = np.array(rows)
    assert (dense(a) == want).all()
    assert (dense(algebra.transpose(algebra.transpose(a))) == want).all()
    assert (dense(matrix(formats.expand_csr(formats.to_csr_rows(a.df)), *a.shape)) == want).all()
    x = spark.createDataFrame([(i, float(i + 1)) for i in range(3)], "i long, x double")
    assert partition.gather_vector(algebra.spmv(a, x)) == pytest.approx((want @ [1, 2, 3]).tolist())


def test_input_forms(spark):
    want = np.array([[2.0, 0, -1], [0, 3, 4]])
    triple = ([2.0, -1.0, 3.0, 4.0], [0, 2, 1, 2], [0, 2, 4])
    assert (dense(formats.to_matrix(spark, triple, (2, 3))) == want).all()
    twice = spark.createDataFrame([(0, 0, 1.0), (0, 0, 1.0)], "r long, c long, v double")
    assert dense(formats.to_matrix(spark, twice, (1, 1)))[0, 0] == 2.0
    with pytest.raises(TypeError):
        formats.to_matrix(spark, "matrix")
    with pytest.raises(ValueError):
        formats.to_matrix(spark, np.zeros(3))
    with pytest.raises(ValueError):
        formats.to_matrix(spark, twice)
    with pytest.raises(ValueError):
        formats.convert(formats.to_matrix(spark, want), "xyz")
    assert formats.preferred_dtype("float", "double") == "double" and formats.preferred_dtype("int", "boolean") == "float"


def test_matrix_market(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.0\n3 1 -1.5\n2 2 1\n")
    a = read_matrix_market(spark, str(tmp_path / "a.mtx"))
    assert (dense(a) == [[2, 0, -1.5], [0, 1, 0], [-1.5, 0, 0]]).all()
    write_matrix_market(formats.to_matrix(spark, [[2.0, 0, -1], [0, 3, 4]]), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("%%MatrixMarket") and len(text.strip().splitlines()) == 6
    with pytest.raises(ValueError):
        (tmp_path / "b.mtx").write_text("no header\n")
        read_matrix_market(spark, str(tmp_path / "b.mtx"))


def test_stats_text():
    from krylark.model import Status

    text = format_stats({"residual_history": [1.0, 0.1], "status": Status.SUCCESS, "iterations": 1, "residual": 0.1}, [(0, 10, 28)])
    assert "AMG GRID STATISTICS" in text and "SOLVER ITERATIONS" in text and "SUCCESS" in text


def test_config():
    full = json.loads(config.prepare())["solver"]
    assert full["solver"] == "PBICGSTAB" and full["preconditioner"]["selector"] == "PMIS" and full["tolerance"] == 1e-6 and full["store_res_history"] == 1
    plain = json.loads(config.prepare({"preconditioner": {"solver": "JACOBI_L1"}}))["solver"]
    assert plain["preconditioner"] == {"solver": "JACOBI_L1"}
    assert json.loads(config.prepare(preconditioner={"solver": "JACOBI_L1"}))["solver"]["preconditioner"] == {"solver": "JACOBI_L1"}
    nested = json.loads(config.prepare({"config_version": 2, "solver": {"solver": "CG"}}, max_iters=7))
    assert nested["solver"]["solver"] == "CG" and nested["solver"]["max_iters"] == 7
    assert json.loads(config.prepare(block_dim=2))["solver"]["preconditioner"]["algorithm"] == "AGGREGATION"
    assert config.prepare({"a": 1, "b": 2}) == config.prepare({"b": 2, "a": 1})
    assert config.outer_max_iters(config.prepare(max_iters=9)) == 9 and config.outer_max_iters("?") == 100
    for bad in ({"max_iters": 0}, {"tolerance": 0.0}, {"communicator": "BAD"}, {"solver": "GMRES", "gmres_n_restart": 0}, {"preconditioner": {"solver": "AMG", "max_levels": 0}}, {"preconditioner": {"solver": "AMG", "presweeps": -1}}):
        with pytest.raises(ValueError):
            config.prepare(bad)
    with pytest.raises(TypeError):
        config.prepare("CG")
    with pytest.raises(TypeError):
        config.prepare({"preconditioner": {"solver": "AMG", "smoother": []}})
    with pytest.raises(ValueError):
        config.prepare({"preconditioner": {"solver": "AMG", "algorithm": "CLASSICAL"}}, block_dim=2)
    with pytest.raises(ValueError):
        config.prepare({"preconditioner": {"solver": "AMG", "coarse_solver": "DENSE_LU_SOLVER"}}, block_dim=2, distributed=True, compat=True)
    assert json.loads(config.prepare_preconditioner())["solver"]["max_iters"] == 1


def _probed(spark, op, n):
    return {(r.r, r.c) for r in linop.probe(spark, op.apply, n).collect()}


X = linop.Input(12)


def random_tree(rng, depth):
    """An operator from 12 to 12 values of randomly chosen nodes; all factors are positive, so that nothing cancels."""
    if depth == 0:
        return X
    x = random_tree(rng, depth - 1)
    a, b, lo = rng.choice([1, 5, 7, 11]), rng.randrange(12), rng.randrange(6)
    hi = lo + rng.randrange(1, 7)
    inside = lambda o: (o >= lo) & (o < hi)
    cut = 1 + rng.randrange(11)
    kinds = {
        "permuted": lambda: linop.Move(x, 12, lambda o: (a * o + b) % 12),
        "part of it": lambda: linop.Move(x, 12, lambda o: F.when(inside(o), (a * o + b) % 12)),
        "sum of two": lambda: x.scaled(1.5) + random_tree(rng, depth - 1),
        "folded": lambda: linop.Move(linop.Reduce(x, 4, lambda i: (i + b) % 4), 12, lambda o: (a * o) % 4),
        "weighted": lambda: linop.Weights(x, lambda o: F.when(inside(o), 0.0).otherwise(o + 1.0)),
        "chosen": lambda: linop.Where(inside, x, linop.Move(x, 12, lambda o: (o + b) % 12)),
        "written over": lambda: linop.Scatter(x, linop.Move(x, 3, lambda o: o + lo), lambda u: (5 * u + b) % 12),
        "added at": lambda: linop.Scatter(x, linop.Move(x, 5, lambda o: (o + b) % 12), lambda u: u + lo, add=True),
        "slice put": lambda: linop.update_slice(x, linop.Move(x, 4, lambda o: o + lo), b),
        "joined": lambda: linop.Concat([linop.Move(x, cut, lambda o: 11 - o), linop.Move(x, 12 - cut, lambda o: o)]),
        "stencil": lambda: linop.Conv(x, (4, 3), [((0, 0), 2.0), ((0, 1), 0.0), ((1, -1), 0.5), ((-1, 0), 1.0)]),
        "repeated": lambda: linop.scan(x, lambda c, k: c + linop.Move(c, 12, lambda o: o - 2), 2),
        "called": lambda: linop.Call(x.scaled(0.5)),
    }
    return rng.choice(list(kinds.values()))()


@pytest.mark.parametrize("seed", range(16))
def test_traced_pattern_is_the_probed_one(spark, seed):
    op = random_tree(random.Random(seed), 3)
    traced = {(r.r, r.c) for r in linop.trace_pattern(spark, op).collect()}
    assert traced == _probed(spark, op, 12)


def test_opaque_and_long_scans_fall_back(spark):
    opaque = linop.Opaque(X, 12, lambda x: x)
    assert linop.trace_pattern(spark, opaque) is None
    assert _probed(spark, opaque, 12) == {(i, i) for i in range(12)}
    with pytest.raises(linop.NotTraceable):
        linop.scan(X, lambda c, k: c, 5000)


def test_materialized_operators(spark):
    for op, want in ((linop.tridiagonal_operator(9, 4.0), gen.tridiagonal_matrix(spark, 9, 4.0)), (linop.poisson_operator(4, 0.5), gen.poisson_matrix(spark, 4, 0.5)), (linop.poisson_operator(4, 0.5, flip=True), algebra.transpose(gen.poisson_matrix(spark, 4, 0.5))), (linop.poisson3d_operator(3), gen.poisson3d_matrix(spark, 3))):
        a, coloring = linop.cache_coloring(spark, op, want.shape[1])
        assert np.allclose(dense(a), dense(want)) and coloring.n_colors <= want.shape[0]
        assert linop.verify(op, a)
    robin = dense(linop.cache_coloring(spark, linop.poisson3d_operator(3, robin=2.0), 27)[0])
    assert robin[0, 0] == 12.0 and robin[13, 13] == 6.0


def test_galerkin_and_partition_oracles(spark):
    a = gen.poisson_matrix(spark, 6)
    agg = amg.numbered(amg.aggregates(a, 2)).persist()
    p = np.zeros((36, agg.agg({"agg": "max"}).first()[0] + 1))
    for r in agg.collect():
        p[r.i, r.agg] = 1
    assert (p.sum(axis=1) == 1).all() and (p.sum(axis=0) >= 1).all() and p.shape[1] < 30
    coarse = matrix(amg.galerkin(a, agg).df, p.shape[1])
    assert np.allclose(dense(coarse), p.T @ dense(a) @ p)
    for n, parts in ((10, 3), (3, 5), (7, 7)):
        size, extra = divmod(n, parts)
        want = [k for k in range(parts) for _ in range(size + (k < extra))]
        got = [r.p for r in spark.range(n).orderBy("id").select(partition.owner(F.col("id"), n, parts).alias("p")).collect()]
        assert got == want


def test_warm_solves_over_a_stream(spark, tmp_path):
    from krylark.streaming.warm import warm_solves

    a = gen.tridiagonal_matrix(spark, 16, 4.0)
    for k in range(2):
        gen.rhs_ones(spark, 16).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = []
        stream = spark.readStream.schema("i long, x double").parquet(str(tmp_path / "in"))
        q = warm_solves(a, stream, lambda x, info, epoch: seen.append((partition.gather_vector(x), info)), {"solver": "CG", "tolerance": 1e-10}).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = np.linalg.solve(dense(a), np.full(16, k + 1.0))
        assert np.allclose(seen[-1][0], want, atol=1e-8)


def test_archives(spark, tmp_path):
    import tarfile

    (tmp_path / "toy.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 3 4\n1 1 2\n1 3 -1\n2 2 3\n2 3 4\n")
    with tarfile.open(tmp_path / "toy.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "toy.mtx", "toy/toy.mtx")
    from krylark.sources.matrix_market import unpack_archive

    path = unpack_archive(str(tmp_path / "toy.tar.gz"), str(tmp_path / "cache"))
    assert (dense(read_matrix_market(spark, path)) == [[2, 0, -1], [0, 3, 4]]).all()
    assert unpack_archive(str(tmp_path / "gone.tar.gz"), str(tmp_path / "cache"), "toy") == path
    with pytest.raises(FileNotFoundError):
        unpack_archive(str(tmp_path / "toy.tar.gz"), str(tmp_path / "cache"), "other")


def test_collections(spark, tmp_path):
    from krylark.sources.matrix_market import load_collection

    (tmp_path / "Group").mkdir()
    (tmp_path / "Group" / "tiny.mtx").write_text("%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 5\n")
    for a in (load_collection(spark, str(tmp_path), "tiny", "Group"), load_collection(spark, str(tmp_path), "Group/tiny")):
        assert (dense(a) == [[0, -5], [5, 0]]).all()
    with pytest.raises(FileNotFoundError, match="huge"):
        load_collection(spark, str(tmp_path), "Group/huge")
    with pytest.raises(ValueError):
        load_collection(spark, str(tmp_path), "tiny")


def test_shapes_of_operators_are_checked(spark):
    for shape in (8, (9, 8), (8, 9)):
        with pytest.raises(ValueError, match="shape"):
            linop.cache_coloring(spark, linop.tridiagonal_operator(9), shape)
    assert linop.cache_coloring(spark, linop.tridiagonal_operator(5), (5, 5))[0].shape == (5, 5)


def test_columns_of_a_full_row_all_differ(spark):
    p = spark.range(40).selectExpr("id % 2 as r", "id as c").unionByName(spark.range(40).selectExpr("5 + id as r", "id as c"))
    colors = {r.c: r.color for r in linop.color_columns(p).collect()}
    assert len(colors) == 40
    for k in range(2):
        own = [colors[c] for c in range(k, 40, 2)]
        assert len(set(own)) == 20


def test_blocks_refresh_and_operator_parts(spark):
    from krylark.operators.solve import as_operator, make_preconditioner

    a = gen.kron(gen.tridiagonal_matrix(spark, 4), formats.to_matrix(spark, [[2.0, 1.0], [0.0, 3.0]]))
    twice = a.df.selectExpr("r", "c", "2 * v as v")
    want = {(r.br, r.bc): r.blk for r in formats.to_bsr(matrix(twice, 8), 2).collect()}
    assert {(r.br, r.bc): r.blk for r in formats.refresh_blocks(formats.block_slots(a, 2), twice, 2).collect()} == want
    op = linop.tridiagonal_operator(7, 4.0)
    rows = np.vstack([dense(matrix(linop.probe(spark, partition.partition_operator(op, k, 3).apply, 7), partition.partition_operator(op, k, 3).n, 7)) for k in range(3)])
    assert np.allclose(rows, dense(gen.tridiagonal_matrix(spark, 7, 4.0)))
    kept = partition.prepare(a, 3)
    assert sum(r.nnz for r in kept["nnz"].collect()) == a.nnz() == sum(r.nnz for r in kept["transpose_nnz"].collect())
    x = gen.rhs_linear(spark, 7)
    assert partition.allgather(x, 7).count() == 7 and partition.allgather_adjoint(x, 7, 0, 3).count() == 3
    p = as_operator(make_preconditioner(gen.tridiagonal_matrix(spark, 7, 4.0), {"solver": "DENSE_LU_SOLVER"}), 7)
    inverse = dense(matrix(linop.probe(spark, p.apply, 7), 7))
    assert np.allclose(inverse, np.linalg.inv(dense(gen.tridiagonal_matrix(spark, 7, 4.0))))
