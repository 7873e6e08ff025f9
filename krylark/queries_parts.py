"""Registered queries on parts, operators, configurations and solves on tables; registered with those of ``queries``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import formats
from .model import matrix
from .operators import partition
from .operators import solve as solving
from .plans import config as cfg
from .plans import linop
from .queries import LAP_SOLUTION, LAPLACIAN, PARTS, PRICES, TIGHT, TRADE, _grid, _pattern, cg_sql, fixed_point, laplacian, n_nations, prices, query, rounded, trade
from .sources import generators as gen
from .sources import matrix_market
from .storage import shared_root

TRI = "select i as r, i + s as c, case s when 0 then {d} else -1.0 end::double as v from range({n}) t(i), (values (-1), (0), (1)) o(s) where i + s between 0 and {n} - 1"


def _parts(parts: int, make: Callable[[int], tuple[DataFrame, int, int]]) -> DataFrame:
    """(pid, r, c, v): every part of a generated matrix, each made by itself, with global row numbers."""
    out = None
    for k in range(parts):
        rows, start, _ = make(k)
        own = rows.select(F.lit(k).alias("pid"), (F.col("r") + start).alias("r"), "c", "v")
        out = own if out is None else out.unionByName(own)
    return out


def _owned(rows: str, n: int, parts: int) -> str:
    size, extra = divmod(n, parts)
    return f"select case when r < {extra * (size + 1)} then r // {size + 1} else {extra} + (r - {extra * (size + 1)}) // {size} end::int as pid, r, c, v from ({rows})"


# Generators and sources by part


@query(_owned(TRI.format(n=23, d="4.0"), 23, 4))
def part_tridiagonal(spark, sf):
    return _parts(4, lambda k: gen.tridiagonal_part(spark, 23, k, 4, 4.0))


@query(_owned("""select (y * 7 + x)::bigint as r, ((y + dy) * 7 + x + dx)::bigint as c, case when dx = 0 and dy = 0 then 4.0 when dx < 0 or dy < 0 then -1.25 else -0.75 end::double as v
from range(7) a(x), range(4) b(y), (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) o(dx, dy) where x + dx between 0 and 6 and y + dy between 0 and 3""", 28, 3))
def part_poisson_rect(spark, sf):
    return _parts(3, lambda k: gen.poisson_rect_part(spark, 7, 4, k, 3, 0.5))


@query("select pid::int as pid, 250::bigint as rows, 250::bigint as diagonals, 0::bigint as unlike_whole from range(4) t(pid)")
def part_random(spark, sf):
    """The parts of a random matrix are those of the whole, however many there are."""
    a = gen.random_matrix(spark, 1000, 0.004, seed=5)
    parts = _parts(4, lambda k: gen.random_part(spark, 1000, k, 4, 0.004, seed=5))
    joined = parts.join(a.df.toDF("r", "c", "w"), ["r", "c"], "left")
    return joined.groupBy("pid").agg(F.countDistinct("r").alias("rows"), F.sum((F.col("r") == F.col("c")).cast("long")).alias("diagonals"), F.sum((F.col("w").isNull() | (F.col("w") != F.col("v"))).cast("long")).alias("unlike_whole"))


@query(f"with {TRADE} select r, c, round(v, 4) + 0.0 as v from trade")
def matrix_market_round_trip(spark, sf):
    """The trade matrix written as a text file of the exchange format and read back."""
    path = f"{shared_root(spark).rstrip('/')}/matrix-market-{uuid.uuid4().hex}"
    matrix_market.write_matrix_market(matrix(trade(spark, sf), n_nations(spark, sf)), path)
    return rounded(matrix_market.read_matrix_market(spark, path).df, "v", digits=4)


# Input forms


@query("select * from (values ('dense', 0, 0, 2.0), ('dense', 0, 2, -1.0), ('dense', 1, 1, 3.0), ('triple', 0, 0, 2.0), ('triple', 0, 2, -1.0), ('triple', 1, 1, 3.0), ('frame', 0, 0, 2.0), ('frame', 0, 2, -1.0), ('frame', 1, 1, 3.0)) t(form, r, c, v)".replace("select *", "select form, r::bigint as r, c::bigint as c, v::double as v"))
def input_forms(spark, sf):
    """A dense array, a compressed triple and a table with a repeated entry and narrow types give one relation."""
    frame = spark.createDataFrame([(0, 0, 1.0), (0, 0, 1.0), (0, 2, -1.0), (1, 1, 3.0)], "r int, c int, v float")
    forms = {"dense": formats.to_matrix(spark, [[2.0, 0.0, -1.0], [0.0, 3.0, 0.0]]), "triple": formats.to_matrix(spark, ([2.0, -1.0, 3.0], [0, 2, 1], [0, 2, 3]), (2, 3)), "frame": formats.to_matrix(spark, frame, (2, 3))}
    out = None
    for name, a in forms.items():
        df = a.df.select(F.lit(name).alias("form"), "r", "c", "v")
        out = df if out is None else out.unionByName(df)
    return out


@query("select * from (values ('float', 'double', 'double'), ('int', 'boolean', 'float'), ('float', 'int', 'float')) t(a, b, preferred)")
def preferred_types(spark, sf):
    return spark.createDataFrame([(a, b, formats.preferred_dtype(a, b)) for a, b in (("float", "double"), ("int", "boolean"), ("float", "int"))], "a string, b string, preferred string")


@query(f"""with {LAPLACIAN}, cells as (select r // 2 as br, c // 2 as bc, (r % 2) * 2 + c % 2 as pos, 3 * v as v from lap)
select br, bc, [{", ".join(f"coalesce(sum(v) filter (where pos = {k}), 0.0)" for k in range(4))}] as blk from cells group by br, bc""")
def refresh_blocks(spark, sf):
    """New values on the kept places of a pattern's blocks."""
    a = laplacian(spark, sf)
    a = matrix(a.df, a.shape[0] + a.shape[0] % 2)
    return formats.refresh_blocks(formats.block_slots(a, 2), a.df.select("r", "c", (3 * F.col("v")).alias("v")), 2)


@query(f"with {LAPLACIAN}, l as (select r, list(c order by c) as cols, list(v order by c) as vals from lap group by r) select r, cols, vals from l")
def lil_rows(spark, sf):
    return formats.convert(laplacian(spark, sf), "lil").toDF("r", "cols", "vals")


# Operators


@query(TRI.format(n=20, d="4.0"))
def op_tridiagonal(spark, sf):
    return rounded(linop.cache_coloring(spark, linop.tridiagonal_operator(20, 4.0), 20)[0].df, "v")


@query("""with g as (select i, j, k, i * 16 + j * 4 + k as r from range(4) a(i), range(4) b(j), range(4) d(k)), o(di, dj, dk) as (values (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))
select r::bigint as r, ((i + di) * 16 + (j + dj) * 4 + k + dk)::bigint as c, -1.0::double as v from g, o where i + di between 0 and 3 and j + dj between 0 and 3 and k + dk between 0 and 3
union all select r, r, 6.0 + 0.5 * ((i = 0)::int + (i = 3)::int + (j = 0)::int + (j = 3)::int + (k = 0)::int + (k = 3)::int) from g""")
def op_poisson3d(spark, sf):
    """With 0.5 on the diagonal for every face on the boundary."""
    return rounded(linop.cache_coloring(spark, linop.poisson3d_operator(4, robin=0.5), 64)[0].df, "v")


@query("select i as r, case when i < 8 then i else i - 8 end as c from range(12) t(i)")
def pattern_update_slice(spark, sf):
    """A start beyond the end is moved so that the slice fits."""
    x = linop.Input(12)
    return _pattern(spark, linop.update_slice(x, linop.Move(x, 4, lambda o: o), 50))


@query("select i as r, i as c from range(12) t(i) union select i, i + 1 from range(11) t(i)")
def pattern_call(spark, sf):
    x = linop.Input(12)
    return _pattern(spark, linop.Call(x - linop.Move(x, 12, lambda o: o + 1).scaled(3.0)))


@query("select i as r, i as c from range(10) t(i)")
def pattern_unused(spark, sf):
    """A term that is multiplied by zero weights leaves no trace."""
    x = linop.Input(10)
    return _pattern(spark, x + linop.Weights(linop.Move(x, 10, lambda o: 9 - o), lambda o: F.lit(0.0)))


@query("select 'tridiagonal' as operator, true as recovered, false as other union all select 'poisson', true, false")
def verify_operator(spark, sf):
    """Random vectors tell the operator's own matrix from another one."""
    rows = []
    for name, op, n in (("tridiagonal", linop.tridiagonal_operator(9, 4.0), 9), ("poisson", linop.poisson_operator(3), 9)):
        a, _ = linop.cache_coloring(spark, op, n)
        rows.append((name, linop.verify(op, a), linop.verify(op, gen.tridiagonal_matrix(spark, 9, 3.0))))
    return spark.createDataFrame(rows, "operator string, recovered boolean, other boolean")


@query("select (i - 6)::bigint as r, i + s as c, case s when 0 then 4.0 else -1.0 end::double as v from range(6, 11) t(i), (values (-1), (0), (1)) o(s) where i + s between 0 and 15")
def partition_operator(spark, sf):
    """The rows of one part of an operator, found by probing that part."""
    part = partition.partition_operator(linop.tridiagonal_operator(16, 4.0), 1, 3)
    return rounded(linop.probe(spark, part.apply, 16), "v")


@query(f"with {LAPLACIAN}, {PRICES}, n as (select count(*) as n from idx) select i, round(b, 6) + 0.0 as x from rhs, n where i >= 2 * (n // 5) + least(2, n % 5) and i < 3 * (n // 5) + least(3, n % 5)")
def partition_vector(spark, sf):
    x = prices(spark, sf)
    return rounded(partition.partition_vector(x, x.count(), 2, 5), "x")


@query("select i as place, round(i / 49.0, 6) + 0.0 as x from range(50) t(i)")
def gather_vector(spark, sf):
    got = partition.gather_vector(gen.rhs_linear(spark, 50))
    return rounded(spark.createDataFrame(list(enumerate(got)), "place long, x double"), "x")


@query("select 'forward' as step, i, round(i / 49.0, 6) + 0.0 as x from range(50) t(i) union all select 'adjoint', i, round(i / 49.0, 6) + 0.0 from range(17, 34) t(i)")
def allgather(spark, sf):
    """Every part sees the whole vector; the adjoint gives each its own slice back."""
    x = gen.rhs_linear(spark, 50)
    forward = partition.allgather(x, 50).select(F.lit("forward").alias("step"), "i", "x")
    return rounded(forward.unionByName(partition.allgather_adjoint(x, 50, 1, 3).select(F.lit("adjoint").alias("step"), "i", "x")), "x")


@query(f"with {LAPLACIAN}, {PARTS} select o.pid, count(*) as nnz, any_value(t.n) as transpose_nnz from owned o join (select owner as pid, count(*) as n from owned group by 1) t using (pid) group by 1")
def prepared_partitions(spark, sf):
    kept = partition.prepare(laplacian(spark, sf), 5)
    return kept["nnz"].join(kept["transpose_nnz"].withColumnRenamed("nnz", "transpose_nnz"), "pid").select("pid", "nnz", "transpose_nnz")


# Solves


for _name, _solver, _inner in (
    ("solve_ilu", "PBICGSTAB", "MULTICOLOR_ILU"), ("solve_chebyshev_poly", "CHEBYSHEV_POLY", {}), ("solve_unpreconditioned", "PCG", "NOSOLVER"), ("solve_symmetric_gs", "PCG", {"solver": "MULTICOLOR_GS", "symmetric_GS": 1}),
    ("solve_amg_f_cycle", "PCGF", {"solver": "AMG", "algorithm": "AGGREGATION", "selector": "SIZE_8", "cycle": "F", "min_coarse_rows": 64}), ("solve_amg_cg_cycle", "PCGF", {"solver": "AMG", "algorithm": "AGGREGATION", "selector": "MULTI_PAIRWISE", "cycle": "CG", "min_coarse_rows": 64}),
):
    def _run(spark, sf, solver=_solver, inner=_inner):
        x, _ = solving.solve(laplacian(spark, sf), prices(spark, sf), None, {"solver": solver, "preconditioner": inner, **TIGHT}, strategy="spread")
        return rounded(x, "x")

    _run.__name__ = _name
    query(LAP_SOLUTION)(_run)


@query(fixed_point("select r, c, -v as w from (" + _grid(8, -1.25, -0.75) + ") where r <> c", "select i::bigint as i, 1.0 as b, 4.0 as d from range(64) t(i)", 600))
def solve_amg_hmis(spark, sf):
    """Classical multigrid whose coarse rows come from a first pass and an independent set."""
    x, _ = solving.solve(gen.poisson_matrix(spark, 8, 0.5), gen.rhs_ones(spark, 64), None, {"preconditioner": {"solver": "AMG", "selector": "HMIS"}, "tolerance": 1e-13})
    return rounded(x, "x")


#: A small nonsymmetric grid for every method on tables, where each product is a shuffle.
_GRID_SOLUTION = fixed_point("select r, c, -v as w from (" + _grid(6, -1.25, -0.75) + ") where r <> c", "select i::bigint as i, 1.0 as b, 4.0 as d from range(36) t(i)", 400, "", "i, round(x, 4) + 0.0 as x")
for _name, _inner in (
    ("solve_table_gs", "MULTICOLOR_GS"), ("solve_table_dilu", "MULTICOLOR_DILU"), ("solve_table_cf_jacobi", "CF_JACOBI"), ("solve_table_jacobi_l1", "JACOBI_L1"), ("solve_table_chebyshev", "CHEBYSHEV"),
    ("solve_table_amg_classical", {"solver": "AMG", "driver_rows": 8}), ("solve_table_amg_aggregation", {"solver": "AMG", "algorithm": "AGGREGATION", "selector": "SIZE_4", "driver_rows": 8}),
):
    def _run_table(spark, sf, inner=_inner):
        x, _ = solving.solve(gen.poisson_matrix(spark, 6, 0.5), gen.rhs_ones(spark, 36), None, {"solver": "PBICGSTAB", "preconditioner": inner, "tolerance": 1e-9, "max_iters": 200}, strategy="table", num_partitions=4)
        return rounded(x, "x", digits=4)

    _run_table.__name__ = _name
    query(_GRID_SOLUTION)(_run_table)


@query(fixed_point("select r, c, case when r = c then 14.0 - v else -v end as w from full_a", "select i::bigint as i, 1.0 as b, 14.0 as d from range(32) t(i)", 1500, f"p as ({_grid(4, -1.0, -1.0)}), m(a, b, w) as (values (0, 0, 3.0), (0, 1, 1.0), (1, 0, 0.5), (1, 1, 2.0)), full_a as (select r * 2 + a as r, c * 2 + b as c, (v * w)::double as v from p, m)", "i, round(x, 4) + 0.0 as x"))
def solve_table_block(spark, sf):
    """Blocks of two unknowns on tables: block Jacobi inverts them."""
    a = gen.kron(gen.poisson_matrix(spark, 4), formats.to_matrix(spark, [[3.0, 1.0], [0.5, 2.0]]))
    x, _ = solving.solve(a, gen.rhs_ones(spark, 32), None, {"solver": "PBICGSTAB", "preconditioner": "BLOCK_JACOBI", "tolerance": 1e-9}, strategy="table", num_partitions=4, block_dim=2)
    return rounded(x, "x", digits=4)


@query(fixed_point("select i as r, i + s as c, 1.0 as w from range(32) t(i), (values (-1), (1)) o(s) where i + s between 0 and 31", "select i::bigint as i, 1.0 as b, 4.0 as d from range(32) t(i)", 120))
def solve_own_preconditioner(spark, sf):
    """The caller's own preconditioner, a function of the space and the residual: a quarter of it."""
    x, _ = solving.solve(gen.tridiagonal_matrix(spark, 32, 4.0), gen.rhs_ones(spark, 32), None, {"solver": "PBICGSTAB", "tolerance": 1e-11}, strategy="table", num_partitions=4, preconditioner=lambda sp, r: sp.lin((0.25, r)))
    return rounded(x, "x")


@query(cg_sql(TRI.format(n=24, d="4.0"), "select i::bigint as i, 1.0 as b from range(24) t(i)", 24, "select i, round(x, 6) + 0.0 as x from it where k = 16"))
def preconditioner_correction(spark, sf):
    """A dense preconditioner's correction of a residual is the solution."""
    return rounded(solving.make_preconditioner(gen.tridiagonal_matrix(spark, 24, 4.0), {"solver": "DENSE_LU_SOLVER"})(gen.rhs_ones(spark, 24)), "x")


@query(cg_sql(TRI.format(n=8, d="4.0"), "select i::bigint as i, 1.0 as b from range(8) t(i)", 8, "select i, round(x, 6) + 0.0 as x from it where k = 4"))
def preconditioner_operator(spark, sf):
    """The same as a node of an operator tree, with all rows summed."""
    op = solving.as_operator(solving.make_preconditioner(gen.tridiagonal_matrix(spark, 8, 4.0), {"solver": "DENSE_LU_SOLVER"}), 8)
    m = linop.probe(spark, op.apply, 8)
    return rounded(m.groupBy(F.col("r").alias("i")).agg(F.sum("v").alias("x")), "x")


@query("select i, 0.0::double as x from range(32) t(i)")
def adjoint_x0(spark, sf):
    """The gradient by the first guess is zero."""
    a, ones = gen.tridiagonal_matrix(spark, 32, 4.0), gen.rhs_ones(spark, 32)
    return solving.solve_vjp(a, ones, ones, {"solver": "CG"})[2]


@query(cg_sql(TRI.format(n=24, d="4.0"), "select i::bigint as i, i / 23.0 as b from range(24) t(i)", 24, "select i, round(x, 6) + 0.0 as x from it where k = 16"))
def symmetric_transpose(spark, sf):
    """A matrix that is marked symmetric is not transposed."""
    a = gen.tridiagonal_matrix(spark, 24, 4.0).with_meta(symmetric=True)
    return rounded(solving.solve_transpose(a, gen.rhs_linear(spark, 24), {"solver": "CG", **TIGHT})[0], "x")


@query("select * from (values (0, 5.5413, 2.2774), (1, 1.5938, 1.1939), (2, 0.5020, 0.6397)) t(step, loss, norm)".replace("select *", "select step, loss::double as loss, norm::double as norm"))
def descent(spark, sf):
    """Three steps of gradient descent over the right-hand side: solve, adjoint solve, step."""
    a = gen.tridiagonal_matrix(spark, 64, 4.0)
    options = {"solver": "CG", **TIGHT}
    target = np.linspace(0, 1, 64)

    def solved(b: np.ndarray) -> np.ndarray:
        x, _ = solving.solve(a, spark.createDataFrame(list(enumerate(b.tolist())), "i long, x double"), None, options)
        return np.array(partition.gather_vector(x))

    def step(b: np.ndarray):
        gap = solved(b) - target
        return float(gap @ gap), solved(2 * gap)

    log = solving.gradient_descent(step, np.ones(64), 1.0, 3, 1e-3, lambda g: float(np.linalg.norm(g)))
    return spark.createDataFrame([(k, round(loss, 4), round(norm, 4)) for k, (loss, norm, _) in enumerate(log)], "step int, loss double, norm double")


# Configurations


def _flat(value: object, path: str = "") -> list[tuple[str, str]]:
    if isinstance(value, dict):
        return [x for k in sorted(value) for x in _flat(value[k], f"{path}.{k}" if path else k)]
    return [(path, json.dumps(value))]


_CASES = {
    "default": lambda: cfg.prepare(), "flat": lambda: cfg.prepare({"solver": "CG", "tolerance": 1e-3}, max_iters=7), "nested": lambda: cfg.prepare({"config_version": 2, "solver": {"solver": "FGMRES", "gmres_n_restart": 5}}),
    "no_amg": lambda: cfg.prepare({"preconditioner": {"solver": "JACOBI_L1"}}), "blocks": lambda: cfg.prepare(block_dim=2), "distributed_blocks": lambda: cfg.prepare(block_dim=2, distributed=True), "stats": lambda: cfg.prepare(save_stats=True),
    "preconditioner": lambda: cfg.prepare_preconditioner(), "merged": lambda: json.dumps(formats.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}})),
}
_WANTED = [
    ("default", "solver.solver", '"PBICGSTAB"'), ("default", "solver.tolerance", "1e-06"), ("default", "solver.max_iters", "1000"), ("default", "solver.convergence", '"RELATIVE_INI"'), ("default", "solver.preconditioner.selector", '"PMIS"'), ("default", "solver.store_res_history", "1"),
    ("flat", "solver.solver", '"CG"'), ("flat", "solver.tolerance", "0.001"), ("flat", "solver.max_iters", "7"), ("nested", "solver.gmres_n_restart", "5"), ("nested", "config_version", "2"), ("no_amg", "solver.preconditioner.solver", '"JACOBI_L1"'),
    ("blocks", "solver.preconditioner.algorithm", '"AGGREGATION"'), ("blocks", "solver.preconditioner.coarse_solver", '"DENSE_LU_SOLVER"'), ("distributed_blocks", "solver.preconditioner.coarse_solver.solver", '"BLOCK_JACOBI"'), ("distributed_blocks", "solver.preconditioner.coarse_solver.max_iters", "50"),
    ("stats", "solver.print_solve_stats", "1"), ("stats", "solver.preconditioner.print_grid_stats", "1"), ("preconditioner", "solver.solver", '"AMG"'), ("preconditioner", "solver.max_iters", "1"), ("merged", "a.b", "1"), ("merged", "a.c", "3"),
]


@query("select * from (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _WANTED) + ") t(config, path, value)")
def config_values(spark, sf):
    """Values that complete configurations have, by case and path."""
    rows = [(case, path, value) for case, make in _CASES.items() for path, value in _flat(json.loads(make())) if (case, path) in {x[:2] for x in _WANTED}]
    return spark.createDataFrame(rows, "config string, path string, value string")


_BAD = [
    ("max_iters", {"max_iters": 0}, {}, "ValueError"), ("tolerance", {"tolerance": -1.0}, {}, "ValueError"), ("communicator", {"communicator": "BAD"}, {}, "ValueError"), ("restart", {"solver": "GMRES", "gmres_n_restart": 0}, {}, "ValueError"),
    ("levels", {"preconditioner": {"solver": "AMG", "max_levels": 0}}, {}, "ValueError"), ("sweeps", {"preconditioner": {"solver": "AMG", "presweeps": -1}}, {}, "ValueError"), ("no sweeps", {"preconditioner": {"solver": "AMG", "presweeps": 0}}, {}, "none"),
    ("smoother", {"preconditioner": {"solver": "AMG", "smoother": []}}, {}, "TypeError"), ("classical blocks", {"preconditioner": {"solver": "AMG", "algorithm": "CLASSICAL"}}, {"block_dim": 2}, "ValueError"),
    ("dense blocks", {"preconditioner": {"solver": "AMG", "coarse_solver": "DENSE_LU_SOLVER"}}, {"block_dim": 2, "distributed": True, "compat": True}, "ValueError"), ("text", "CG", {}, "TypeError"), ("inner list", {"config_version": 2, "solver": []}, {}, "TypeError"), ("good", {"communicator": "mpi"}, {}, "none"),
]


@query("select * from (values " + ", ".join(f"('{n}', '{e}')" for n, _, _, e in _BAD) + ") t(config, error)")
def config_errors(spark, sf):
    rows = []
    for name, user, options, _ in _BAD:
        try:
            cfg.prepare(user, **options)
            rows.append((name, "none"))
        except (TypeError, ValueError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "config string, error string")


@query("select * from (values ('default', 1000), ('given', 9), ('text', 100), ('zero', 100)) t(config, iterations)")
def config_max_iters(spark, sf):
    cases = {"default": cfg.prepare(), "given": cfg.prepare(max_iters=9), "text": "?", "zero": '{"solver": {"max_iters": 0}}'}
    return spark.createDataFrame([(k, cfg.outer_max_iters(v)) for k, v in cases.items()], "config string, iterations int")
