"""Solving A x = b: one numpy task for small systems, a driven loop over tables for large ones."""

from __future__ import annotations

import json
import os
import pickle
import zlib
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SolveError, SparseMatrix, Status
from ..plans import config as cfg
from ..storage import shared_root
from .algebra import sddmm, structure_hash, transpose
from .amg import hierarchy
from .blocks import BlockSpace, solution
from .krylov import KRYLOV, LOCAL_ONLY, PLAIN, RELAXATIONS, Stop, preconditioned_richardson
from .spaces import LocalSpace, TableSpace

#: Systems with at most so many entries and rows are solved in one task (about 200 MB of arrays).
LOCAL_ENTRIES, LOCAL_ROWS = 2_000_000, 1_000_000
#: Systems with at most so many rows have their vectors in the driver (16 MB each) and their matrix in blocks.
BLOCK_ROWS = 2_000_000
RESULT = "batch long, i long, x double, iterations int, residual double, status int, residual_history array<double>"
DETAILS = RESULT + ", grid array<array<long>>, setup binary"


def _preconditioner(sp: Any, entry: Any, options: dict) -> Callable | None:
    block = {"solver": entry} if isinstance(entry, str) else dict(entry or {})
    name = str(block.get("solver", "")).upper()
    block.setdefault("block_dim", options.get("block_dim", 1))
    if not name or name == "NOSOLVER":
        return None
    sweeps = int(block.get("max_iters", 1))
    if name == "AMG":
        one = hierarchy(sp, block).cycle
    elif name in RELAXATIONS:
        one = RELAXATIONS[name](sp, block)
    elif name in KRYLOV:
        inner = _preconditioner(sp, block.get("preconditioner"), options)

        def krylov(r):
            return KRYLOV[name](sp, r, sp.zero(), Stop("ABSOLUTE", 0.0, sweeps), None if name in PLAIN else inner, block)

        return krylov
    else:
        raise ValueError(f"unknown solver {name!r}")
    if sweeps == 1 or name == "DENSE_LU_SOLVER":
        return one

    def several(r):
        z = one(r)
        for _ in range(sweeps - 1):
            z = sp.lin((1.0, z), (1.0, one(sp.lin((1.0, r), (-1.0, sp.mul(z))))))
        return z

    return several


def run(sp: Any, b: Any, x0: Any, options: dict, m: Callable | None = None) -> tuple[Any, Stop]:
    """Solves in any space under the options of an outer scope."""
    stop = Stop(options.get("convergence", "RELATIVE_INI"), options.get("tolerance", 1e-6), options.get("max_iters", 1000), options.get("alt_rel_tolerance"), options.get("norm", "L2"))
    name = str(options.get("solver", "PBICGSTAB")).upper()
    if name in KRYLOV:
        given = None if name in PLAIN else m or _preconditioner(sp, options.get("preconditioner"), options)
        return KRYLOV[name](sp, b, x0, stop, given, options), stop
    if name == "NOSOLVER":
        return b, stop
    one = m or _preconditioner(sp, {**options, "max_iters": 1}, options)
    return preconditioned_richardson(sp, b, x0, stop, one, options), stop


def _only_local(scope: Any, given: bool) -> str | None:
    """What of an outer scope runs in one task only; ``given``: the caller's own preconditioner takes the scope's place."""
    scope = {"solver": scope} if isinstance(scope, str) else dict(scope or {})
    name = str(scope.get("solver", "PBICGSTAB")).upper()
    if name in LOCAL_ONLY:
        return name
    if name == "AMG":  # its coarse solver always runs on a level that is counted to be small
        return _only_local(scope.get("smoother", "BLOCK_JACOBI"), False)
    if given or name not in KRYLOV or name in PLAIN or not scope.get("preconditioner"):
        return None
    inner = scope["preconditioner"]
    return _only_local(inner, False) if isinstance(inner, str) or inner.get("solver") else None


def _on_blocks(scope: Any, given: bool) -> bool:
    """Whether blocks run all of an outer scope: all but dense factors and multigrid that is not plain aggregation."""
    scope = {"solver": scope} if isinstance(scope, str) else dict(scope or {})
    name = str(scope.get("solver", "PBICGSTAB")).upper()
    if name == "DENSE_LU_SOLVER":
        return False
    if name == "AMG":
        smoother = scope.get("smoother", "BLOCK_JACOBI")
        below = str(smoother if isinstance(smoother, str) else smoother.get("solver", "BLOCK_JACOBI")).upper()
        return str(scope.get("algorithm", "CLASSICAL")).upper() == "AGGREGATION" and int(scope.get("block_dim", 1)) == 1 and not int(scope.get("aggressive_levels", 0)) and below not in ("CF_JACOBI", "DENSE_LU_SOLVER")
    if given or name not in KRYLOV or name in PLAIN or not scope.get("preconditioner"):
        return True
    inner = scope["preconditioner"]
    inner = {"solver": inner} if isinstance(inner, str) else dict(inner)
    return not inner.get("solver") or _on_blocks({"block_dim": scope.get("block_dim", 1), **inner}, False)


def _local_task(n: int, options: dict, setup: bytes | None = None, keep: bool | None = None) -> Callable:
    """``setup``: what an earlier solve with the same pattern worked out; ``keep``: hand back what this one did, and (unless None) its grid."""

    def task(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        sp = LocalSpace(n, a["r"], a["c"], a["v"])
        if setup:
            sp.kept = pickle.loads(zlib.decompress(setup))
        right, first = np.zeros(n), np.zeros(n)
        right[b["i"].to_numpy()] = b["x"]
        first[b["i"].to_numpy()] = b["x0"]
        with np.errstate(all="ignore"):
            try:
                x, stop = run(sp, right, first, options)
                status, info = int(stop.status), stop.info()
            except SolveError:
                x, status, info = np.full(n, np.nan), int(Status.FAILED), {"iterations": 0, "residual": float("nan"), "residual_history": []}
        out = pd.DataFrame({"batch": key[0], "i": np.arange(n), "x": x, "iterations": info["iterations"], "residual": info["residual"], "status": status})
        out["residual_history"] = [info["residual_history"] if k == 0 else None for k in range(n)]
        if keep is not None:
            out["grid"] = [[list(map(int, level)) for level in sp.grid or []] if k == 0 else None for k in range(n)]
            out["setup"] = [zlib.compress(pickle.dumps(sp.kept), 1) if keep and k == 0 else None for k in range(n)]
        return out

    return task


def check_vector(x: DataFrame, n: int, name: str) -> None:
    """Raises if a vector has a row outside of 0 to n - 1; rows that it lacks are zeros."""
    low, high = x.toDF("i", "x").agg(F.min("i"), F.max("i")).first()
    if low is not None and (low < 0 or high >= n):
        raise ValueError(f"{name} has rows {low} to {high}, the matrix has {n}")


def solve_batched(a: DataFrame, b: DataFrame, n: int, config: dict | None = None, *, block_dim: int = 1, **options: Any) -> DataFrame:
    """Every batch's solution with its own status: ``a`` (batch, r, c, v), ``b`` (batch, i, x); lanes run side by side.

    A lane is one task, so its entries are counted; one that is too large raises and is for ``solve``.
    """
    scope = json.loads(cfg.prepare(config, block_dim=block_dim, **options))["solver"] | {"block_dim": block_dim}
    left = a.select(F.col("batch").cast("long"), F.col("r").cast("long"), F.col("c").cast("long"), F.col("v").cast("double"))
    right = b.select(F.col("batch").cast("long"), F.col("i").cast("long"), F.col("x").cast("double"), F.lit(0.0).alias("x0"))
    largest = left.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    if largest > LOCAL_ENTRIES or n > LOCAL_ROWS:
        raise ValueError(f"a lane has {largest} entries and {n} rows; lanes take {LOCAL_ENTRIES} entries and {LOCAL_ROWS} rows at most")
    return left.groupBy("batch").cogroup(right.groupBy("batch")).applyInPandas(_local_task(n, scope), RESULT)


class _Setups:
    """What solves worked out from patterns alone (coarse rows, aggregates, colors), by configuration and pattern; the oldest goes first.

    Values are never kept: a solve with the same pattern takes its own.
    """

    def __init__(self) -> None:
        self.kept: OrderedDict[tuple, bytes] = OrderedDict()

    @property
    def capacity(self) -> int:
        return max(0, int(os.environ.get("KRYLARK_CACHE_SIZE", "1")))

    def get(self, key: tuple) -> bytes | None:
        if key in self.kept:
            self.kept.move_to_end(key)
        return self.kept.get(key)

    def put(self, key: tuple, setup: bytes) -> None:
        self.kept.pop(key, None)
        while self.kept and len(self.kept) >= max(self.capacity, 1):
            self.kept.popitem(last=False)
        if self.capacity:
            self.kept[key] = setup

    def clear(self) -> None:
        self.kept.clear()


_SETUPS = _Setups()


def clear_cache() -> None:
    _SETUPS.clear()


finalize = clear_cache


def cache_info() -> dict[str, Any]:
    entries = [{"config": k[0], "shape": k[1][:2], "entries": k[1][-1]} for k in _SETUPS.kept]
    return {"size": len(entries), "capacity": _SETUPS.capacity, "isolated_mode": _SETUPS.capacity == 0, "entries": entries}


def solve(
    a: SparseMatrix, b: DataFrame, x0: DataFrame | None = None, config: dict | None = None, *, block_dim: int = 1, num_partitions: int | None = None,
    strategy: str = "auto", reuse_setup: bool = False, save_stats_file: str | None = None, preconditioner: Callable | None = None, **options: Any,
) -> tuple[DataFrame, dict[str, Any]]:
    """(x, info): info has iterations, residual, status and residual_history (entry 0 is the initial residual).

    ``strategy``: ``local`` (one task), ``blocks`` (vectors in the driver, the matrix in blocks on the executors), ``table`` (a
    loop over distributed tables), ``auto``, by the counted size, or ``spread``, as ``auto`` but with blocks for all that they run.
    All run the same methods.  Tables have no MULTICOLOR_ILU and no DENSE_LU_SOLVER: those raise beyond one task under ``auto``, and
    nothing takes their place; MULTICOLOR_ILU runs on blocks where ``blocks`` or ``spread`` asks for them.
    ``reuse_setup`` keeps what was worked out from a pattern (coarse rows, aggregates, colors) for the next matrix with
    that pattern and configuration, whose own values are always taken.  ``preconditioner`` maps a residual to a
    correction in the space where the solve runs.
    """
    n, m = a.shape
    if n != m:
        raise ValueError(f"the matrix must be square, not {a.shape}")
    if n % block_dim:
        raise ValueError(f"{n} rows do not divide into blocks of {block_dim}")
    check_vector(b, n, "b")
    if x0 is not None:
        check_vector(x0, n, "x0")
    text = cfg.prepare(config, save_stats=save_stats_file is not None, distributed=strategy == "table", block_dim=block_dim, **options)
    scope = json.loads(text)["solver"] | {"block_dim": block_dim}
    # computed once: counted, hashed and solved from the same rows
    df = a.df.persist()
    try:
        key = (text, structure_hash(SparseMatrix(df, a.meta))) if reuse_setup else None
        spread, entries = strategy == "spread", 0
        if strategy in ("auto", "spread", "blocks"):
            entries = df.count()
        if strategy in ("auto", "spread"):
            strategy = "local" if n <= LOCAL_ROWS and entries <= LOCAL_ENTRIES else "blocks" if n <= BLOCK_ROWS and _on_blocks(scope, preconditioner is not None) else "table"
            if strategy == "blocks" and not spread and _only_local(scope, preconditioner is not None):
                strategy = "table"  # raises
        if strategy == "blocks" and not _on_blocks(scope, preconditioner is not None):
            raise ValueError("blocks have no dense factors and no multigrid but aggregation of single rows")
        if strategy == "table" and (name := _only_local(scope, preconditioner is not None)):
            raise ValueError(f"{name} runs in one task only, for at most {LOCAL_ENTRIES} entries and {LOCAL_ROWS} rows")
        kept = SparseMatrix(df, a.meta)
        if strategy == "local":
            x_df, info = _solve_local(kept, b, x0, scope, key)
        elif strategy == "blocks":
            x_df, info = _solve_blocks(kept, entries, b, x0, scope, num_partitions, preconditioner)
        else:
            x_df, info = _solve_table(kept, b, x0, scope, num_partitions, preconditioner)
    finally:
        df.unpersist()
    if info["status"] == Status.FAILED:
        raise SolveError("the solver failed")
    if save_stats_file:
        from ..sources.matrix_market import save_stats

        save_stats(save_stats_file, info, info.get("grid"))
    return x_df, info


def _solve_local(a: SparseMatrix, b: DataFrame, x0: DataFrame | None, scope: dict, key: tuple | None) -> tuple[DataFrame, dict]:
    n, spark = a.shape[0], a.df.sparkSession
    right = b.toDF("i", "x")
    right = right.withColumn("x0", F.lit(0.0)) if x0 is None else right.join(x0.toDF("i", "x0"), "i", "full").select("i", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("x0", F.lit(0.0)).alias("x0"))
    left = a.df.withColumn("batch", F.lit(0).cast("long"))
    right = right.withColumn("batch", F.lit(0).cast("long"))
    shared_root(spark)
    # one task on purpose: the size is counted before
    task = _local_task(n, scope, _SETUPS.get(key) if key else None, key is not None)
    out = left.groupBy("batch").cogroup(right.groupBy("batch")).applyInPandas(task, DETAILS).checkpoint()
    row = out.where("i = 0").first()
    if row is None:
        return out.select("i", "x"), {"iterations": 0, "residual": 0.0, "status": Status.SUCCESS, "residual_history": [0.0]}
    if key:
        _SETUPS.put(key, bytes(row.setup))
    info = {"iterations": row.iterations, "residual": row.residual, "status": Status(row.status), "residual_history": list(row.residual_history or [])}
    if row.grid:
        info["grid"] = [tuple(level) for level in row.grid]
    return out.select("i", "x"), info


def _solve_table(a: SparseMatrix, b: DataFrame, x0: DataFrame | None, scope: dict, parts: int | None, m: Callable | None) -> tuple[DataFrame, dict]:
    sp = TableSpace(a, {"b": b} | ({"x0": x0} if x0 is not None else {}), parts)
    try:
        x, stop = run(sp, "b", "x0" if x0 is not None else sp.zero(), scope, (lambda r: m(sp, r)) if m else None)
        return sp.vector(x), stop.info() | ({"grid": sp.grid} if sp.grid else {})
    finally:
        sp.close()


def _solve_blocks(a: SparseMatrix, entries: int, b: DataFrame, x0: DataFrame | None, scope: dict, parts: int | None, m: Callable | None) -> tuple[DataFrame, dict]:
    def in_driver(x: DataFrame | None) -> np.ndarray:
        out = np.zeros(a.shape[0])
        if x is not None:
            got = x.toDF("i", "x").where("x is not null").select(F.col("i").cast("long"), F.col("x").cast("double")).toArrow()
            out[got["i"].to_numpy()] = got["x"].to_numpy()
        return out

    shared_root(a.df.sparkSession)
    sp = BlockSpace.of(a, entries, parts)
    try:
        with np.errstate(all="ignore"):
            x, stop = run(sp, in_driver(b), in_driver(x0), scope, (lambda r: m(sp, r)) if m else None)
        return solution(a.df.sparkSession, x, sp.blocks.parts), stop.info() | ({"grid": sp.grid} if sp.grid else {})
    finally:
        sp.close()


def solve_transpose(a: SparseMatrix, g: DataFrame, config: dict | None = None, **options: Any) -> tuple[DataFrame, dict[str, Any]]:
    """A^T y = g; a matrix marked symmetric is taken as it is."""
    return solve(a if a.meta.symmetric else transpose(a), g, None, config, **options)


def solve_vjp(a: SparseMatrix, x: DataFrame, g: DataFrame, config: dict | None = None, **options: Any) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gradients of a loss with dL/dx = g: (by b, by A on its pattern, by x0, which is zero)."""
    adjoint, _ = solve_transpose(a, g, config, **options)
    return adjoint, sddmm(a, adjoint, x), adjoint.select("i", F.lit(0.0).alias("x"))


def parameter_gradient(grad_a: DataFrame, da: DataFrame) -> DataFrame:
    """dL/dtheta: the gradient by A against (r, c, d) of dA/dtheta."""
    return grad_a.join(da, ["r", "c"]).agg(F.coalesce(F.sum(F.col("v") * F.col("d")), F.lit(0.0)).alias("gradient"))


def make_preconditioner(a: SparseMatrix, config: dict | None = None, *, block_dim: int = 1, **options: Any) -> Callable[[DataFrame], DataFrame]:
    """A function from a residual (i, x) to a correction (i, x): one multigrid cycle unless configured otherwise."""
    scope = json.loads(cfg.prepare_preconditioner(config, block_dim=block_dim, **options))["solver"]
    n = a.shape[0]
    shared_root(a.df.sparkSession)
    left = a.df.withColumn("batch", F.lit(0).cast("long")).checkpoint()
    if n > LOCAL_ROWS or left.count() > LOCAL_ENTRIES:
        raise ValueError(f"a preconditioner of its own runs in one task, for at most {LOCAL_ENTRIES} entries and {LOCAL_ROWS} rows; name it in the configuration of solve instead")

    def task(key, rows: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        sp, right = LocalSpace(n, rows["r"], rows["c"], rows["v"]), np.zeros(n)
        right[r["i"].to_numpy()] = r["x"]
        m = _preconditioner(sp, scope, {"block_dim": block_dim})
        return pd.DataFrame({"i": np.arange(n), "x": m(right) if m else right})

    return lambda r: left.groupBy("batch").cogroup(r.toDF("i", "x").withColumn("batch", F.lit(0).cast("long")).groupBy("batch")).applyInPandas(task, "i long, x double")


def as_operator(preconditioner: Callable[[DataFrame], DataFrame], n: int):
    """A preconditioner as an operator tree's opaque node, one vector at a time."""
    from ..plans.linop import Input, Opaque

    def apply(x: DataFrame) -> DataFrame:
        out = None
        for row in x.select("batch").distinct().collect():  # a handful of vectors
            part = preconditioner(x.where(F.col("batch") == row.batch).select("i", "x")).select(F.lit(row.batch).alias("batch"), "i", "x")
            out = part if out is None else out.unionByName(part)
        return out

    return Opaque(Input(n), n, apply)


def gradient_descent(step: Callable[[Any], tuple[float, Any]], start: Any, rate: float, most: int, small: float, norm: Callable[[Any], float]) -> list[tuple[float, float, Any]]:
    """A driver loop of (loss, gradient norm, parameters); ``step`` gives loss and gradient."""
    out, theta = [], start
    for _ in range(most):
        loss, g = step(theta)
        out.append((loss, norm(g), theta))
        if norm(g) < small:
            break
        theta = theta - rate * g
    return out
