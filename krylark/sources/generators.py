"""Matrices and right-hand sides made from ``spark.range``: no driver loop, one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SparseMatrix, matrix, vector


def _stencil(df: DataFrame, arms: list[tuple[Column, Column, Column]]) -> DataFrame:
    """Rows of a stencil: per arm (is it inside, offset of the column, value)."""
    cells = F.array(*[F.struct(inside.alias("inside"), (F.col("id") + shift).alias("c"), value.cast("double").alias("v")) for inside, shift, value in arms])
    return df.select(F.col("id").alias("r"), F.explode(cells).alias("e")).where("e.inside").select("r", "e.c", "e.v")


def part_bounds(n: int, part: int, parts: int) -> tuple[int, int]:
    """(first row, row after the last) of a contiguous part; the first n mod parts parts have one row more."""
    if not 0 <= part < parts:
        raise ValueError(f"part {part} of {parts}")
    size, extra = divmod(n, parts)
    start = part * size + min(part, extra)
    return start, start + size + (part < extra)


def _part(rows: DataFrame, start: int, stop: int) -> tuple[DataFrame, int, int]:
    """Rows numbered from the part's first, with global columns, and the part's bounds."""
    return rows.select((F.col("r") - start).cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("v")), start, stop


def _tridiagonal_rows(ids: DataFrame, n: int, diagonal_value: float) -> DataFrame:
    i = F.col("id")
    return _stencil(ids, [(i > 0, F.lit(-1), F.lit(-1.0)), (F.lit(True), F.lit(0), F.lit(float(diagonal_value))), (i < n - 1, F.lit(1), F.lit(-1.0))])


def tridiagonal_matrix(spark: SparkSession, n: int, diagonal_value: float = 2.0) -> SparseMatrix:
    """[-1, d, -1]; 3n - 2 entries."""
    return matrix(_tridiagonal_rows(spark.range(n), n, diagonal_value), n, symmetric=True)


def tridiagonal_part(spark: SparkSession, n: int, part: int, parts: int, diagonal_value: float = 2.0) -> tuple[DataFrame, int, int]:
    """A part of it, made by itself: (its rows, first row, row after the last)."""
    start, stop = part_bounds(n, part, parts)
    return _part(_tridiagonal_rows(spark.range(start, stop), n, diagonal_value), start, stop)


def _poisson_rows(ids: DataFrame, nx: int, ny: int, skew: float) -> DataFrame:
    x, y = F.col("id") % nx, F.floor(F.col("id") / nx)
    lo, hi = F.lit(-1 - skew / 2), F.lit(-1 + skew / 2)
    return _stencil(ids, [(y > 0, F.lit(-nx), lo), (x > 0, F.lit(-1), lo), (F.lit(True), F.lit(0), F.lit(4.0)), (x < nx - 1, F.lit(1), hi), (y < ny - 1, F.lit(nx), hi)])


def poisson_rect_matrix(spark: SparkSession, nx: int, ny: int, skew: float = 0.0) -> SparseMatrix:
    """Five-point stencil on an nx by ny grid, x fastest; left and top -1 - s/2, right and bottom -1 + s/2."""
    return matrix(_poisson_rows(spark.range(nx * ny), nx, ny, skew), nx * ny, symmetric=skew == 0)


def poisson_rect_part(spark: SparkSession, nx: int, ny: int, part: int, parts: int, skew: float = 0.0) -> tuple[DataFrame, int, int]:
    """A part of it, made by itself: (its rows, first row, row after the last)."""
    start, stop = part_bounds(nx * ny, part, parts)
    return _part(_poisson_rows(spark.range(start, stop), nx, ny, skew), start, stop)


def poisson_matrix(spark: SparkSession, n: int, skew: float = 0.0) -> SparseMatrix:
    """Five-point stencil on an n by n grid; 5n^2 - 4n entries."""
    return poisson_rect_matrix(spark, n, n, skew)


def poisson3d_matrix(spark: SparkSession, n: int, skew: float = 0.0) -> SparseMatrix:
    """Seven-point stencil, diagonal 6, index i n^2 + j n + k; 7n^3 - 6n^2 entries."""
    k, j, i = F.col("id") % n, F.floor(F.col("id") / n) % n, F.floor(F.col("id") / (n * n))
    lo, hi = F.lit(-1 - skew / 2), F.lit(-1 + skew / 2)
    arms = [(F.lit(True), F.lit(0), F.lit(6.0))]
    for place, step in ((i, n * n), (j, n), (k, 1)):
        arms += [(place > 0, F.lit(-step), lo), (place < n - 1, F.lit(step), hi)]
    return matrix(_stencil(spark.range(n**3), arms), n**3, symmetric=skew == 0)


def convection_diffusion_matrix_2d(spark: SparkSession, n: int, epsilon: float = 1.0, theta: float = 0.0, velocity: float = 100.0) -> SparseMatrix:
    """-eps laplace(u) + v . grad(u): central diffusion, first-order upwind convection, h = 1 / (n - 1), x along the fast index."""
    import math

    h = 1.0 / (n - 1)
    vx, vy = velocity * math.cos(theta), velocity * math.sin(theta)
    d = epsilon / (h * h)
    west, east = -d - max(vx, 0.0) / h, -d + min(vx, 0.0) / h
    north, south = -d - max(vy, 0.0) / h, -d + min(vy, 0.0) / h
    x, y = F.col("id") % n, F.floor(F.col("id") / n)
    centre = 4 * d + abs(vx) / h + abs(vy) / h
    arms = [(y > 0, F.lit(-n), F.lit(north)), (x > 0, F.lit(-1), F.lit(west)), (F.lit(True), F.lit(0), F.lit(centre)), (x < n - 1, F.lit(1), F.lit(east)), (y < n - 1, F.lit(n), F.lit(south))]
    return matrix(_stencil(spark.range(n * n), arms), n * n)


def _uniform(*keys) -> Column:
    """A number in (0, 1) from a hash of the keys: the same on any partitioning."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _random_rows(ids: DataFrame, n: int, density: float, seed: int) -> DataFrame:
    per_row = max(1, round(density * n))
    drawn = ids.select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("k"))
    drawn = drawn.select("r", F.pmod(F.xxhash64("r", "k", F.lit(seed)), F.lit(n)).alias("c"), _uniform("r", "k", F.lit(seed + 1)).alias("v"))
    off = drawn.where("r <> c").groupBy("r", "c").agg(F.max("v").alias("v"))
    sums = off.groupBy("r").agg(F.sum(F.abs("v")).alias("s"))
    diag = ids.withColumnRenamed("id", "r").join(sums, "r", "left").select("r", F.col("r").alias("c"), (F.coalesce("s", F.lit(0.0)) + 1).alias("v"))
    return off.unionByName(diag)


def random_matrix(spark: SparkSession, n: int, density: float = 0.01, seed: int = 0) -> SparseMatrix:
    """Uniform values at hashed places, then every diagonal entry is the sum of its row's absolute values plus one."""
    return matrix(_random_rows(spark.range(n), n, density, seed), n)


def random_part(spark: SparkSession, n: int, part: int, parts: int, density: float = 0.01, seed: int = 0) -> tuple[DataFrame, int, int]:
    """A part of it, made by itself and the same however many parts there are: (its rows, first row, row after the last)."""
    start, stop = part_bounds(n, part, parts)
    return _part(_random_rows(spark.range(start, stop), n, density, seed), start, stop)


def kron(p: SparseMatrix, m: SparseMatrix) -> SparseMatrix:
    """Kronecker product, node-major: row r k + a.  ``m`` is the small factor of coupled systems and is broadcast."""
    k, l = m.shape
    if k * l > 4096:
        raise ValueError("the right factor of kron is broadcast and must have at most 4096 places")
    right = F.broadcast(m.df.toDF("a", "b", "w"))
    df = p.df.crossJoin(right).select((F.col("r") * k + F.col("a")).alias("r"), (F.col("c") * l + F.col("b")).alias("c"), (F.col("v") * F.col("w")).alias("v"))
    return matrix(df, p.shape[0] * k, p.shape[1] * l, block_dim=k)


def rhs_ones(spark: SparkSession, n: int) -> DataFrame:
    return vector(spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("x")))


def rhs_linear(spark: SparkSession, n: int) -> DataFrame:
    """linspace(0, 1, n)."""
    return vector(spark.range(n).select(F.col("id").alias("i"), (F.col("id") / F.lit(float(max(n - 1, 1)))).alias("x")))


def rhs_random(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Standard normal numbers by Box-Muller on hashes of the index."""
    import math

    u, v = _uniform("id", F.lit(seed)), _uniform("id", F.lit(seed + 7919))
    return vector(spark.range(n).select(F.col("id").alias("i"), (F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)).alias("x")))
