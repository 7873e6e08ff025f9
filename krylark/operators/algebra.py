"""Sparse algebra as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SparseMatrix, matrix

#: A vector is broadcast up to so many rows (16 bytes each, known from the matrix's shape).
BROADCAST_ROWS = 500_000


def _side(x: DataFrame, n: int) -> DataFrame:
    return F.broadcast(x) if n <= BROADCAST_ROWS else x


def spmv(a: SparseMatrix, x: DataFrame, fill: bool = True) -> DataFrame:
    """A x; with ``fill`` a row without entries gives zero instead of vanishing."""
    out = a.df.join(_side(x.toDF("i", "x"), a.shape[1]), F.col("c") == F.col("i")).groupBy("r").agg(F.sum(F.col("v") * F.col("x")).alias("x")).toDF("i", "x")
    if not fill:
        return out
    return a.df.sparkSession.range(a.shape[0]).toDF("i").join(out, "i", "left").select("i", F.coalesce("x", F.lit(0.0)).alias("x"))


def transpose(a: SparseMatrix) -> SparseMatrix:
    n, m = a.shape
    return SparseMatrix(a.df.select(F.col("c").alias("r"), F.col("r").alias("c"), "v"), a.with_meta(n_rows=m, n_cols=n).meta)


def spgemm(a: SparseMatrix, b: SparseMatrix) -> SparseMatrix:
    """A B: a join on the inner index and a sum; partial sums are taken before the shuffle."""
    if a.shape[1] != b.shape[0]:
        raise ValueError(f"shapes {a.shape} and {b.shape} do not fit")
    right = b.df.toDF("k", "c2", "w")
    df = a.df.join(right, F.col("c") == F.col("k")).groupBy("r", "c2").agg(F.sum(F.col("v") * F.col("w")).alias("v")).toDF("r", "c", "v")
    return matrix(df, a.shape[0], b.shape[1])


def add(a: SparseMatrix, b: SparseMatrix, alpha: float = 1.0, beta: float = 1.0) -> SparseMatrix:
    df = a.df.select("r", "c", (F.col("v") * alpha).alias("v")).unionByName(b.df.select("r", "c", (F.col("v") * beta).alias("v")))
    return matrix(df.groupBy("r", "c").agg(F.sum("v").alias("v")), *a.shape)


def diagonal(a: SparseMatrix) -> DataFrame:
    return a.df.where("r = c").groupBy("r").agg(F.sum("v").alias("x")).toDF("i", "x")


def row_sums(a: SparseMatrix) -> DataFrame:
    """(i, x, a): sums and absolute sums of the rows that have entries."""
    return a.df.groupBy("r").agg(F.sum("v").alias("x"), F.sum(F.abs("v")).alias("a")).withColumnRenamed("r", "i")


def l1_diagonal(a: SparseMatrix) -> DataFrame:
    """a_ii plus the absolute values beside it, the diagonal of l1-Jacobi."""
    return a.df.groupBy("r").agg(F.sum(F.when(F.col("r") == F.col("c"), F.col("v")).otherwise(F.abs("v"))).alias("x")).toDF("i", "x")


def gershgorin(a: SparseMatrix) -> DataFrame:
    """One row (lo, hi) that bounds the spectrum of a symmetric matrix."""
    discs = a.df.groupBy("r").agg(F.sum(F.when(F.col("r") == F.col("c"), F.col("v")).otherwise(0.0)).alias("d"), F.sum(F.when(F.col("r") != F.col("c"), F.abs("v")).otherwise(0.0)).alias("o"))
    return discs.agg(F.min(F.col("d") - F.col("o")).alias("lo"), F.max(F.col("d") + F.col("o")).alias("hi"))


def dots(pairs: DataFrame, *columns: tuple[str, str]) -> list[float]:
    """Several inner products of columns of one table in one action."""
    row = pairs.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"d{k}") for k, (a, b) in enumerate(columns)]).first()
    return [x or 0.0 for x in row]


def sddmm(a: SparseMatrix, left: DataFrame, right: DataFrame, scale: float = -1.0) -> DataFrame:
    """scale * left[r] * right[c] on the pattern of A."""
    l, r = _side(left.toDF("li", "lx"), a.shape[0]), _side(right.toDF("ri", "rx"), a.shape[1])
    return a.df.join(l, F.col("r") == F.col("li")).join(r, F.col("c") == F.col("ri")).select("r", "c", (scale * F.col("lx") * F.col("rx")).alias("v"))


def structure_hash(a: SparseMatrix) -> tuple:
    """A key of the pattern: it changes with the places of entries and not with their values or order."""
    h = F.xxhash64("r", "c")
    row = a.df.agg(F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s"), F.count("*").alias("n")).first()
    return (*a.shape, *row)


def block_diagonal_inverse(a: SparseMatrix, k: int) -> DataFrame:
    """(br, blk): inverses of the diagonal blocks, row-major, in Arrow batches."""
    import numpy as np
    import pyarrow as pa

    from ..functions.formats import to_bsr

    def run(batches):
        for b in batches:
            if b.num_rows:
                blocks = np.array(b.column(1).to_pylist(), float).reshape(-1, k, k)
                inverse = np.linalg.inv(blocks).reshape(-1, k * k)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(inverse.tolist(), pa.list_(pa.float64()))], names=["br", "blk"])

    return to_bsr(a, k).where("br = bc").select("br", "blk").mapInArrow(run, "br long, blk array<double>")
