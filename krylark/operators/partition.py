"""Contiguous row partitions and what they exchange, as columns of one relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SparseMatrix


def owner(i: Column, n: int, parts: int) -> Column:
    """The part that owns row i: the first n mod parts parts have one row more.  Closed form, no range join."""
    size, extra = divmod(n, parts)
    cut = extra * (size + 1)
    tail = F.lit(extra) + F.floor((i - cut) / max(size, 1))
    return F.when(i < cut, F.floor(i / (size + 1))).otherwise(tail).cast("int")


def partition_info(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """(pid, row_start, row_end) of every part."""
    size, extra = divmod(n, parts)
    p = F.col("id")
    start = p * size + F.least(p, F.lit(extra))
    return spark.range(parts).select(p.cast("int").alias("pid"), start.alias("row_start"), (start + size + F.when(p < extra, 1).otherwise(0)).alias("row_end"))


def with_owner(a: SparseMatrix, parts: int, deal: bool = False) -> DataFrame:
    """(pid, r, c, v); with ``deal`` the rows of a part lie together."""
    df = a.df.withColumn("pid", owner(F.col("r"), a.shape[0], parts)).select("pid", "r", "c", "v")
    return df.repartition(parts, "pid") if deal else df


def partition_rows(a: SparseMatrix, part: int, parts: int) -> DataFrame:
    """A part's rows with local row numbers and global columns."""
    size, extra = divmod(a.shape[0], parts)
    start = part * size + min(part, extra)
    stop = start + size + (part < extra)
    return a.df.where((F.col("r") >= start) & (F.col("r") < stop)).select((F.col("r") - start).alias("r"), "c", "v")


def partition_vector(x: DataFrame, n: int, part: int, parts: int) -> DataFrame:
    size, extra = divmod(n, parts)
    start = part * size + min(part, extra)
    return x.where((F.col("i") >= start) & (F.col("i") < start + size + (part < extra)))


def halo_columns(a: SparseMatrix, parts: int) -> DataFrame:
    """(pid, c, owner): the columns that a part reads and another part owns."""
    need = with_owner(a, parts).select("pid", "c").distinct()
    return need.withColumn("owner", owner(F.col("c"), a.shape[1], parts)).where("owner <> pid")


def halo_gather(a: SparseMatrix, x: DataFrame, parts: int) -> DataFrame:
    """(pid, c, x): the remote values each part needs, and no others."""
    return halo_columns(a, parts).join(x.toDF("i", "x"), F.col("c") == F.col("i")).select("pid", "c", "x")


def halo_plan(a: SparseMatrix, parts: int) -> DataFrame:
    """(owner, pid, n): how many values each part sends to each other."""
    return halo_columns(a, parts).groupBy("owner", "pid").agg(F.count("*").alias("n"))


def transpose_nnz(a: SparseMatrix, parts: int) -> DataFrame:
    """(pid, nnz) of the transposed matrix's parts."""
    return a.df.groupBy(owner(F.col("c"), a.shape[1], parts).alias("pid")).agg(F.count("*").alias("nnz"))


def validate_partition(local: DataFrame, n_global: int, row_start: int, row_end: int) -> DataFrame:
    """One row of findings about a part's rows: are its local rows and its columns in range?"""
    rows = row_end - row_start
    return local.agg(
        F.count("*").alias("nnz"),
        F.coalesce(F.min("r") >= 0, F.lit(True)).alias("rows_from_zero"),
        F.coalesce(F.max("r") < rows, F.lit(True)).alias("rows_in_range"),
        F.coalesce((F.min("c") >= 0) & (F.max("c") < n_global), F.lit(True)).alias("columns_in_range"),
    )


def gather_vector(x: DataFrame) -> list[float]:
    """All values at the driver, in order: the one sink that is meant to collect."""
    return [r.x for r in x.orderBy("i").select("x").collect()]


def allgather(x: DataFrame, n: int) -> DataFrame:
    """The whole vector beside every part: broadcast while its counted length allows it, else left to the join."""
    from .algebra import _side

    return _side(x, n)


def allgather_adjoint(g: DataFrame, n: int, part: int, parts: int) -> DataFrame:
    """What flows back to a part: its own slice."""
    return partition_vector(g, n, part, parts)


def partition_operator(op, part: int, parts: int):
    """The rows of a part of an operator tree: global inputs, local outputs."""
    from ..plans.linop import Move

    size, extra = divmod(op.n, parts)
    start = part * size + min(part, extra)
    return Move(op, size + (part < extra), lambda o: o + start)


def prepare(a: SparseMatrix, parts: int) -> dict:
    """What repeated distributed solves need of a matrix, computed once: its dealt rows, halo plan and entry counts."""
    rows = with_owner(a, parts, deal=True).persist()
    return {"rows": rows, "halo": halo_plan(a, parts).persist(), "nnz": rows.groupBy("pid").agg(F.count("*").alias("nnz")).persist(), "transpose_nnz": transpose_nnz(a, parts).persist()}
