"""Format normalization and conversion between the relation (r, c, v) and compressed forms."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import SparseMatrix, matrix


def preferred_dtype(*schemas: str) -> str:
    """``double`` if any side is; integers and booleans count as ``float``."""
    return "double" if any(s == "double" for s in schemas) else "float"


def deep_merge(base: dict, override: dict) -> dict:
    """``base`` with ``override`` laid over it, dictionaries merged key by key; neither is changed."""
    out = dict(base)
    for key, value in override.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def to_matrix(spark: SparkSession, a: Any, shape: tuple[int, int] | None = None) -> SparseMatrix:
    """Any supported form of a matrix as the relation: a SparseMatrix, a DataFrame (r, c, v) with ``shape``, a dense
    list of lists or two-dimensional array, or a (data, indices, indptr) triple with ``shape``."""
    import numpy as np

    if isinstance(a, SparseMatrix):
        return a
    if isinstance(a, DataFrame):
        if "batch" in a.columns:
            raise ValueError("a batched matrix has no single form; solve it by batch")
        if shape is None:
            raise ValueError("a DataFrame needs its shape: empty rows cannot be seen in it")
        return matrix(sum_duplicates(a), *shape)
    if isinstance(a, tuple) and len(a) == 3:
        data, indices, indptr = (np.asarray(x) for x in a)
        if shape is None or len(indptr) != shape[0] + 1:
            raise ValueError("a compressed matrix needs a shape that fits its row pointers")
        rows = np.repeat(np.arange(shape[0]), np.diff(indptr))
        return matrix(_coo(spark, rows, indices, data), *shape)
    dense = np.asarray(a, float) if isinstance(a, (list, np.ndarray)) else None
    if dense is None:
        raise TypeError(f"unsupported matrix type {type(a).__name__}")
    if dense.ndim != 2:
        raise ValueError("a dense matrix has two dimensions")
    r, c = np.nonzero(dense)
    return matrix(_coo(spark, r, c, dense[r, c]), *dense.shape)


def _coo(spark: SparkSession, r, c, v) -> DataFrame:
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"r": r, "c": c, "v": v}).astype({"r": "int64", "c": "int64", "v": "float64"}), "r long, c long, v double")


def sum_duplicates(df: DataFrame) -> DataFrame:
    return df.groupBy("r", "c").agg(F.sum("v").alias("v"))


def drop_zeros(df: DataFrame, tol: float = 1e-9) -> DataFrame:
    return df.where(F.abs("v") > tol)


def to_csr_rows(df: DataFrame) -> DataFrame:
    """(r, cols, vals): a row's entries in column order."""
    return df.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("e")).select("r", F.col("e.c").alias("cols"), F.col("e.v").alias("vals"))


def csr_indptr(a: SparseMatrix) -> DataFrame:
    """(r, start, stop) of every row, empty ones too.

    The running sum is taken within blocks of rows and over the blocks' totals, so no task sees all rows.
    """
    block = 1 << 16
    n = a.df.groupBy("r").count()
    rows = a.df.sparkSession.range(a.shape[0]).toDF("r").join(n, "r", "left").select("r", F.coalesce("count", F.lit(0)).alias("n"), F.floor(F.col("r") / block).alias("b"))
    totals = rows.groupBy("b").agg(F.sum("n").alias("t"))
    before = totals.select("b", (F.sum("t").over(Window.orderBy("b")) - F.col("t")).alias("base"))  # a row per 65,536 rows
    within = F.sum("n").over(Window.partitionBy("b").orderBy("r"))
    return rows.withColumn("run", within).join(before, "b").select("r", (F.col("base") + F.col("run") - F.col("n")).alias("start"), (F.col("base") + F.col("run")).alias("stop"))


def expand_csr(rows: DataFrame) -> DataFrame:
    """(r, cols, vals) back to (r, c, v)."""
    return rows.select("r", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("r", F.col("e.cols").alias("c"), F.col("e.vals").alias("v"))


def to_csc_columns(df: DataFrame) -> DataFrame:
    return df.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("e")).select("c", F.col("e.r").alias("rows"), F.col("e.v").alias("vals"))


def to_bsr(a: SparseMatrix, k: int) -> DataFrame:
    """(br, bc, blk): dense k by k blocks, row-major, zero where nothing is stored."""
    if a.shape[0] % k or a.shape[1] % k:
        raise ValueError(f"shape {a.shape} does not divide into blocks of {k}")
    at = (F.col("r") % k * k + F.col("c") % k).cast("int").alias("at")
    cells = a.df.select(F.floor(F.col("r") / k).alias("br"), F.floor(F.col("c") / k).alias("bc"), at, "v")
    cells = cells.groupBy("br", "bc").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    return cells.select("br", "bc", F.expr(f"transform(sequence(0, {k * k - 1}), i -> coalesce(m[i], 0.0D))").alias("blk"))


def from_bsr(blocks: DataFrame, k: int) -> DataFrame:
    cells = blocks.select("br", "bc", F.posexplode("blk").alias("at", "v")).where("v <> 0")
    return cells.select((F.col("br") * k + F.floor(F.col("at") / k)).alias("r"), (F.col("bc") * k + F.col("at") % k).alias("c"), "v")


def block_slots(a: SparseMatrix, k: int) -> DataFrame:
    """(r, c, br, bc, at): the place of every stored entry in its block, to be kept while only values change."""
    return a.df.select("r", "c", F.floor(F.col("r") / k).alias("br"), F.floor(F.col("c") / k).alias("bc"), (F.col("r") % k * k + F.col("c") % k).cast("int").alias("at"))


def refresh_blocks(slots: DataFrame, values: DataFrame, k: int) -> DataFrame:
    """(br, bc, blk) for new values (r, c, v) on kept slots."""
    cells = slots.join(values.select("r", "c", "v"), ["r", "c"]).groupBy("br", "bc").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    return cells.select("br", "bc", F.expr(f"transform(sequence(0, {k * k - 1}), i -> coalesce(m[i], 0.0D))").alias("blk"))


def convert(a: SparseMatrix, form: str, k: int = 1) -> DataFrame:
    """csr, csc, coo, lil, dok or bsr."""
    forms = {"coo": lambda: a.df, "csr": lambda: to_csr_rows(a.df), "lil": lambda: to_csr_rows(a.df), "csc": lambda: to_csc_columns(a.df), "dok": lambda: a.df.select(F.struct("r", "c").alias("key"), "v"), "bsr": lambda: to_bsr(a, k)}
    if form not in forms:
        raise ValueError(f"unknown sparse format {form!r}")
    return forms[form]()
