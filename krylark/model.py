"""The data model: a sparse matrix is a relation ``(r, c, v)``, a vector ``(i, x)``; shape and promises ride beside them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import IntEnum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Status(IntEnum):
    SUCCESS = 0
    FAILED = 1
    DIVERGED = 2
    NOT_CONVERGED = 3


class SolveError(RuntimeError):
    """A solve that failed outright; divergence and missing convergence are statuses, not errors."""


@dataclass(frozen=True)
class MatrixMeta:
    n_rows: int
    n_cols: int
    block_dim: int = 1
    symmetric: bool = False
    dtype: str = "double"
    coloring: Any = field(default=None, compare=False, repr=False)
    setup: Any = field(default=None, compare=False, repr=False)


@dataclass(frozen=True)
class SparseMatrix:
    """``df`` (r long, c long, v double) with one row per stored entry; rows without entries exist through ``meta``."""

    df: DataFrame
    meta: MatrixMeta

    @property
    def shape(self) -> tuple[int, int]:
        return self.meta.n_rows, self.meta.n_cols

    def with_meta(self, **changes: Any) -> SparseMatrix:
        return replace(self, meta=replace(self.meta, **changes))

    def nnz(self) -> int:
        return self.df.count()


def matrix(df: DataFrame, n_rows: int, n_cols: int | None = None, **meta: Any) -> SparseMatrix:
    """Casts (r, c, v) to the canonical types."""
    cast = df.select(F.col("r").cast("long"), F.col("c").cast("long"), F.col("v").cast("double"))
    return SparseMatrix(cast, MatrixMeta(n_rows, n_rows if n_cols is None else n_cols, **meta))


def vector(df: DataFrame) -> DataFrame:
    return df.select(F.col("i").cast("long"), F.col("x").cast("double"))
