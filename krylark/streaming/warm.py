"""Repeated solves over a stream of right-hand sides, each started from the solution before it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SparseMatrix
from ..operators.solve import solve


def warm_solves(a: SparseMatrix, updates: DataFrame, sink: Any, config: dict | None = None, **options: Any):
    """A streaming query: each micro-batch of (i, x) changes is added to the right-hand side, and ``sink(x, info, epoch)``
    gets the new solution.  The state at the driver is the two last tables, not their rows."""
    n = a.shape[0]
    state: dict[str, DataFrame | None] = {"b": a.df.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(0.0).alias("x")), "x": None}

    def each(batch: DataFrame, epoch: int) -> None:
        b = state["b"].unionByName(batch.select(F.col("i").cast("long"), F.col("x").cast("double"))).groupBy("i").agg(F.sum("x").alias("x"))
        b = b.checkpoint() if a.df.sparkSession.sparkContext.getCheckpointDir() else b.persist()
        x, info = solve(a, b, state["x"], config, **options)
        state["b"], state["x"] = b, x
        sink(x, info, epoch)

    return updates.writeStream.foreachBatch(each).outputMode("append")
