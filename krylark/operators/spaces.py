"""Where a solver's vectors live.

A method is written once over a small set of operations: linear combinations, batches of inner products, products
with A, and products with a pointwise weight.  ``LocalSpace`` runs them in numpy inside one task, for systems whose
number of entries is counted and small.  ``TableSpace`` keeps all vectors of an iteration as columns of one table,
dealt by row: combinations are projections, inner products share one aggregation, and a product with A is one
shuffle, after which the table is checkpointed.  ``BlockSpace`` (``blocks.py``) is between them.  A coloring, a coarse set and other matrices on the same rows are
operations of both spaces too.
"""

from __future__ import annotations

import itertools
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SparseMatrix
from ..storage import shared_root


class LocalSpace:
    """Vectors are numpy arrays; the matrix is held as sorted coordinates."""

    def __init__(self, n: int, r, c, v):
        r, c, v = np.asarray(r, np.int64), np.asarray(c, np.int64), np.asarray(v, float)
        order = np.lexsort((c, r))
        self.n, self.r, self.c, self.v = n, r[order], c[order], v[order]
        self.indptr = np.searchsorted(self.r, np.arange(n + 1))
        #: What was worked out from the pattern alone; a later system with the same pattern may bring it along.
        self.kept: dict = {}
        #: (level, rows, entries) of the multigrid that runs here.
        self.grid: list[tuple[int, int, int]] | None = None

    def once(self, name: str, make: Callable):
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    def transposed(self) -> LocalSpace:
        return LocalSpace(self.n, self.c, self.r, self.v)

    def mul(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.r, self.v * x[self.c], self.n)

    def lin(self, *terms: tuple[float, np.ndarray]) -> np.ndarray:
        out = terms[0][0] * terms[0][1]
        for k, x in terms[1:]:
            out = out + k * x
        return out

    def dots(self, *pairs: tuple[np.ndarray, np.ndarray]) -> list[float]:
        return [float(a @ b) for a, b in pairs]

    def times(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return w * x

    def zero(self) -> np.ndarray:
        return np.zeros(self.n)

    def random(self, seed: int) -> np.ndarray:
        return np.random.default_rng(seed).standard_normal(self.n)

    def forget(self, *vectors) -> None:
        pass

    def diagonal(self) -> np.ndarray:
        on = self.r == self.c
        return np.bincount(self.r[on], self.v[on], self.n)

    def l1_diagonal(self) -> np.ndarray:
        return np.bincount(self.r, np.where(self.r == self.c, self.v, np.abs(self.v)), self.n)

    def abs_row_sums(self) -> np.ndarray:
        return np.bincount(self.r, np.abs(self.v), self.n)

    def inverse(self, w: np.ndarray) -> np.ndarray:
        return np.divide(1.0, w, out=np.zeros_like(w), where=w != 0)

    def largest(self, w: np.ndarray) -> float:
        return float(w.max()) if len(w) else 0.0

    def colors(self) -> tuple[np.ndarray, int]:
        """The color of each row, and how many there are."""
        from .krylov import colors_of

        color = self.once("colors", lambda: colors_of(self.n, self.r, self.c))
        return color, int(color.max()) + 1 if len(color) else 0

    def only(self, color: np.ndarray, k: int, x: np.ndarray) -> np.ndarray:
        """x on the rows of a color, zero elsewhere."""
        return np.where(color == k, x, 0.0)

    def before(self, color: np.ndarray, k: int, x: np.ndarray) -> np.ndarray:
        """x on the rows of earlier colors, zero elsewhere."""
        return np.where(color < k, x, 0.0)

    def mirrored(self) -> LocalSpace:
        """The matrix of a_ij a_ji off the diagonal."""
        key = self.r * self.n + self.c
        at = np.searchsorted(key, self.c * self.n + self.r)
        at = np.minimum(at, len(key) - 1) if len(key) else at
        found = (key[at] == self.c * self.n + self.r) & (self.r != self.c) if len(key) else np.zeros(0, bool)
        return LocalSpace(self.n, self.r[found], self.c[found], self.v[found] * self.v[at[found]])

    def product(self, m: LocalSpace, x: np.ndarray) -> np.ndarray:
        return m.mul(x)

    def mul_on(self, color: np.ndarray, k: int, x: np.ndarray) -> np.ndarray:
        """A product with A of which only the rows of a color are used."""
        return self.mul(x)

    def product_on(self, m: LocalSpace, color: np.ndarray, k: int, x: np.ndarray) -> np.ndarray:
        return m.mul(x)

    def coarse_rows(self, threshold: float) -> np.ndarray:
        """One on the rows of a maximal independent set of the strength graph."""
        from .amg import pmis, strength

        return pmis(self.n, *strength(self, threshold)).astype(float)

    def block_inverse(self, k: int) -> LocalSpace:
        """The matrix of the inverted k by k blocks on the diagonal."""
        on = self.r // k == self.c // k
        blocks = np.zeros((self.n // k, k, k))
        np.add.at(blocks, (self.r[on] // k, self.r[on] % k, self.c[on] % k), self.v[on])
        b, i, j = np.indices(blocks.shape).reshape(3, -1)
        return LocalSpace(self.n, b * k + i, b * k + j, np.linalg.inv(blocks).ravel())

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        np.add.at(out, (self.r, self.c), self.v)
        return out


@contextmanager
def fixed_plan(spark: SparkSession, parts: int) -> Iterator[None]:
    """Plans made inside keep their partitioning: an adaptive plan would not tell how its checkpoint is dealt, and every
    product would shuffle the vectors again."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Vec(str):
    """The name of a vector's column; the column goes once nothing refers to the name any more."""


class TableSpace:
    """Vectors are names of columns of ``self.table``, which is dealt by ``i`` and checkpointed at every product with A.

    ``index``: the names of the rows, (i); 0 to n - 1 unless given.
    """

    def __init__(self, a: SparseMatrix, columns: dict[str, DataFrame] | None = None, parts: int | None = None, index: DataFrame | None = None):
        self.spark: SparkSession = a.df.sparkSession
        self.n = a.shape[0]
        self.parts = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shared_root(self.spark)
        self._persisted: list[DataFrame] = []
        self.children: list[TableSpace] = []  # coarser spaces, closed with this one
        self.grid: list[tuple[int, int, int]] | None = None
        self.a = self.dealt(a.df)
        table = self.spark.range(self.n).toDF("i") if index is None else index
        for name, x in (columns or {}).items():
            table = table.join(x.toDF("i", name), "i", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
        self._names = (f"w{k}" for k in itertools.count())
        self._dead: set[str] = set()
        self.table = self._kept(table.repartition(self.parts, "i"))

    def dealt(self, m: DataFrame, by: str = "c") -> DataFrame:
        """A matrix dealt by column and kept until the space is closed."""
        with fixed_plan(self.spark, self.parts):
            out = m.repartition(self.parts, by).persist()
        self._persisted.append(out)
        return out

    def _handle(self, name: str) -> Vec:
        out = Vec(name)
        weakref.finalize(out, self._dead.add, name)
        return out

    def _kept(self, table: DataFrame) -> DataFrame:
        if dead := [c for c in table.columns if c in self._dead]:
            table = table.drop(*dead)
        with fixed_plan(self.spark, self.parts):
            return table.checkpoint()

    def _put(self, expression) -> str:
        name = next(self._names)
        self.table = self.table.withColumn(name, expression)
        return self._handle(name)

    def put(self, x: DataFrame, otherwise: float = 0.0) -> str:
        """(i, value) as a vector; rows that it lacks get ``otherwise``."""
        name = next(self._names)
        self.table = self._kept(self.table.join(x.toDF("i", name), "i", "left").withColumn(name, F.coalesce(name, F.lit(otherwise))))
        return self._handle(name)

    def product(self, m: DataFrame, x: str) -> str:
        """A vector of sums of v x over the rows of (r, c, v), dealt by column."""
        side = self.table.select(F.col("i").alias("j"), F.col(x).alias("xj"))
        return self.put(m.join(side, F.col("c") == F.col("j")).groupBy("r").agg(F.sum(F.col("v") * F.col("xj"))))

    def mul(self, x: str) -> str:
        return self.product(self.a, x)

    def mul_on(self, color: str, k: int, x: str) -> str:
        return self.mul(x)

    def product_on(self, m: DataFrame, color: str, k: int, x: str) -> str:
        return self.product(m, x)

    def lin(self, *terms: tuple[float, str]) -> str:
        return self._put(sum((F.lit(float(k)) * F.col(x) for k, x in terms[1:]), F.lit(float(terms[0][0])) * F.col(terms[0][1])))

    def dots(self, *pairs: tuple[str, str]) -> list[float]:
        row = self.table.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"d{k}") for k, (a, b) in enumerate(pairs)]).first()
        return [float(x or 0.0) for x in row]

    def times(self, w: str, x: str) -> str:
        return self._put(F.col(w) * F.col(x))

    def zero(self) -> str:
        return self._put(F.lit(0.0))

    def random(self, seed: int) -> str:
        return self._put(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 52)) / float(1 << 51) - 1.0)

    def forget(self, *vectors: str) -> None:
        self.table = self.table.drop(*[v for v in vectors if v])

    def _per_row(self, expression) -> str:
        return self.put(self.a.groupBy("r").agg(F.sum(expression)))

    def diagonal(self) -> str:
        return self._per_row(F.when(F.col("r") == F.col("c"), F.col("v")).otherwise(0.0))

    def l1_diagonal(self) -> str:
        return self._per_row(F.when(F.col("r") == F.col("c"), F.col("v")).otherwise(F.abs("v")))

    def abs_row_sums(self) -> str:
        return self._per_row(F.abs("v"))

    def inverse(self, w: str) -> str:
        return self._put(F.when(F.col(w) != 0, 1 / F.nullif(F.col(w), F.lit(0.0))).otherwise(0.0))

    def largest(self, w: str) -> float:
        return float(self.table.agg(F.max(w)).first()[0] or 0.0)

    def colors(self) -> tuple[str, int]:
        """The color of each row, and how many there are: in each round, the open rows whose hash tops their open neighbours' get the next one."""
        edges = self.a.where("r <> c").select("r", "c")
        edges = self.dealt(edges.union(edges.select("c", "r")).distinct())
        color, rank = self._put(F.lit(-1.0)), F.struct(F.xxhash64("i"), F.col("i"))
        k = 0
        while self.table.where(F.col(color) < 0).limit(1).count():
            open_rows = self.table.where(F.col(color) < 0).select(F.col("i").alias("j"), rank.alias("rank"))
            top = edges.join(open_rows, F.col("c") == F.col("j")).groupBy(F.col("r").alias("i")).agg(F.max("rank").alias("top"))
            name = next(self._names)
            wins = (F.col(color) < 0) & (F.col("top").isNull() | (rank > F.col("top")))
            self.table = self._kept(self.table.join(top, "i", "left").withColumn(name, F.when(wins, F.lit(float(k))).otherwise(F.col(color))).drop("top"))
            color, k = self._handle(name), k + 1
        return color, k

    def only(self, color: str, k: int, x: str) -> str:
        return self._put(F.when(F.col(color) == k, F.col(x)).otherwise(0.0))

    def before(self, color: str, k: int, x: str) -> str:
        return self._put(F.when(F.col(color) < k, F.col(x)).otherwise(0.0))

    def mirrored(self) -> DataFrame:
        other = self.a.select(F.col("c").alias("r"), F.col("r").alias("c"), F.col("v").alias("w"))
        return self.dealt(self.a.where("r <> c").join(other, ["r", "c"]).select("r", "c", (F.col("v") * F.col("w")).alias("v")))

    def coarse_rows(self, threshold: float) -> str:
        from .amg import table_coarse_rows

        strong = self.dealt(strong_entries(self.a, threshold).select("r", "c"), "r")
        return self.put(table_coarse_rows(self, strong).select("i", F.col("coarse").cast("double")))

    def block_inverse(self, k: int) -> DataFrame:
        import pyarrow as pa

        def run(batches):
            for b in batches:
                n = b.num_rows
                lists = b.column(1)
                entry = lists.flatten()
                at = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
                blocks = np.zeros((n, k, k))
                np.add.at(blocks, (at, *(entry.field(f).to_numpy(zero_copy_only=False) for f in ("i", "j"))), entry.field("v").to_numpy(zero_copy_only=False))
                at, i, j = np.indices(blocks.shape).reshape(3, -1)
                first = b.column(0).to_numpy()[at] * k
                yield pa.RecordBatch.from_arrays([pa.array(first + i), pa.array(first + j), pa.array(np.linalg.inv(blocks).ravel())], names=["r", "c", "v"])

        on = self.a.where(F.expr(f"r div {k} = c div {k}"))
        lists = on.groupBy(F.expr(f"r div {k}").alias("b")).agg(F.collect_list(F.struct((F.col("r") % k).alias("i"), (F.col("c") % k).alias("j"), "v")).alias("e"))  # k * k entries at most
        return self.dealt(lists.mapInArrow(run, "r long, c long, v double"))

    def vector(self, x: str) -> DataFrame:
        return self.table.select("i", F.col(x).alias("x"))

    def close(self) -> None:
        for child in self.children:
            child.close()
        for df in self._persisted:
            df.unpersist()


def strong_entries(a: DataFrame, threshold: float) -> DataFrame:
    """The strong connections: -a_ij is at least ``threshold`` of the row's largest."""
    top = a.where("r <> c").groupBy("r").agg(F.max(-F.col("v")).alias("top"))
    return a.where("r <> c").join(top, "r").where((F.col("top") > 0) & (-F.col("v") >= threshold * F.col("top"))).select("r", "c", "v")
