"""Linear (and elementwise) operators as expression trees.

A tree is evaluated on a batch of vectors, a relation (batch, i, x) with every index present, and in the boolean
semiring, where it gives its sparsity pattern (o, j): output o depends on input j.  A Python callable cannot be looked
into; it becomes an ``Opaque`` node, whose pattern is a conservative superset, or is probed with unit vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SparseMatrix, matrix
from ..storage import shared_root

MAX_UNROLL = 4096
MAX_EDGES = 50_000_000


class NotTraceable(Exception):
    """The pattern cannot be told from the tree; probe it instead."""


class Op:
    """An operator; ``n`` is the length of its output."""

    n: int

    def pattern(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def apply(self, x: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __add__(self, other: Op) -> Op:
        return Elementwise([self, other], lambda a, b: a + b)

    def __sub__(self, other: Op) -> Op:
        return Elementwise([self, other], lambda a, b: a - b)

    def scaled(self, k: float) -> Op:
        return Elementwise([self], lambda a: F.lit(float(k)) * a) if k else Zero(self.n, self)


@dataclass
class Input(Op):
    n: int

    def pattern(self, spark):
        return spark.range(self.n).select(F.col("id").alias("o"), F.col("id").alias("j"))

    def apply(self, x):
        return x


@dataclass
class Zero(Op):
    n: int
    of: Op

    def pattern(self, spark):
        return spark.range(0).select(F.col("id").alias("o"), F.col("id").alias("j"))

    def apply(self, x):
        return _fill(self.n, x.select("batch").distinct(), x.where("false").select("batch", "i", "x"))


def _fill(n: int, batches: DataFrame, values: DataFrame) -> DataFrame:
    """``values`` with zeros where an index is missing."""
    every = batches.crossJoin(batches.sparkSession.range(n).toDF("i"))  # one row for each value of the result
    return every.join(values, ["batch", "i"], "left").select("batch", "i", F.coalesce("x", F.lit(0.0)).alias("x"))


@dataclass
class Elementwise(Op):
    """A function of the values at the same index: the union of the arguments' dependences."""

    args: list[Op]
    f: Callable[..., Column]

    @property
    def n(self):
        return self.args[0].n

    def pattern(self, spark):
        out = self.args[0].pattern(spark)
        for a in self.args[1:]:
            out = out.unionByName(a.pattern(spark))
        return out.distinct()

    def apply(self, x):
        out = self.args[0].apply(x).withColumnRenamed("x", "x0")
        for k, a in enumerate(self.args[1:], 1):
            out = out.join(a.apply(x).withColumnRenamed("x", f"x{k}"), ["batch", "i"])
        return out.select("batch", "i", self.f(*[F.col(f"x{k}") for k in range(len(self.args))]).alias("x"))


@dataclass
class Weights(Op):
    """Times a constant vector (a function of the index); places where it is zero depend on nothing."""

    arg: Op
    w: Callable[[Column], Column]

    @property
    def n(self):
        return self.arg.n

    def pattern(self, spark):
        return self.arg.pattern(spark).where(self.w(F.col("o")) != 0)

    def apply(self, x):
        return self.arg.apply(x).select("batch", "i", (self.w(F.col("i")).cast("double") * F.col("x")).alias("x"))


@dataclass
class Where(Op):
    """A choice by a static mask: each output depends on the branch it takes."""

    mask: Callable[[Column], Column]
    yes: Op
    no: Op

    @property
    def n(self):
        return self.yes.n

    def pattern(self, spark):
        return self.yes.pattern(spark).where(self.mask(F.col("o"))).unionByName(self.no.pattern(spark).where(~self.mask(F.col("o"))))

    def apply(self, x):
        return self.yes.apply(x).where(self.mask(F.col("i"))).unionByName(self.no.apply(x).where(~self.mask(F.col("i"))))


@dataclass
class Cond(Op):
    """A data-dependent choice between branches: the union of both and of the predicate's inputs."""

    predicate: Op
    yes: Op
    no: Op

    @property
    def n(self):
        return self.yes.n

    def pattern(self, spark):
        inputs = self.predicate.pattern(spark).select("j").distinct()
        if inputs.count() * self.n > MAX_EDGES:
            raise NotTraceable("the predicate reads too much")
        every = spark.range(self.n).toDF("o").crossJoin(F.broadcast(inputs))
        return self.yes.pattern(spark).unionByName(self.no.pattern(spark)).unionByName(every).distinct()

    def apply(self, x):
        test = self.predicate.apply(x).where("i = 0").select("batch", (F.col("x") > 0).alias("t"))
        pick = lambda op, t: op.apply(x).join(test.where(F.col("t") == t).select("batch"), "batch")
        return pick(self.yes, True).unionByName(pick(self.no, False))


@dataclass
class Move(Op):
    """Reshape, slice, transpose, roll, gather ...: output o takes input ``source(o)``, or zero where that is null."""

    arg: Op
    n: int
    source: Callable[[Column], Column]

    def _map(self, spark):
        return spark.range(self.n).select(F.col("id").alias("out"), self.source(F.col("id")).cast("long").alias("src")).where((F.col("src") >= 0) & (F.col("src") < self.arg.n))

    def pattern(self, spark):
        return self.arg.pattern(spark).join(self._map(spark), F.col("o") == F.col("src")).select(F.col("out").alias("o"), "j")

    def apply(self, x):
        moved = self.arg.apply(x).join(self._map(x.sparkSession), F.col("i") == F.col("src")).select("batch", F.col("out").alias("i"), "x")
        return _fill(self.n, x.select("batch").distinct(), moved)


@dataclass
class Concat(Op):
    args: list[Op]

    @property
    def n(self):
        return sum(a.n for a in self.args)

    def _parts(self, get, index):
        at, out = 0, None
        for a in self.args:
            part = get(a).withColumn(index, F.col(index) + at)
            out, at = part if out is None else out.unionByName(part), at + a.n
        return out

    def pattern(self, spark):
        return self._parts(lambda a: a.pattern(spark), "o")

    def apply(self, x):
        return self._parts(lambda a: a.apply(x), "i")


@dataclass
class Reduce(Op):
    """Sums groups of outputs: ``to(i)`` is the group of index i."""

    arg: Op
    n: int
    to: Callable[[Column], Column]

    def pattern(self, spark):
        return self.arg.pattern(spark).select(self.to(F.col("o")).cast("long").alias("o"), "j").distinct()

    def apply(self, x):
        return _fill(self.n, x.select("batch").distinct(), self.arg.apply(x).groupBy("batch", self.to(F.col("i")).cast("long").alias("i")).agg(F.sum("x").alias("x")))


@dataclass
class Scatter(Op):
    """Writes ``updates`` into ``operand`` at ``to(u)``; out-of-range places are dropped.  With ``add`` what is there stays;
    without it the last update of a place wins."""

    operand: Op
    updates: Op
    to: Callable[[Column], Column]
    add: bool = False

    @property
    def n(self):
        return self.operand.n

    def _map(self, spark):
        m = spark.range(self.updates.n).select(F.col("id").alias("u"), self.to(F.col("id")).cast("long").alias("dst")).where((F.col("dst") >= 0) & (F.col("dst") < self.n))
        return m if self.add else m.groupBy("dst").agg(F.max("u").alias("u"))

    def pattern(self, spark):
        new = self.updates.pattern(spark).join(self._map(spark), F.col("o") == F.col("u")).select(F.col("dst").alias("o"), "j")
        old = self.operand.pattern(spark)
        if not self.add:
            old = old.join(self._map(spark).select(F.col("dst").alias("o")), "o", "left_anti")
        return old.unionByName(new).distinct()

    def apply(self, x):
        m = self._map(x.sparkSession)
        new = self.updates.apply(x).join(m, F.col("i") == F.col("u")).select("batch", F.col("dst").alias("i"), "x")
        old = self.operand.apply(x)
        if not self.add:
            old = old.join(m.select(F.col("dst").alias("i")), "i", "left_anti").select("batch", "i", "x")
        return old.unionByName(new).groupBy("batch", "i").agg(F.sum("x").alias("x"))


def update_slice(operand: Op, updates: Op, start: int) -> Op:
    """Replaces a slice; a start that does not fit is moved until it does."""
    at = max(0, min(start, operand.n - updates.n))
    return Scatter(operand, updates, lambda u: u + at)


@dataclass
class Conv(Op):
    """A convolution with constant taps on a grid with zeros outside; taps are (offsets, value) in the grid's axes."""

    arg: Op
    shape: tuple[int, ...]
    taps: list[tuple[tuple[int, ...], float]]

    @property
    def n(self):
        return self.arg.n

    def _edges(self, spark):
        """(out, src, w) of every tap that stays inside."""
        strides, s = [], 1
        for d in reversed(self.shape):
            strides.insert(0, s)
            s *= d
        place = [F.floor(F.col("id") / st) % d for st, d in zip(strides, self.shape)]
        cells = []
        for offset, w in self.taps:
            if w:
                inside = F.lit(True)
                for p, o, d in zip(place, offset, self.shape):
                    inside = inside & (p + o >= 0) & (p + o < d)
                cells.append(F.struct(inside.alias("ok"), (F.col("id") + sum(o * st for o, st in zip(offset, strides))).alias("src"), F.lit(float(w)).alias("w")))
        return spark.range(self.n).select(F.col("id").alias("out"), F.explode(F.array(*cells)).alias("e")).where("e.ok").select("out", "e.src", "e.w")

    def pattern(self, spark):
        return self.arg.pattern(spark).join(self._edges(spark), F.col("o") == F.col("src")).select(F.col("out").alias("o"), "j").distinct()

    def apply(self, x):
        got = self.arg.apply(x).join(self._edges(x.sparkSession), F.col("i") == F.col("src"))
        return _fill(self.n, x.select("batch").distinct(), got.groupBy("batch", F.col("out").alias("i")).agg(F.sum(F.col("x") * F.col("w")).alias("x")))


@dataclass
class Dot(Op):
    """A product with a constant matrix."""

    a: SparseMatrix
    arg: Op

    @property
    def n(self):
        return self.a.shape[0]

    def pattern(self, spark):
        return self.arg.pattern(spark).join(self.a.df.where("v <> 0").select("r", "c"), F.col("o") == F.col("c")).select(F.col("r").alias("o"), "j").distinct()

    def apply(self, x):
        got = self.arg.apply(x).join(self.a.df, F.col("i") == F.col("c")).groupBy("batch", F.col("r").alias("i")).agg(F.sum(F.col("v") * F.col("x")).alias("x"))
        return _fill(self.n, x.select("batch").distinct(), got)


def scan(carry: Op, step: Callable[[Op, int], Op], length: int) -> Op:
    """``step`` folded over 0 ... length - 1, unrolled."""
    if length > MAX_UNROLL:
        raise NotTraceable(f"a scan of {length} steps is not unrolled")
    for k in range(length):
        carry = step(carry, k)
    return carry


@dataclass
class Call(Op):
    """A nested operator."""

    body: Op

    @property
    def n(self):
        return self.body.n

    def pattern(self, spark):
        return self.body.pattern(spark)

    def apply(self, x):
        return self.body.apply(x)


@dataclass
class Opaque(Op):
    """A function of relations (batch, i, x) that cannot be looked into: everything depends on everything it reads."""

    arg: Op
    n: int
    f: Callable[[DataFrame], DataFrame]

    def pattern(self, spark):
        inputs = self.arg.pattern(spark).select("j").distinct()
        reads = inputs.count()
        if reads > self.arg.n / 2 or reads * self.n > MAX_EDGES:
            raise NotTraceable("an opaque function reads too much")
        return spark.range(self.n).toDF("o").crossJoin(F.broadcast(inputs))

    def apply(self, x):
        return self.f(self.arg.apply(x))


# Operators of the generators


def tridiagonal_operator(n: int, d: float = 2.0) -> Op:
    return Conv(Input(n), (n,), [((-1,), -1.0), ((0,), d), ((1,), -1.0)])


def poisson_operator(n: int, skew: float = 0.0, flip: bool = False) -> Op:
    """Five-point stencil on n by n.  ``flip`` gives the true convolution, the transpose of the matrix generator's."""
    s = -skew if flip else skew
    lo, hi = -1 - s / 2, -1 + s / 2
    return Conv(Input(n * n), (n, n), [((-1, 0), lo), ((0, -1), lo), ((0, 0), 4.0), ((0, 1), hi), ((1, 0), hi)])


def poisson3d_operator(n: int, robin: float = 0.0, diagonal_value: float = 6.0) -> Op:
    """Seven-point stencil; each face outside the grid adds ``robin`` to the diagonal."""
    steps = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    taps = [((0, 0, 0), 0.0)] + [(tuple(s * k for k in step), -1.0) for step in steps for s in (-1, 1)]

    def diagonal(i: Column) -> Column:
        at = [F.floor(i / (n * n)), F.floor(i / n) % n, i % n]
        faces = sum(((p == 0).cast("int") + (p == n - 1).cast("int") for p in at[1:]), (at[0] == 0).cast("int") + (at[0] == n - 1).cast("int"))
        return F.lit(float(diagonal_value)) + F.lit(float(robin)) * faces

    x = Input(n**3)
    return Conv(x, (n, n, n), taps) + Weights(x, diagonal)


# Patterns, probes, materialization


def input_size(op: Op) -> int | None:
    """How many values the operator takes, by the inputs of its tree; None if it has none."""
    if isinstance(op, Input):
        return op.n
    for value in vars(op).values():
        for child in value if isinstance(value, (list, tuple)) else (value,):
            if isinstance(child, Op) and (found := input_size(child)) is not None:
                return found
    return None


def trace_pattern(spark: SparkSession, op: Op) -> DataFrame | None:
    """(r, c), or None where only probing can tell."""
    try:
        return op.pattern(spark).select(F.col("o").alias("r"), F.col("j").alias("c")).distinct()
    except NotTraceable:
        return None


def probe(spark: SparkSession, f: Callable[[DataFrame], DataFrame], n_in: int, tol: float = 1e-10, chunk: int = 4096) -> DataFrame:
    """(r, c, v) of a linear function of relations by unit vectors, ``chunk`` columns at a time."""
    out = None
    for at in range(0, n_in, chunk):
        unit = spark.range(at, min(at + chunk, n_in)).toDF("batch").crossJoin(spark.range(n_in).toDF("i")).select("batch", "i", F.when(F.col("batch") == F.col("i"), 1.0).otherwise(0.0).alias("x"))
        part = f(unit).where(F.abs("x") > tol).select(F.col("i").alias("r"), F.col("batch").alias("c"), F.col("x").alias("v"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.range(0).select(F.col("id").alias("r"), F.col("id").alias("c"), F.lit(0.0).alias("v"))


def conflict_graph(pattern: DataFrame) -> DataFrame:
    """(a, b): pairs of columns that share a row, both ways."""
    p = pattern.select("r", "c").distinct()
    return p.select("r", F.col("c").alias("a")).join(p.select("r", F.col("c").alias("b")), "r").where("a <> b").select("a", "b").distinct()


def color_columns(pattern: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(c, color): columns that share a row differ.  Each round colors the local maxima of a hash (ties by number).

    A column is a local maximum if it is the largest of every row it is in, so a round is one maximum a row and no pairs of
    columns are made.  ``rounds`` bounds the colors; a pattern that needs more raises and loses nothing.
    """
    spark = pattern.sparkSession
    places = pattern.select("r", "c").distinct().persist()
    left = places.select("c").distinct()
    done = None
    for k in range(rounds):
        weight = F.struct(F.xxhash64("c", F.lit(k)), F.col("c"))
        live = places.join(left, "c", "left_semi").select("r", "c", weight.alias("weight"))
        top = live.groupBy("r").agg(F.max("weight").alias("top"))
        beaten = live.join(top, "r").where("top > weight").select("c").distinct()
        won = left.join(beaten, "c", "left_anti").select("c", F.lit(k).alias("color"))
        won = _cut(spark, won)
        done = won if done is None else done.unionByName(won)
        left = _cut(spark, left.join(won, "c", "left_anti"))
        if left.isEmpty():
            places.unpersist()
            return done
    raise RuntimeError("coloring did not settle")


def _cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    shared_root(spark)
    return df.checkpoint()


@dataclass(frozen=True)
class Coloring:
    pattern: DataFrame
    colors: DataFrame
    n_colors: int
    shape: tuple[int, int]


def materialize(op: Op, coloring: Coloring) -> SparseMatrix:
    """The matrix of a linear operator from one evaluation for each color."""
    n_out, n_in = coloring.shape
    spark = coloring.colors.sparkSession
    ones = coloring.colors.select(F.col("color").cast("long").alias("batch"), F.col("c").alias("i"), F.lit(1.0).alias("x"))
    probes = _fill(n_in, spark.range(coloring.n_colors).toDF("batch"), ones)
    values = op.apply(probes)
    entries = coloring.pattern.join(coloring.colors, "c").join(values, (F.col("color") == F.col("batch")) & (F.col("r") == F.col("i"))).select("r", "c", F.col("x").alias("v"))
    return matrix(entries, n_out, n_in)


def verify(op: Op, a: SparseMatrix, checks: int = 5, tol: float = 1e-6) -> bool:
    """Do operator and matrix agree on random vectors?"""
    spark = a.df.sparkSession
    x = spark.range(checks).toDF("batch").crossJoin(spark.range(a.shape[1]).toDF("i")).select("batch", "i", (F.pmod(F.xxhash64("batch", "i"), F.lit(2_000_003)) / 1_000_001.5 - 1).alias("x"))
    want = op.apply(x).withColumnRenamed("x", "y")
    got = x.join(a.df, F.col("i") == F.col("c")).groupBy("batch", F.col("r").alias("i")).agg(F.sum(F.col("v") * F.col("x")).alias("z"))
    row = want.join(got, ["batch", "i"], "left").agg(F.sum(F.pow(F.col("y") - F.coalesce("z", F.lit(0.0)), 2)).alias("e"), F.sum(F.pow("y", 2)).alias("s")).first()
    return (row.e or 0.0) <= tol * tol * max(row.s or 0.0, 1e-300)


def cache_coloring(spark: SparkSession, op: Op, n_in: int | tuple[int, int]) -> tuple[SparseMatrix, Coloring]:
    """The operator's matrix and its coloring: traced where the tree allows it and the result verifies, else probed.

    ``n_in`` may be the whole shape; one that is not the operator's raises.
    """
    rows, n_in = n_in if isinstance(n_in, tuple) else (op.n, n_in)
    width = input_size(op)
    if rows != op.n or width is not None and width != n_in:
        raise ValueError(f"the operator has shape ({op.n}, {width}), not ({rows}, {n_in})")
    shape = (op.n, n_in)
    pattern = trace_pattern(spark, op)
    if pattern is not None:
        pattern = _cut(spark, pattern)
        colors = color_columns(pattern) if not pattern.isEmpty() else pattern.select("c", F.lit(0).alias("color"))
        n_colors = (colors.agg(F.max("color")).first()[0] if not pattern.isEmpty() else -1)
        coloring = Coloring(pattern, colors, (n_colors or 0) + 1 if n_colors is not None and n_colors >= 0 else 0, shape)
        a = matrix(materialize(op, coloring).df.where("abs(v) > 1e-9"), *shape)
        if verify(op, a):
            return a.with_meta(coloring=coloring), coloring
    a = matrix(_cut(spark, probe(spark, op.apply, n_in)), *shape)
    pattern = a.df.select("r", "c")
    colors = color_columns(pattern)
    coloring = Coloring(pattern, colors, colors.agg(F.max("color")).first()[0] + 1, shape)
    return a.with_meta(coloring=coloring), coloring
