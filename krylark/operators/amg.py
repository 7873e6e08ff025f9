"""Algebraic multigrid: its steps as DataFrame operations, and hierarchies with cycles in a local space and on tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import SolveError, SparseMatrix, matrix
from .spaces import LocalSpace, TableSpace, strong_entries

# Steps on tables


def strength_graph(a: SparseMatrix, threshold: float = 0.5) -> DataFrame:
    """(r, c, v) of the strong connections: -a_ij is at least ``threshold`` of the row's largest."""
    return strong_entries(a.df, threshold)


def handshake(a: SparseMatrix) -> DataFrame:
    """(i, agg): pairs of rows that are each other's strongest neighbour, others alone.

    Ties go by a number made from both ends of the edge, the same from either side, so that equal weights still pair.
    """
    sym = a.df.where("r <> c").select(F.col("r").alias("i"), F.col("c").alias("j"), F.abs("v").alias("w"))
    sym = sym.unionByName(sym.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
    tie = (F.least("i", "j") % 1000003 * 7919 + F.greatest("i", "j") % 1000003 * 104729) % 1000003
    best = sym.groupBy("i").agg(F.max(F.struct("w", tie.alias("tie"), (-F.col("j")).alias("neg"))).alias("best")).select("i", (-F.col("best.neg")).alias("j"))
    back = best.select(F.col("i").alias("j"), F.col("j").alias("i2"))
    pairs = best.join(back, "j").where("i = i2").select("i", F.least("i", "j").alias("agg"))
    every = a.df.sparkSession.range(a.shape[0]).toDF("i")
    return every.join(pairs, "i", "left").select("i", F.coalesce("agg", "i").alias("agg"))


def aggregates(a: SparseMatrix, rounds: int = 1) -> DataFrame:
    """(i, agg) after ``rounds`` of pairing: aggregates of up to 2, 4 or 8 rows, named by their least row."""
    out = handshake(a)
    for _ in range(rounds - 1):
        coarse = SparseMatrix(a.df.join(out.toDF("r", "ra"), "r").join(out.toDF("c", "ca"), "c").groupBy("ra", "ca").agg(F.sum("v").alias("v")).toDF("r", "c", "v"), a.meta)
        step = handshake(coarse).toDF("agg", "agg2")
        out = out.join(step, "agg").select("i", F.col("agg2").alias("agg"))
    return out


def galerkin(a: SparseMatrix, agg: DataFrame) -> SparseMatrix:
    """P^T A P for piecewise constant P: two joins and one sum; rows keep their aggregate's name."""
    df = a.df.join(agg.toDF("r", "ra"), "r").join(agg.toDF("c", "ca"), "c").groupBy("ra", "ca").agg(F.sum("v").alias("v"))
    return matrix(df.toDF("r", "c", "v"), *a.shape)


def numbered(agg: DataFrame) -> DataFrame:
    """(i, agg) with aggregates numbered from 0; the numbering is one row for each aggregate, dealt by ranges."""
    names = agg.select("agg").distinct()
    block = F.floor(F.col("agg") / (1 << 16))
    counts = names.groupBy(block.alias("b")).count()
    before = counts.select("b", (F.sum("count").over(Window.orderBy("b")) - F.col("count")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy("agg")) - 1
    numbers = names.withColumn("b", block).withColumn("k", rank).join(before, "b").select("agg", (F.col("base") + F.col("k")).alias("number"))
    return agg.join(numbers, "agg").select("i", F.col("number").alias("agg"))


def grid_stats(levels: list[SparseMatrix]) -> list[tuple[int, int, int]]:
    """(level, rows, entries) of a hierarchy."""
    return [(k, a.df.select("r").distinct().count(), a.nnz()) for k, a in enumerate(levels)]


#: Rounds of pairing of the aggregation selectors with a size in their name.
PAIRINGS = {"SIZE_2": 1, "SIZE_4": 2, "SIZE_8": 3}
#: Rows that a dense coarse solver takes.
DENSE_ROWS = 5000
#: A level of a table hierarchy with at most so many entries and rows goes on in the driver's memory.
DRIVER_ENTRIES, DRIVER_ROWS = 400_000, 50_000
#: What a visit of a level does on the level below.
VISITS = {"V": ["V"], "W": ["W", "W"], "F": ["F", "V"], "CG": ["CG"], "CGF": ["CGF"]}


def pairings(opt: dict) -> int:
    """Rounds of pairing; ``MULTI_PAIRWISE`` makes ``aggregation_passes`` of them."""
    selector = str(opt.get("selector", "SIZE_2")).upper()
    return max(1, int(opt.get("aggregation_passes", 2))) if selector == "MULTI_PAIRWISE" else PAIRINGS.get(selector, 1)


def _symmetric(a: DataFrame) -> DataFrame:
    """(i, j, w): absolute values of both entries of a pair, without the diagonal."""
    one = a.where("r <> c").select(F.col("r").alias("i"), F.col("c").alias("j"), F.abs("v").alias("w"))
    return one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))


def table_pairs(sp: TableSpace, a: DataFrame, index: DataFrame, rounds: int = 3) -> DataFrame:
    """(i, agg): ``rounds`` of handshakes among rows still alone; then a row alone joins its strongest neighbour's aggregate."""
    sym = sp.dealt(_symmetric(a), "i")
    tie = F.xxhash64(F.least("i", "j"), F.greatest("i", "j"))  # the same from either side
    best_of = lambda edges: edges.groupBy("i").agg(F.max(F.struct("w", tie.alias("tie"), F.col("j").alias("to"))).alias("best")).select("i", F.col("best.to").alias("j"))
    done = index.select("i", F.lit(None).cast("long").alias("agg")).checkpoint()
    for _ in range(rounds):
        alone = done.where("agg is null").select("i")
        edges = sym.join(alone, "i", "left_semi").join(alone.toDF("j"), "j", "left_semi")
        best = best_of(edges)
        pairs = best.join(best.toDF("j", "back"), "j").where("i = back").select("i", F.least("i", "j").alias("found"))
        done = done.join(pairs, "i", "left").select("i", F.coalesce("agg", "found").alias("agg")).checkpoint()
    rest = best_of(sym.join(done.where("agg is null").select("i"), "i", "left_semi")).join(done.where("agg is not null").toDF("j", "theirs"), "j").select("i", "theirs")
    return done.join(rest, "i", "left").select("i", F.coalesce("agg", "theirs", "i").alias("agg"))


def table_coarse_rows(sp: TableSpace, strong: DataFrame) -> DataFrame:
    """(i, coarse): a maximal independent set of the strength graph (r, c), by weights of influence plus a hash, in rounds."""
    both = sp.dealt(strong.union(strong.select("c", "r")).distinct(), "c")
    weight = strong.groupBy(F.col("c").alias("i")).agg(F.count("*").alias("w"))
    # 0 open, 1 coarse, -1 fine
    state = sp.table.select("i").join(weight, "i", "left").select("i", F.struct(F.coalesce("w", F.lit(0)).alias("w"), F.xxhash64("i").alias("h"), F.col("i").alias("n")).alias("rank"), F.when(F.col("w") > 0, 0).otherwise(-1).alias("state")).checkpoint()
    while state.where("state = 0").limit(1).count():
        open_rows = state.where("state = 0").select(F.col("i").alias("c"), F.col("rank").alias("theirs"))
        top = both.join(open_rows, "c").groupBy(F.col("r").alias("i")).agg(F.max("theirs").alias("top"))
        state = state.join(top, "i", "left").select("i", "rank", F.when((F.col("state") == 0) & (F.col("top").isNull() | (F.col("rank") > F.col("top"))), 1).otherwise(F.col("state")).alias("state")).checkpoint()
        near = strong.join(state.where("state = 1").select(F.col("i").alias("c")), "c", "left_semi").select(F.col("r").alias("i")).distinct().withColumn("near", F.lit(True))
        state = state.join(near, "i", "left").select("i", "rank", F.when((F.col("state") == 0) & F.col("near"), -1).otherwise(F.col("state")).alias("state")).checkpoint()
    return state.select("i", (F.col("state") == 1).alias("coarse"))


def table_distance_two(sp: TableSpace, strong: DataFrame, coarse: DataFrame) -> DataFrame:
    """(i, j, w): extended interpolation by joins; a coarse row keeps its name."""
    a = sp.a
    c_rows, f_rows = coarse.where("coarse").select("i"), coarse.where("not coarse").select("i")
    fine = strong.join(f_rows.toDF("r"), "r", "left_semi")
    to_c, to_f = fine.join(c_rows.toDF("c"), "c", "left_semi").select("r", "c"), fine.join(f_rows.toDF("c"), "c", "left_semi").select("r", "c")
    second = to_f.join(to_c.toDF("c", "far"), "c").select("r", F.col("far").alias("c"))
    reach = sp.dealt(to_c.union(second).distinct(), "r")
    entries = a.join(f_rows.toDF("r"), "r", "left_semi")
    marked = entries.join(reach.withColumn("reached", F.lit(True)), ["r", "c"], "left").join(to_f.withColumn("through", F.lit(True)), ["r", "c"], "left")
    own = marked.groupBy("r").agg(F.sum(F.when((F.col("r") == F.col("c")) | F.col("reached").isNull() & F.col("through").isNull(), F.col("v")).otherwise(0.0)).alias("diag"))
    direct = marked.where("reached").select("r", "c", "v")
    # what a row has through its strong fine neighbours: a_ik times a_kj over the sum of the a_kj it can use
    through = marked.where("through").select("r", F.col("c").alias("k"), F.col("v").alias("aik"))
    diagonal = a.where("r = c").select(F.col("r").alias("k"), F.col("v").alias("akk"))
    targets = reach.union(f_rows.select(F.col("i").alias("r"), F.col("i").alias("c")))
    step = through.join(a.select(F.col("r").alias("k"), "c", F.col("v").alias("akj")), "k").join(diagonal, "k").where("akj * akk < 0").join(targets, ["r", "c"], "left_semi")
    part = step.join(step.groupBy("r", "k").agg(F.sum("akj").alias("total")), ["r", "k"]).select("r", "c", "k", (F.col("aik") * F.col("akj") / F.col("total")).alias("v"))
    part = sp.dealt(part, "r")
    lost = through.join(part.select("r", "k").distinct(), ["r", "k"], "left_anti").groupBy("r").agg(F.sum("aik").alias("lost"))
    back = part.where("r = c").groupBy("r").agg(F.sum("v").alias("back"))
    diag = own.join(lost, "r", "left").join(back, "r", "left").select("r", (F.col("diag") + F.coalesce("lost", F.lit(0.0)) + F.coalesce("back", F.lit(0.0))).alias("diag"))
    weights = direct.unionByName(part.where("r <> c").select("r", "c", "v")).groupBy("r", "c").agg(F.sum("v").alias("v"))
    out = weights.join(diag.where("diag <> 0"), "r").select(F.col("r").alias("i"), F.col("c").alias("j"), (-F.col("v") / F.col("diag")).alias("w"))
    return out.unionByName(c_rows.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")))


def table_galerkin(a: DataFrame, p: DataFrame) -> DataFrame:
    """P^T A P for P as (i, j, w)."""
    right = a.join(p.select(F.col("i").alias("c"), F.col("j").alias("jc"), F.col("w").alias("wc")), "c").groupBy("r", "jc").agg(F.sum(F.col("v") * F.col("wc")).alias("v"))
    return right.join(p.select(F.col("i").alias("r"), F.col("j").alias("jr"), F.col("w").alias("wr")), "r").groupBy("jr", "jc").agg(F.sum(F.col("v") * F.col("wr")).alias("v")).toDF("r", "c", "v")


class TableHierarchy:
    """Levels of table spaces; a coarse row keeps the name of a fine one.  A level that is counted to be small goes on as a
    local hierarchy of the same kind in the driver, so that no more than ``DRIVER_ENTRIES`` entries ever leave the tables."""

    def __init__(self, sp: TableSpace, opt: dict):
        from .krylov import LOCAL_ONLY, RELAXATIONS

        self.opt, block = opt, int(opt.get("block_dim", 1))
        algorithm, selector = str(opt.get("algorithm", "CLASSICAL")).upper(), str(opt.get("selector", "PMIS")).upper()
        smoother = opt.get("smoother", "BLOCK_JACOBI")
        name, options = (smoother, {}) if isinstance(smoother, str) else (smoother.get("solver", "BLOCK_JACOBI"), smoother)
        if str(name).upper() in LOCAL_ONLY:
            raise ValueError(f"{name} runs in one task only and cannot smooth on tables")
        if int(opt.get("aggressive_levels", 0)):
            raise ValueError("aggressive_levels is for systems that are solved in one task")
        if algorithm != "AGGREGATION" and selector == "HMIS":
            raise ValueError("HMIS goes from row to row and runs in one task only; PMIS runs on tables")
        self.spaces, self.p, self.smooth = [sp], [], []
        left = int(opt.get("max_levels", 100))
        while True:
            fine = self.spaces[-1]
            rows, entries = fine.table.count(), fine.a.count()
            if rows <= int(opt.get("driver_rows", DRIVER_ROWS)) and entries <= DRIVER_ENTRIES:
                break
            if len(self.spaces) >= left:
                raise ValueError(f"the last of {left} levels has {rows} rows and {entries} entries; levels end below {DRIVER_ROWS} rows and {DRIVER_ENTRIES} entries only")
            index = fine.table.select("i")
            if algorithm == "AGGREGATION":
                nodes = fine.a.select(F.expr(f"r div {block}").alias("r"), F.expr(f"c div {block}").alias("c"), "v") if block > 1 else fine.a
                names = index.select(F.expr(f"i div {block}").alias("i")).distinct() if block > 1 else index
                agg = table_pairs(fine, nodes, names)
                for _ in range(pairings(opt) - 1):
                    quotient = nodes.join(agg.toDF("r", "ra"), "r").join(agg.toDF("c", "ca"), "c").groupBy(F.col("ra").alias("r"), F.col("ca").alias("c")).agg(F.sum("v").alias("v"))
                    step = table_pairs(fine, quotient, agg.select(F.col("agg").alias("i")).distinct())
                    agg = agg.join(step.toDF("agg", "next"), "agg").select("i", F.col("next").alias("agg"))
                p = agg.select("i", F.col("agg").alias("j"), F.lit(1.0).alias("w"))
                if block > 1:
                    p = p.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda k: F.struct((F.col("i") * block + k).alias("i"), (F.col("j") * block + k).alias("j"), F.col("w").alias("w")))).alias("x")).select("x.*")
            else:
                strong = fine.dealt(strong_entries(fine.a, float(opt.get("strength_threshold", 0.5))).select("r", "c"), "r")
                p = table_distance_two(fine, strong, table_coarse_rows(fine, strong))
            p = p.select(F.col("i").cast("long"), F.col("j").cast("long"), "w").checkpoint()
            names = p.select(F.col("j").alias("i")).distinct().checkpoint()
            size = names.count()
            if size == 0 or size >= rows:
                raise ValueError(f"the hierarchy does not get smaller than {rows} rows, which are too many for one task")
            below = TableSpace(matrix(table_galerkin(fine.a, p), fine.n), None, fine.parts, names)
            self.smooth.append(RELAXATIONS[str(name).upper()](fine, {"block_dim": block, **options}))
            down = fine.dealt(p.select(F.col("j").alias("r"), F.col("i").alias("c"), F.col("w").alias("v")))
            up = fine.dealt(p.select(F.col("i").alias("r"), F.col("j").alias("c"), F.col("w").alias("v")))
            self.p.append((down, up))
            fine.children.append(below)
            self.spaces.append(below)
        last = self.spaces[-1]
        self.names = np.array(sorted(r.i for r in last.table.select("i").collect()), np.int64)  # counted above
        got = last.a.select("r", "c", "v").toPandas()
        small = LocalSpace(len(self.names), np.searchsorted(self.names, got["r"]), np.searchsorted(self.names, got["c"]), got["v"])
        self.bottom = Hierarchy(small, {**opt, "max_levels": max(left - len(self.p), 1)})

    def stats(self) -> list[tuple[int, int, int]]:
        own = [(k, s.table.count(), s.a.count()) for k, s in enumerate(self.spaces[:-1])]
        return own + [(k + len(own), rows, entries) for k, rows, entries in self.bottom.stats()]

    def _bottom(self, r: str, kind: str) -> str:
        sp = self.spaces[-1]
        got = sp.table.select("i", F.col(r).alias("x")).toPandas().sort_values("i")
        z = self.bottom.cycle(got["x"].to_numpy(), 0, kind)
        return sp.put(sp.spark.createDataFrame(list(zip(self.names.tolist(), z.tolist())), "i long, x double"))

    @staticmethod
    def _moved(m: DataFrame, source: TableSpace, x: str, target: TableSpace) -> str:
        side = source.table.select(F.col("i").alias("c"), F.col(x).alias("x"))
        return target.put(m.join(side, "c").groupBy(F.col("r").alias("i")).agg(F.sum(F.col("v") * F.col("x"))))

    def cycle(self, r: str, level: int = 0, kind: str | None = None) -> str:
        kind = kind or str(self.opt.get("cycle", "V")).upper()
        if level == len(self.p):
            return self._bottom(r, kind)
        sp, below, smooth = self.spaces[level], self.spaces[level + 1], self.smooth[level]
        down, up = self.p[level]
        x = None

        def sweep(x: str | None) -> str:
            left = r if x is None else sp.lin((1.0, r), (-1.0, sp.mul(x)))
            return smooth(left) if x is None else sp.lin((1.0, x), (1.0, smooth(left)))

        for _ in range(int(self.opt.get("presweeps", 1))):
            x = sweep(x)
        for again in VISITS.get(kind, ["V"]):
            left = r if x is None else sp.lin((1.0, r), (-1.0, sp.mul(x)))
            step = self._moved(up, below, self.cycle(self._moved(down, sp, left, below), level + 1, again), sp)
            if kind in ("CG", "CGF"):  # the step length that minimizes the error along the correction
                bottom, top = sp.dots((step, sp.mul(step)), (step, left))
                step = sp.lin((top / bottom if bottom else 1.0, step))
            x = step if x is None else sp.lin((1.0, x), (1.0, step))
        for _ in range(int(self.opt.get("postsweeps", 1))):
            x = sweep(x)
        return x


def hierarchy(sp: LocalSpace | TableSpace, opt: dict):
    from .blocks import BlockHierarchy, BlockSpace

    out = BlockHierarchy(sp, opt) if isinstance(sp, BlockSpace) else Hierarchy(sp, opt) if isinstance(sp, LocalSpace) else TableHierarchy(sp, opt)
    sp.grid = out.stats()
    return out


# Hierarchy in a local space


def strength(sp: LocalSpace, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    off = sp.r != sp.c
    top = np.zeros(sp.n)
    np.maximum.at(top, sp.r[off], -sp.v[off])
    keep = off & (top[sp.r] > 0) & (-sp.v >= threshold * top[sp.r])
    return sp.r[keep], sp.c[keep]


def pmis(n: int, r: np.ndarray, c: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Coarse points: a maximal independent set of the strength graph by weights of influence plus a hash."""
    influence = np.bincount(c, minlength=n).astype(float)
    jitter = ((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / 2.0**53
    weight = influence + jitter
    u, v = np.concatenate([r, c]), np.concatenate([c, r])
    state = np.where(influence > 0, 0, -1)  # 0 open, 1 coarse, -1 fine
    isolated = np.bincount(u, minlength=n) == 0
    state[isolated] = 1 if n < 2 else -1
    if first is not None:
        state[first & (state == 0)] = 1
        state[u[(state[v] == 1) & (state[u] == 0)]] = -1
    for _ in range(n):
        if not (state == 0).any():
            break
        live = (state[u] == 0) & (state[v] == 0)
        top = np.full(n, -1.0)
        np.maximum.at(top, u[live], weight[v[live]])
        won = (state == 0) & (weight > top)
        state[won] = 1
        near = np.zeros(n, bool)
        near[r[state[c] == 1]] = True
        state[near & (state == 0)] = -1
    return state == 1


def first_pass(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Coarse points of the first pass of Ruge and Stueben: the open row on which most others depend becomes coarse, those that
    depend on it fine, and what these depend on counts more."""
    import heapq

    order, back = np.argsort(r, kind="stable"), np.argsort(c, kind="stable")
    on, on_at = c[order].tolist(), np.searchsorted(r[order], np.arange(n + 1)).tolist()
    by, by_at = r[back].tolist(), np.searchsorted(c[back], np.arange(n + 1)).tolist()
    weight = [by_at[i + 1] - by_at[i] for i in range(n)]
    state = [0] * n  # 0 open, 1 coarse, -1 fine
    heap = [(-w, i) for i, w in enumerate(weight) if w]
    heapq.heapify(heap)
    while heap:
        w, i = heapq.heappop(heap)
        if state[i] or -w != weight[i]:
            continue
        state[i] = 1
        for j in by[by_at[i]:by_at[i + 1]]:
            if not state[j]:
                state[j] = -1
                for k in on[on_at[j]:on_at[j + 1]]:
                    if not state[k]:
                        weight[k] += 1
                        heapq.heappush(heap, (-weight[k], k))
    return np.array(state) == 1


#: Paths of two steps that interpolation works out together.
PATHS = 1 << 21


def _expanded(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``rows``, the places start[row] to start[row + 1]: (number of the row in ``rows``, place)."""
    n = start[rows + 1] - start[rows]
    who = np.repeat(np.arange(len(rows)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[rows], n)


def _shares(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of items that have about ``PATHS`` together."""
    ends = np.cumsum(sizes)
    edges = [0, *np.searchsorted(ends, np.arange(PATHS, ends[-1] if len(ends) else 0, PATHS)).tolist(), len(sizes)]
    return list(zip(edges, edges[1:]))


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each of ``wanted`` is among the sorted ``keys``, where)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def distance_two(sp: LocalSpace, coarse: np.ndarray, sr: np.ndarray, sc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Extended interpolation: a fine point takes from its strong coarse neighbours and from those of its strong fine ones."""
    n, number = sp.n, np.cumsum(coarse) - 1
    key, place = np.unique(sp.r * n + sp.c, return_inverse=True)
    r, c, v = key // n, key % n, np.bincount(place, sp.v, len(key))
    start = np.searchsorted(r, np.arange(n + 1))
    fine = ~coarse[sr]
    to_c = np.unique((sr * n + sc)[fine & coarse[sc]])
    to_f = np.unique((sr * n + sc)[fine & ~coarse[sc]])
    c_start = np.searchsorted(to_c // n, np.arange(n + 1))
    far = [to_c]
    for lo, hi in _shares(c_start[to_f % n + 1] - c_start[to_f % n]):
        who, at = _expanded(c_start, to_f[lo:hi] % n)
        far.append(np.unique(to_f[lo:hi][who] // n * n + to_c[at] % n))
    reach = np.unique(np.concatenate(far))

    own = ~coarse[r]
    reached, at = _place(reach, key)
    through, _ = _place(to_f, key)
    reached, through = reached & own, through & own
    weight = np.bincount(at[reached], v[reached], len(reach)) if len(reach) else np.zeros(0)
    diagonal = np.ones(n)
    diagonal[r[r == c]] = v[r == c]
    rest = own & ((r == c) | ~reached & ~through)
    diag = np.bincount(r[rest], v[rest], n)
    # what a row has through a strong fine neighbour k: a_ik times a_kj over the sum of the a_kj it can use
    steps = np.flatnonzero(through)
    for lo, hi in _shares(start[c[steps] + 1] - start[c[steps]]):
        part = steps[lo:hi]
        who, at = _expanded(start, c[part])
        i, k, j = r[part][who], c[part][who], c[at]
        found, to = _place(reach, i * n + j)
        good = (v[at] * diagonal[k] < 0) & (found | (j == i))
        who, i, j, to, a_kj = who[good], i[good], j[good], to[good], v[at][good]
        total = np.bincount(who, a_kj, len(part))
        lost = total == 0
        diag += np.bincount(r[part][lost], v[part][lost], n)
        share = v[part][who] * np.divide(a_kj, total[who], out=np.zeros_like(a_kj), where=total[who] != 0)
        back = j == i
        diag += np.bincount(i[back], share[back], n)
        if len(reach):
            weight += np.bincount(to[~back], share[~back], len(reach))
    i, j = reach // n, reach % n
    good = diag[i] != 0
    rows, names = np.concatenate([np.flatnonzero(coarse), i[good]]), np.concatenate([number[coarse], number[j[good]]])
    order = np.argsort(rows, kind="stable")
    return rows[order], names[order], np.concatenate([np.ones(int(coarse.sum())), -weight[good] / diag[i[good]]])[order]


def pairwise(sp: LocalSpace, block: int = 1) -> np.ndarray:
    """Aggregate numbers after repeated handshakes, on blocks of ``block`` rows."""
    n = sp.n // block
    r, c, w = sp.r // block, sp.c // block, np.abs(sp.v)
    off = r != c
    u, v = np.concatenate([r[off], c[off]]), np.concatenate([c[off], r[off]])
    w = np.concatenate([w[off], w[off]])
    key, place = np.unique(u * n + v, return_inverse=True)
    weight = np.bincount(place, w, len(key))
    u, v = key // n, key % n
    mate = np.full(n, -1)
    for _ in range(10):
        live = (mate[u] < 0) & (mate[v] < 0)
        if not live.any():
            break
        order = np.lexsort((v[live], -weight[live], u[live]))
        a, b = u[live][order], v[live][order]
        first = np.concatenate([[True], a[1:] != a[:-1]])
        best = np.full(n, -1)
        best[a[first]] = b[first]
        i = np.flatnonzero(best >= 0)
        good = i[best[best[i]] == i]
        mate[good] = best[good]
        if not len(good):
            break
    lead = np.where((mate >= 0) & (mate < np.arange(n)), mate, np.arange(n))
    # a row left over joins the strongest neighbour's aggregate
    alone = mate < 0
    order = np.lexsort((v, -weight, u))
    a, b = u[order], v[order]
    first = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
    best = np.arange(n)
    best[a[first]] = b[first]
    lead = np.where(alone & (mate[best] >= 0), lead[best], lead)
    _, number = np.unique(lead, return_inverse=True)
    return number


class Hierarchy:
    """Levels of local spaces with interpolation between them."""

    def __init__(self, sp: LocalSpace, opt: dict):
        from .krylov import RELAXATIONS, dense_lu

        self.opt = opt
        block = int(opt.get("block_dim", 1))
        algorithm, selector = str(opt.get("algorithm", "CLASSICAL")).upper(), str(opt.get("selector", "PMIS")).upper()
        floor = max(int(opt.get("min_coarse_rows", 2)), int(opt.get("dense_lu_num_rows", 1)), 2)
        smoother = opt.get("smoother", "BLOCK_JACOBI")
        name, options = (smoother, {}) if isinstance(smoother, str) else (smoother.get("solver", "BLOCK_JACOBI"), smoother)
        self.spaces, self.p, self.smooth = [sp], [], []
        while len(self.spaces) < int(opt.get("max_levels", 100)) and self.spaces[-1].n > floor:
            fine = self.spaces[-1]
            if algorithm == "AGGREGATION":
                number = fine.once(f"aggregates {pairings(opt)} {block}", lambda: self._aggregates(fine, block))  # noqa: B023
                rows = np.arange(fine.n)
                p = (rows, number[rows // block] * block + rows % block, np.ones(fine.n))
                size = (int(number.max()) + 1) * block
            else:
                sr, sc = strength(fine, float(opt.get("strength_threshold", 0.5)))
                level = len(self.spaces)
                coarse = fine.once(f"coarse {selector} {opt.get('strength_threshold', 0.5)} {opt.get('aggressive_levels', 0)}", lambda: self._coarse_rows(fine, sr, sc, level))  # noqa: B023
                p, size = distance_two(fine, coarse, sr, sc), int(coarse.sum())
            if size == 0 or size >= fine.n:
                break
            self.p.append((*p, size))
            self.smooth.append(RELAXATIONS[str(name).upper()](fine, {"block_dim": block, **options}))
            below = self._coarse(fine, *p, size)
            below.kept = fine.once("below", dict)
            self.spaces.append(below)
        last = self.spaces[-1]
        bottom = opt.get("coarse_solver", "DENSE_LU_SOLVER")
        bottom = {"solver": bottom} if isinstance(bottom, str) else bottom
        kind = str(bottom.get("solver")).upper()
        if kind in ("DENSE_LU_SOLVER", "AMG"):
            if last.n > DENSE_ROWS:
                raise ValueError(f"the coarsest level has {last.n} rows; a dense coarse solver takes {DENSE_ROWS} at most: allow more levels or name a relaxation as coarse_solver")
            self.coarsest = self._pinv_safe(dense_lu(last), last)
        else:
            relax, count = RELAXATIONS.get(kind, RELAXATIONS["BLOCK_JACOBI"])(last, {"block_dim": block, **bottom}), int(bottom.get("max_iters", 50))

            def several(r, relax=relax, count=count):
                x = np.zeros(last.n)
                for _ in range(count):
                    x = x + relax(r - last.mul(x))
                return x

            self.coarsest = several

    def _aggregates(self, fine: LocalSpace, block: int) -> np.ndarray:
        number = pairwise(fine, block)
        for _ in range(pairings(self.opt) - 1):
            size = int(number.max()) + 1
            quotient = LocalSpace(size, number[fine.r // block], number[fine.c // block], fine.v)
            number = pairwise(self._summed(quotient))[number]
        return number

    def _coarse_rows(self, fine: LocalSpace, sr: np.ndarray, sc: np.ndarray, level: int) -> np.ndarray:
        first = first_pass(fine.n, sr, sc) if str(self.opt.get("selector", "PMIS")).upper() == "HMIS" else None
        coarse = pmis(fine.n, sr, sc, first)
        if level > int(self.opt.get("aggressive_levels", 0)) or coarse.sum() <= 2:
            return coarse
        # a second selection among the coarse rows, by strong paths of two steps
        index = np.flatnonzero(coarse)
        order = np.argsort(sr, kind="stable")
        to, start = sc[order], np.searchsorted(sr[order], np.arange(fine.n + 1))
        first = coarse[sr]
        a, k = sr[first], sc[first]
        n = start[k + 1] - start[k]
        a, b = np.repeat(a, n), to[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[k], n)]
        far = coarse[b] & (a != b)
        if far.any():
            back = np.full(fine.n, -1)
            back[index] = np.arange(len(index))
            pair = np.unique(back[a[far]] * len(index) + back[b[far]])
            coarse = np.zeros(fine.n, bool)
            coarse[index[pmis(len(index), pair // len(index), pair % len(index))]] = True
        return coarse

    @staticmethod
    def _pinv_safe(solve, space):
        def apply(r):
            try:
                return solve(r)
            except SolveError:
                return np.linalg.lstsq(space.dense(), r, rcond=None)[0]

        return apply

    @staticmethod
    def _summed(sp: LocalSpace) -> LocalSpace:
        key, place = np.unique(sp.r * sp.n + sp.c, return_inverse=True)
        return LocalSpace(sp.n, key // sp.n, key % sp.n, np.bincount(place, sp.v, len(key)))

    @classmethod
    def _coarse(cls, a: LocalSpace, pi: np.ndarray, pj: np.ndarray, pv: np.ndarray, size: int) -> LocalSpace:
        order = np.argsort(pi, kind="stable")
        pi, pj, pv = pi[order], pj[order], pv[order]
        start = np.searchsorted(pi, np.arange(a.n + 1))

        def spread(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Entry numbers and places in P of every (entry, P row of its index) pair."""
            n = start[index + 1] - start[index]
            entry = np.repeat(np.arange(len(index)), n)
            return entry, np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[index], n)

        e, k = spread(a.c)
        r, c, v = a.r[e], pj[k], a.v[e] * pv[k]
        e, k = spread(r)
        return cls._summed(LocalSpace(size, pj[k], c[e], v[e] * pv[k]))

    def stats(self) -> list[tuple[int, int, int]]:
        return [(k, s.n, len(s.v)) for k, s in enumerate(self.spaces)]

    def cycle(self, r: np.ndarray, level: int = 0, kind: str | None = None) -> np.ndarray:
        kind = kind or str(self.opt.get("cycle", "V")).upper()
        if level == len(self.p):
            return self.coarsest(r)
        sp, smooth = self.spaces[level], self.smooth[level]
        pi, pj, pv, size = self.p[level]
        x = np.zeros(sp.n)
        for _ in range(int(self.opt.get("presweeps", 1))):
            x = x + smooth(r - sp.mul(x))
        visits = VISITS.get(kind, ["V"])
        if level + 1 == len(self.p):
            visits = visits[:1]
        for again in visits:
            left = r - sp.mul(x)
            coarse = self.cycle(np.bincount(pj, pv * left[pi], size), level + 1, again)
            step = np.bincount(pi, pv * coarse[pj], sp.n)
            if kind in ("CG", "CGF"):  # the step length that minimizes the error along the correction
                image = sp.mul(step)
                bottom = float(step @ image)
                step = step * (float(step @ left) / bottom if bottom else 1.0)
            x = x + step
        for _ in range(int(self.opt.get("postsweeps", 1))):
            x = x + smooth(r - sp.mul(x))
        return x
