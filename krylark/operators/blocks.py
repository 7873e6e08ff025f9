"""Vectors in the driver, the matrix in blocks of rows on the executors.

Between the system that one task solves and the one whose vectors are tables too: a vector of up to ``BLOCK_ROWS`` rows
fits in the driver, so that combinations and inner products are numpy and a product with A is one small job over cached
blocks, without a shuffle.  Rows are dealt by a hash; for multicolor methods, colors stand in groups: what the other groups add to a
product is a job over all executors, and the sweep over a group's own entries is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby
from weakref import WeakKeyDictionary

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SolveError, SparseMatrix
from .amg import DRIVER_ENTRIES, DRIVER_ROWS, VISITS, Hierarchy, pairings
from .spaces import LocalSpace, TableSpace

#: Entries of a block; of a color's block; that a task reads before it deals them out; paths of elimination at a time.
ENTRIES, COLOR_ENTRIES, DEALT, PATHS = 1_500_000, 400_000, 1_000_000, 2_000_000
#: Entries that one task has of a matrix, in several blocks: a task of its own for each block would take longer to begin than to run.
TASK_ENTRIES = 10_000_000
#: A sweep goes by groups of consecutive colors with at most so many entries (12 bytes each) among a group's own rows: those are one task.
SWEPT = 8_000_000
#: Groups end between so many bins of consecutive colors.
BINS = 512
#: A matrix with at most so many entries (12 bytes each, or fewer) is in the driver too, as long as all those have no more together: no job for its products.
DRIVEN, DRIVEN_TOGETHER = 6_000_000, 16_000_000
#: A block: its number, the names of its rows, where each starts, columns and values by row and column.
#: Values are the narrowest kind that is exactly them; ``_values`` has them as doubles.
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]

#: Matrices in use, with the entries that the driver has of each.
_LIVE: WeakKeyDictionary = WeakKeyDictionary()


def _narrow(v: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.float32):
        with np.errstate(all="ignore"):
            small = v.astype(kind)
        if np.array_equal(small, v) and not (np.signbit(v) & (v == 0)).any():
            return small
    return v


def _values(b: Block) -> np.ndarray:
    return b[4].astype(np.float64)


def tasks_for(context, parts: int) -> int:
    """Tasks that have so many blocks between them."""
    cores = max(1, context.defaultParallelism)
    return min(parts, cores * -(-parts * ENTRIES // (cores * TASK_ENTRIES)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of whole numbers, 0 to 2^62."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(2)).astype(np.int64)


def _by_hash(r: np.ndarray, parts: int) -> np.ndarray:
    return _mixed(r) % parts


def _split(where: np.ndarray, *columns: np.ndarray) -> Iterable[tuple[int, tuple]]:
    """(part, columns): entries by the part where they belong."""
    order = np.argsort(where.astype(np.int16) if len(where) and where.max() < 1 << 15 else where, kind="stable")  # by radix
    names, first = np.unique(where[order], return_index=True)
    for p, lo, hi in zip(names.tolist(), first, [*first[1:], len(order)]):
        yield p, tuple(x[order[lo:hi]] for x in columns)


def _at(block: Block) -> np.ndarray:
    """The place of each entry's row in the block."""
    _, rows, start, c, _ = block
    return np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(start, append=len(c)))


def _summed(r: np.ndarray, c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by row and column, those of one place added up."""
    key = r.astype(np.int64) << 32 | c
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key = key[first]
    return (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), np.add.reduceat(v[order], first) if len(first) else v[:0]


def _block(p: int, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> Block:
    rows, start = np.unique(r, return_index=True)
    return p, rows, start.astype(np.int32), c, _narrow(v)


def _joined(pieces: Iterable[tuple[int, tuple]], build: Callable = _summed) -> Iterable[Block]:
    """One block for each number that a partition holds."""
    held: dict[int, list[tuple]] = {}
    for p, piece in pieces:
        held.setdefault(p, []).append(piece)
    for p in list(held):
        r, c, v, *more = (np.concatenate(x) for x in zip(*held.pop(p)))
        r, c, v = build(r, c, v.astype(np.float64), *more)
        if len(r):
            yield _block(p, r, c, v)


def _both_ways(r: np.ndarray, c: np.ndarray, v: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a_ij a_ji where both are stored."""
    r, c, z = _summed(r, c, np.where(turned, 0, v) + 1j * np.where(turned, v, 0))
    both = (z.real != 0) & (z.imag != 0)
    return r[both], c[both], (z.real * z.imag)[both]


class Blocks:
    """A matrix as an RDD of blocks, cached until it is let go; block p stands in partition p, or ``where(p)``, or with others in one of so many ``tasks``."""

    def __init__(self, pieces: RDD, parts: int, build: Callable = _summed, where: Callable = int, tasks: int | None = None):
        dealt = pieces.partitionBy(parts, where) if tasks is None else pieces.partitionBy(tasks, lambda p: p % tasks)
        rdd = dealt.mapPartitions(lambda it: _joined(it, build)).persist(StorageLevel.MEMORY_AND_DISK)
        known = rdd.map(lambda b: (b[0], b[1], len(b[3]))).collect()
        self._take(rdd, {p: rows for p, rows, _ in known}, sum(size for _, _, size in known), parts)

    def _take(self, rdd: RDD, rows: dict[int, np.ndarray], entries: int, parts: int) -> None:
        self.rdd, self.rows, self.entries, self.parts = rdd, rows, entries, parts
        together = entries + sum(_LIVE.values())
        self.mine = [rdd.context.runJob(rdd, list, [k]) for k in range(rdd.getNumPartitions())] if entries <= DRIVEN and together <= DRIVEN_TOGETHER else None
        _LIVE[self] = entries if self.mine is not None else 0

    @classmethod
    def of(cls, df: DataFrame, parts: int) -> Blocks:
        import pickle

        import pyarrow as pa

        def run(batches):
            def out(held):
                table = pa.Table.from_batches(held)
                r, c = (table.column(k).to_numpy() for k in range(2))
                found = list(_split(_by_hash(r, parts), r, c, _narrow(table.column(2).to_numpy())))
                return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([pickle.dumps(x, 5) for _, x in found], pa.binary())], names=["p", "x"])

            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.num_rows
                if size >= DEALT:
                    yield out(held)
                    held, size = [], 0
            if size:
                yield out(held)

        # absent values never reach the arrays: a matrix has none
        dealt = df.select(F.col("r").cast("int"), F.col("c").cast("int"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v")).mapInArrow(run, "p long, x binary")
        return cls(dealt.rdd.map(lambda row: (row.p, pickle.loads(row.x))), parts, tasks=tasks_for(df.sparkSession.sparkContext, parts))

    def _ask(self, f: Callable, shared: object, parts: Iterable[int]) -> list:
        """``f(blocks, shared)`` of each partition, in the driver where it has the matrix."""
        if self.mine is not None:
            return [f(self.mine[k], shared) for k in parts]
        context = self.rdd.context
        sent = context.broadcast(shared)
        try:
            return context.runJob(self.rdd, lambda it: [f(it, sent.value)], list(parts))
        finally:
            sent.destroy()

    def run(self, f: Callable, shared: object, only: Iterable[int] | None = None) -> list:
        """``f(block, shared)`` of all blocks, or of those named."""
        parts = range(self.rdd.getNumPartitions()) if only is None else [p for p in only if p in self.rows]
        return [y for got in self._ask(lambda blocks, x: [f(b, x) for b in blocks], shared, parts) for y in got]

    def all_at_once(self, f: Callable, shared: object, part: int) -> list:
        """``f(blocks, shared)`` of one partition."""
        return self._ask(f, shared, [part])[0]

    def vector(self, n: int, f: Callable, shared: object, only: Iterable[int] | None = None) -> np.ndarray:
        """A vector of what ``f`` gives for the rows of the blocks, zero elsewhere."""
        out = np.zeros(n)
        for p, y in self.run(lambda b, x: (b[0], f(b, x)), shared, only):
            out[self.rows[p]] = y
        return out

    def close(self) -> None:
        _LIVE.pop(self, None)
        self.mine = None
        self.rdd.unpersist()


def _product(b: Block, x: np.ndarray) -> np.ndarray:
    y = x.take(b[3])
    y *= b[4]
    return np.add.reduceat(y, b[2])


def _squares(b: Block, x: np.ndarray) -> np.ndarray:
    """A product with the squares off the diagonal."""
    return np.add.reduceat(np.where(b[1][_at(b)] == b[3], 0.0, _values(b) ** 2) * x[b[3]], b[2])


def _swept(it: Iterable[Block], shared: tuple) -> list[np.ndarray]:
    """A sweep over colors of one group by its own entries; ``image``: what the other groups' rows add to the product."""
    order, n, names, color, start, p, q, image, product = shared
    blocks, z = {b[0]: b for b in it}, np.zeros(n)
    z[names] = start
    by_color = np.argsort(color, kind="stable")
    ends = np.searchsorted(color[by_color], np.arange(max(order) + 2))
    for k in order:
        mine = by_color[ends[k]:ends[k + 1]]
        rows, left = names[mine], image[mine]
        if k in blocks:
            left[np.searchsorted(rows, blocks[k][1])] += product(blocks[k], z)
        if q is None:
            left = p[mine] - left
            z[rows] = np.divide(1.0, left, out=np.zeros(len(rows)), where=left != 0)
        else:
            z[rows] += p[mine] - q[mine] * left
    return [z[names]]


def _row_sums(kind: str) -> Callable:
    def f(b: Block, _) -> np.ndarray:
        own, v = b[1][_at(b)] == b[3], _values(b)
        v = {"diagonal": lambda: np.where(own, v, 0.0), "l1": lambda: np.where(own, v, np.abs(v)), "abs": lambda: np.abs(v)}[kind]()
        return np.add.reduceat(v, b[2])

    return f


def _choose(b: Block, shared: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """A color for each open row of a block, free among its colored neighbours: the first ones at random, so that few neighbours choose alike."""
    color, turn = shared
    at, open_rows = _at(b), color[b[1]] < 0
    off = (b[1][at] != b[3]) & open_rows[at]
    at, c = at[off], color[b[3][off]]
    still = np.bincount(at[c < 0], minlength=len(b[1]))
    key = np.unique(at[c >= 0].astype(np.int64) << 32 | c[c >= 0])
    row, taken = key >> 32, key & 0xFFFFFFFF
    first = np.searchsorted(row, np.arange(len(b[1])))
    skip = _mixed(b[1].astype(np.int64) * 1000 + turn) % (1 + still // 2)
    below = taken - (np.arange(len(row)) - first[row]) <= skip[row]
    pick = skip + np.bincount(row[below], minlength=len(b[1]))
    return b[1][open_rows], pick[open_rows].astype(np.int32)


def _clashing(b: Block, shared: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows that chose as an open neighbour of higher rank did."""
    pick, color = shared
    at = _at(b)
    r, c = b[1][at], b[3]
    bad = (r != c) & (color[r] < 0) & (color[c] < 0)
    at, r, c = at[bad], r[bad], c[bad]
    same = pick[r] == pick[c]
    at, r, c = at[same], r[same], c[same]
    lower = (_mixed(r) < _mixed(c)) | (_mixed(r) == _mixed(c)) & (r < c)
    return b[1][np.unique(at[lower])]


def _strongest(b: Block, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strongest neighbour of each row among the marked ones, by a tie that is the same from either side; -1 for none.

    ``alone``: 1 for rows that look for a neighbour, 2 for rows that may be found.
    """
    at = _at(b)
    r, c = b[1][at], b[3]
    good = (r != c) & (alone[r] & 1 > 0) & (alone[c] & 2 > 0)
    w = np.where(good, np.abs(_values(b)), -1.0)
    top = np.maximum.reduceat(w, b[2])
    lead = good & (w == top[at])
    tie = np.full(len(c), -1, np.int64)
    tie[lead] = _mixed(_mixed(np.minimum(r[lead], c[lead])) + np.maximum(r[lead], c[lead]))
    lead &= tie == np.maximum.reduceat(tie, b[2])[at]
    best = np.maximum.reduceat(np.where(lead, c, -1), b[2])
    return b[1], best


class BlockSpace(LocalSpace):
    """Vectors are numpy arrays in the driver, the matrix is ``Blocks``."""

    def __init__(self, blocks: Blocks, n: int, symmetric: bool = False, a: SparseMatrix | None = None):
        self.blocks, self.n, self.symmetric, self.a = blocks, n, symmetric, a
        self.kept, self.grid = {}, None
        self.held: list[Blocks] = [blocks]

    @classmethod
    def of(cls, a: SparseMatrix, entries: int, parts: int | None = None) -> BlockSpace:
        return cls(Blocks.of(a.df, parts or cls.parts_for(a.df.sparkSession.sparkContext, entries)), a.shape[0], a.meta.symmetric, a)

    @staticmethod
    def parts_for(context, entries: int) -> int:
        cores = max(1, context.defaultParallelism)
        wanted = -(-entries // ENTRIES)
        return cores if wanted <= cores else -(-wanted // cores) * cores

    def _keep(self, blocks: Blocks) -> Blocks:
        self.held.append(blocks)
        return blocks

    def close(self) -> None:
        for blocks in self.held:
            blocks.close()
        for below in self.kept.get("spaces below", []):
            below.close()

    def mul(self, x: np.ndarray) -> np.ndarray:
        return self.blocks.vector(self.n, _product, x)

    def product(self, m: Blocks, x: np.ndarray) -> np.ndarray:
        return m.vector(self.n, _product, x)

    def diagonal(self) -> np.ndarray:
        return self.once("diagonal", lambda: self.blocks.vector(self.n, _row_sums("diagonal"), None))

    def l1_diagonal(self) -> np.ndarray:
        return self.blocks.vector(self.n, _row_sums("l1"), None)

    def abs_row_sums(self) -> np.ndarray:
        return self.blocks.vector(self.n, _row_sums("abs"), None)

    def neighbours(self) -> Blocks:
        """|a_ij| + |a_ji| off the diagonal; of a symmetric matrix, the matrix itself serves."""
        if self.symmetric:
            return self.blocks
        parts = self.blocks.parts

        def both(b: Block):
            r, c, v = b[1][_at(b)], b[3], np.abs(_values(b))
            off = r != c
            r, c, v = np.concatenate([r[off], c[off]]), np.concatenate([c[off], r[off]]), np.concatenate([v[off], v[off]])
            return _split(_by_hash(r, parts), r, c, v)

        return self.once("neighbours", lambda: self._keep(Blocks(self.blocks.rdd.flatMap(both), parts, tasks=tasks_for(self.blocks.rdd.context, parts))))

    def colors(self) -> tuple[np.ndarray, int]:
        """The color of each row, and how many there are: open rows choose a free color, and where neighbours choose alike the one of higher rank keeps it."""

        def make() -> np.ndarray:
            near, color = self.neighbours(), np.full(self.n, -1, np.int32)
            seen = np.zeros(self.n, bool)
            for rows in near.rows.values():
                seen[rows] = True
            color[~seen] = 0
            turn = 0
            while (color < 0).any():
                pick = np.full(self.n, -1, np.int32)
                for rows, chosen in near.run(_choose, (color, turn)):
                    pick[rows] = chosen
                lost = near.run(_clashing, (pick, color))
                for rows in lost:
                    pick[rows] = -1
                color, turn = np.where(color < 0, pick, color), turn + 1
            return np.unique(color, return_inverse=True)[1].astype(np.int32) if self.n else color

        color = self.once("colors", make)
        return color, int(color.max()) + 1 if len(color) else 0

    def _dealt_by_color(self, m: Blocks) -> tuple[Blocks, list[range]]:
        """A matrix with the rows of each color in blocks of their own, and the numbers of each color's blocks."""
        color, count = self.colors()
        sizes = np.zeros(count)
        for rows in m.rows.values():
            sizes += np.bincount(color[rows], minlength=count)
        share = m.entries / max(1, sizes.sum())
        parts = np.maximum(1, np.ceil(sizes * share / COLOR_ENTRIES)).astype(np.int64)
        ends = np.cumsum(parts)
        sent = m.rdd.context.broadcast(color)

        def deal(b: Block):
            r = b[1][_at(b)]
            k = sent.value[r]
            return _split((ends - parts)[k] + _mixed(r) % parts[k], r, b[3], _values(b))

        return self._keep(Blocks(m.rdd.flatMap(deal), int(ends[-1]) if count else 1)), [range(e - p, e) for e, p in zip(ends.tolist(), parts.tolist())]

    def _by_groups(self, m: Blocks) -> tuple[np.ndarray, list[np.ndarray], Blocks, list[range], Blocks]:
        """Colors in groups: (each color's group, the rows of each; the entries between groups, and the numbers of the blocks that have a group's rows;
        the entries inside of them, a group's in one partition and a color's in one block)."""
        color, count = self.colors()
        context, bins = m.rdd.context, min(count, BINS)
        sent = context.broadcast(color)

        def counted(b: Block) -> np.ndarray:
            at = sent.value.astype(np.int64) * bins // count
            return np.bincount(at[b[1]][_at(b)] * bins + at[b[3]], minlength=bins * bins)

        among = sum(m.rdd.map(counted).toLocalIterator(), np.zeros(bins * bins, np.int64)).reshape(bins, bins)
        ends, start = [], 0
        for k in range(1, bins + 1):
            if k == bins or among[start:k + 1, start:k + 1].sum() > SWEPT:
                ends.append(k)
                start = k
        group = np.searchsorted(ends, np.arange(count) * bins // max(count, 1), "right")
        own = [among[lo:hi, lo:hi].sum() for lo, hi in zip([0, *ends], ends)]
        parts = np.array([self.parts_for(context, int(among[lo:hi].sum() - inside)) for lo, hi, inside in zip([0, *ends], ends, own)] or [1])
        last = np.cumsum(parts)

        def outer(b: Block):
            r, c, v = b[1][_at(b)], b[3], _values(b)
            k, j = group[sent.value[r]], group[sent.value[c]]
            off = k != j
            r, k = r[off], k[off]
            return _split((last - parts)[k] + _mixed(r) % parts[k], r, c[off], v[off])

        def inner(b: Block):
            r, c, v = b[1][_at(b)], b[3], _values(b)
            k = sent.value[r]
            on = group[k] == group[sent.value[c]]
            return _split(k[on], r[on], c[on], v[on])

        between = self._keep(Blocks(m.rdd.flatMap(outer), int(last[-1])))
        inside = self._keep(Blocks(m.rdd.flatMap(inner), max(1, len(ends)), where=lambda k: int(group[k])))
        return group, [np.flatnonzero(group[color] == g).astype(np.int32) for g in range(len(ends))], between, [range(e - n, e) for e, n in zip(last.tolist(), parts.tolist())], inside

    def _sweep(self, m: Blocks, order: Iterable[int], p: np.ndarray, q: np.ndarray | None, product: Callable = _product) -> np.ndarray:
        """z += p - q (A z) on the rows of one color after the other, from zero; without q, z = 1 / (p - A z)."""
        group, rows, between, numbers, inside = self.once(f"groups {id(m)}", lambda: self._by_groups(m))
        color, z, seen = self.colors()[0], np.zeros(self.n), set()
        for g, run in groupby(order, key=lambda k: int(group[k])):
            mine = rows[g]
            image = between.vector(self.n, product, z, numbers[g])[mine] if seen - {g} else np.zeros(len(mine))
            z[mine], = inside.all_at_once(_swept, (list(run), self.n, mine, color[mine], z[mine], p[mine], None if q is None else q[mine], image, product), g)
            seen.add(g)
        return z

    def pivots(self) -> np.ndarray:
        """The inverse of E of DILU: a row's is its diagonal less a_ij a_ji / e_j over the rows of earlier colors."""
        m, product = (self.blocks, _squares) if self.symmetric else (self.mirrored(), _product)
        return self._sweep(m, range(self.colors()[1]), self.diagonal(), None, product)

    def mirrored(self) -> Blocks:
        parts, symmetric = self.blocks.parts, self.symmetric

        def both(b: Block):
            r, c, v = b[1][_at(b)], b[3], _values(b)
            off = r != c
            r, c, v = r[off], c[off], v[off]
            if symmetric:
                return _split(_by_hash(r, parts), r, c, v, np.zeros(len(r), bool)), _split(_by_hash(r, parts), r, c, v, np.ones(len(r), bool))
            return _split(_by_hash(r, parts), r, c, v, np.zeros(len(r), bool)), _split(_by_hash(c, parts), c, r, v, np.ones(len(r), bool))

        return self.once("mirrored", lambda: self._keep(Blocks(self.blocks.rdd.flatMap(lambda b: [x for way in both(b) for x in way]), parts, _both_ways, tasks=tasks_for(self.blocks.rdd.context, parts))))

    def coarse_rows(self, threshold: float) -> np.ndarray:
        """By tables, once; (i, coarse) has a row for each row of the matrix."""
        sp = TableSpace(self.a)
        try:
            got = sp.vector(sp.coarse_rows(threshold)).where("x <> 0").select("i").toPandas()["i"].to_numpy()
        finally:
            sp.close()
        out = np.zeros(self.n)
        out[got] = 1.0
        return out

    def block_inverse(self, k: int) -> Blocks:
        sp = TableSpace(self.a)
        try:
            return self._keep(Blocks.of(sp.block_inverse(k), self.blocks.parts))
        finally:
            sp.close()

    def coarser(self, number: np.ndarray, size: int) -> BlockSpace:
        """P^T A P for aggregates numbered from 0."""
        parts = self.parts_for(self.blocks.rdd.context, self.blocks.entries)
        sent = self.blocks.rdd.context.broadcast(number.astype(np.int32))

        def fold(b: Block):
            to = sent.value
            r, c, v = _summed(to[b[1]][_at(b)], to[b[3]], _values(b))
            return _split(_by_hash(r, parts), r, c, v)

        return BlockSpace(Blocks(self.blocks.rdd.flatMap(fold), parts, tasks=tasks_for(self.blocks.rdd.context, parts)), size, self.symmetric)

    def pairs(self, rounds: int = 3) -> np.ndarray:
        """Aggregate numbers after handshakes among rows still alone; then a row alone joins its strongest neighbour's aggregate."""
        near, lead = self.neighbours(), np.full(self.n, -1, np.int64)

        def best_of(look: np.ndarray, found: np.ndarray) -> np.ndarray:
            out = np.full(self.n, -1, np.int64)
            for rows, best in near.run(_strongest, look.astype(np.int8) + 2 * found.astype(np.int8)):
                out[rows] = best
            return out

        for _ in range(rounds):
            best = best_of(lead < 0, lead < 0)
            i = np.flatnonzero(best >= 0)
            i = i[best[best[i]] == i]
            lead[i] = np.minimum(i, best[i])
        best = best_of(lead < 0, lead >= 0)
        i = np.flatnonzero(best >= 0)
        lead[i] = lead[best[i]]
        lead = np.where(lead < 0, np.arange(self.n), lead)
        return np.unique(lead, return_inverse=True)[1]

    def local(self) -> LocalSpace:
        """The matrix in the driver, for a level that is counted to be small."""
        got = self.blocks.run(lambda b, _: (b[1][_at(b)], b[3], _values(b)), None)
        r, c, v = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0),) * 3
        return LocalSpace(self.n, r, c, v)

    def one_pass(self, order: list[int], p: np.ndarray, q: np.ndarray, factors: tuple[Blocks, list[range]] | None) -> np.ndarray:
        """z += p - q (A z) over the colors in their order; ``factors``: another matrix in A's place."""
        return self._sweep(self.blocks if factors is None else factors[0], order, p, q)

    def incomplete_factors(self) -> tuple[tuple[Blocks, list[range]], np.ndarray]:
        """ILU(0) in the order of the colors: (L without its unit diagonal and U, dealt by color; the diagonal of U).

        The rows of a color are final once those of all earlier colors were eliminated from them, so a round a color
        sends that color's rows of U to all blocks with later rows, which eliminate it and are written anew.
        """
        color, count = self.colors()
        dealt, numbers = self._dealt_by_color(self.blocks)
        context = dealt.rdd.context
        if dealt.entries <= SWEPT:  # one task for all rounds
            sent = context.broadcast(color)
            whole = self._keep(Blocks(dealt.rdd.map(lambda b: (b[0], (b[1][_at(b)], b[3], _values(b)))), 1))
            pieces = whole.rdd.mapPartitions(lambda it: _factored(it, sent.value, count, numbers))
            out = self._keep(Blocks(pieces, dealt.parts))
            return (out, numbers), out.vector(self.n, _row_sums("diagonal"), None)
        colors, sent = context.broadcast(color), []
        state, old = dealt.rdd, None
        for k in range(count - 1):
            rows = context.runJob(state, lambda it, k=k: [_upper(b, colors.value, k) for b in it], [p for p in numbers[k] if p in dealt.rows])
            sent.append(context.broadcast(_stacked(rows)))
            new = state.map(lambda b, k=k, u=sent[-1]: _eliminated(b, colors.value, k, u.value)).persist(StorageLevel.MEMORY_AND_DISK)
            new.count()
            if old is not None:
                old.unpersist()
            state = old = new
        out = object.__new__(Blocks)
        out._take(state, dealt.rows, dealt.entries, dealt.parts)
        self._keep(out)
        return (out, numbers), out.vector(self.n, _row_sums("diagonal"), None)


def _upper(b: Block, color: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of color k: the diagonal and the entries of later colors."""
    r, c = b[1][_at(b)], b[3]
    keep = (r == c) | (color[c] > k)
    return r[keep], c[keep], _values(b)[keep]


def _stacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, where each starts, columns, values), with the diagonal as a first entry."""
    if not rows:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0)
    r, c, v = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((c, r != c, r))
    r, c, v = r[order], c[order], v[order]
    names, start = np.unique(r, return_index=True)
    if (c[start] != names).any() or (v[start] == 0).any():
        raise SolveError("a row has no pivot")
    return names, np.append(start, len(r)), c, v


def _eliminated(b: Block, color: np.ndarray, k: int, upper: tuple) -> Block:
    """A block of later rows after the rows of color k are eliminated, on the pattern alone; other blocks stay."""
    p, rows, start, c, v = b
    if color[rows[0]] <= k:
        return b
    names, first, uc, uv = upper
    at = _at(b)
    mine = np.flatnonzero(color[c] == k)
    if not len(mine):
        return b
    which = np.searchsorted(names, c[mine])
    v = v.astype(np.float64)
    v[mine] = factor = v[mine] / uv[first[which]]
    key = at.astype(np.int64) << 32 | c
    sizes = first[which + 1] - first[which] - 1
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(mine):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PATHS, "right")))
        n = sizes[lo:hi]
        who = np.repeat(np.arange(lo, hi), n)
        j = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[which[lo:hi]] + 1, n)
        wanted = at[mine[who]].astype(np.int64) << 32 | uc[j]
        place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        hit = key[place] == wanted
        np.subtract.at(v, place[hit], factor[who[hit]] * uv[j[hit]])
        lo = hi
    return p, rows, start, c, v


def _factored(it: Iterable[Block], color: np.ndarray, count: int, numbers: list[range]) -> Iterable[tuple[int, tuple]]:
    """The factors of blocks that are all in one task, ready to be dealt out again."""
    blocks = {b[0]: b for b in it}
    for k in range(count):
        mine = [blocks.pop(p) for p in numbers[k] if p in blocks]
        upper = _stacked([_upper(b, color, k) for b in mine])
        for p, b in blocks.items():
            blocks[p] = _eliminated(b, color, k, upper)
        for b in mine:
            yield b[0], (b[1][_at(b)], b[3], _values(b))


class BlockHierarchy:
    """Aggregation multigrid on block spaces; a level that is counted to be small goes on as a local hierarchy in the driver."""

    def __init__(self, sp: BlockSpace, opt: dict):
        from .krylov import RELAXATIONS

        self.opt = opt
        smoother = opt.get("smoother", "BLOCK_JACOBI")
        name, options = (smoother, {}) if isinstance(smoother, str) else (smoother.get("solver", "BLOCK_JACOBI"), smoother)
        self.spaces, self.number, self.smooth = [sp], [], []
        left = int(opt.get("max_levels", 100))
        kept = sp.once("spaces below", list)
        while True:
            fine = self.spaces[-1]
            if fine.n <= int(opt.get("driver_rows", DRIVER_ROWS)) and fine.blocks.entries <= DRIVER_ENTRIES:
                break
            if len(self.spaces) >= left:
                raise ValueError(f"the last of {left} levels has {fine.n} rows and {fine.blocks.entries} entries; levels end below {DRIVER_ROWS} rows and {DRIVER_ENTRIES} entries only")
            number, below = np.arange(fine.n), fine
            for _ in range(pairings(opt)):
                step = below.pairs()
                size = int(step.max()) + 1
                last, below, number = below, below.coarser(step, size), step[number]
                if last is not fine:
                    last.close()
            if size >= fine.n:
                raise ValueError(f"the hierarchy does not get smaller than {fine.n} rows, which are too many for one task")
            kept.append(below)
            self.number.append((number, size))
            self.smooth.append(RELAXATIONS[str(name).upper()](fine, {"block_dim": 1, **options}))
            self.spaces.append(below)
        self.bottom = Hierarchy(self.spaces[-1].local(), {**opt, "max_levels": max(left - len(self.number), 1)})

    def stats(self) -> list[tuple[int, int, int]]:
        own = [(k, s.n, s.blocks.entries) for k, s in enumerate(self.spaces[:-1])]
        return own + [(k + len(own), rows, entries) for k, rows, entries in self.bottom.stats()]

    def cycle(self, r: np.ndarray, level: int = 0, kind: str | None = None) -> np.ndarray:
        kind = kind or str(self.opt.get("cycle", "V")).upper()
        if level == len(self.number):
            return self.bottom.cycle(r, 0, kind)
        sp, smooth = self.spaces[level], self.smooth[level]
        number, size = self.number[level]
        x = None

        def left() -> np.ndarray:
            return r if x is None else r - sp.mul(x)

        for _ in range(int(self.opt.get("presweeps", 1))):
            step = smooth(left())
            x = step if x is None else x + step
        visits = VISITS.get(kind, ["V"])
        if level + 1 == len(self.number) and not self.bottom.p:
            visits = visits[:1]
        for again in visits:
            rest = left()
            step = self.cycle(np.bincount(number, rest, size), level + 1, again)[number]
            if kind in ("CG", "CGF"):  # the step length that minimizes the error along the correction
                below = float(step @ sp.mul(step))
                step = step * (float(step @ rest) / below if below else 1.0)
            x = step if x is None else x + step
        for _ in range(int(self.opt.get("postsweeps", 1))):
            x = x + smooth(left())
        return x


def solution(spark, x: np.ndarray, parts: int) -> DataFrame:
    """A vector in the driver as (i, x), written by the executors."""
    import pyarrow as pa

    sent = spark.sparkContext.broadcast(x)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value[b.column(0).to_numpy()])], names=["i", "x"])

    return spark.range(0, len(x), 1, max(1, min(parts, len(x) // 50_000 + 1))).mapInArrow(run, "i long, x double")
