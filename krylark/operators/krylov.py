"""Krylov methods and relaxations over a space of vectors.

Every method has the form ``method(sp, b, x, stop, m, opt) -> x``: ``m`` maps a residual to a correction (or is None),
``stop`` records residual norms and says when to end.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np

from ..model import SolveError, Status


class Stop:
    """Convergence by the configured criterion; ``history[0]`` is the initial residual."""

    def __init__(self, criterion: str = "RELATIVE_INI", tolerance: float = 1e-6, max_iters: int = 1000, alternative: float | None = None, norm: str = "L2"):
        self.kind = criterion.upper().removesuffix("_CORE")
        if self.kind not in ("ABSOLUTE", "RELATIVE_INI", "RELATIVE_MAX", "COMBINED_REL_INI_ABS"):
            raise ValueError(f"unknown convergence criterion {criterion!r}")
        self.tol, self.max_iters = float(tolerance), int(max_iters)
        self.other = self.tol if alternative is None else float(alternative)
        self.history: list[float] = []
        self.status = Status.NOT_CONVERGED

    def met(self, r: float) -> bool:
        first = self.history[0]
        return {
            "ABSOLUTE": r <= self.tol,
            "RELATIVE_INI": r <= self.tol * first,
            "RELATIVE_MAX": r <= self.tol * max(self.history),
            "COMBINED_REL_INI_ABS": r <= self.tol or r <= self.other * first,
        }[self.kind]

    def done(self, rr: float) -> bool:
        """Takes a squared residual norm; true when the iteration is to end."""
        r = math.sqrt(rr) if rr >= 0 else math.nan
        self.history.append(r)
        if not math.isfinite(r):
            self.status = Status.DIVERGED
            return True
        if r == 0 or self.met(r):
            self.status = Status.SUCCESS
            return True
        return len(self.history) > self.max_iters

    @property
    def iterations(self) -> int:
        return len(self.history) - 1

    def info(self) -> dict[str, Any]:
        return {"iterations": self.iterations, "residual": self.history[-1] if self.history else math.nan, "status": self.status, "residual_history": list(self.history)}


def _start(sp, b, x, stop):
    r = sp.lin((1.0, b), (-1.0, sp.mul(x)))
    rr, = sp.dots((r, r))
    return r, rr, stop.done(rr)


def cg(sp, b, x, stop, m=None, opt=None, flexible=False):
    """Conjugate gradients, preconditioned if ``m`` is given; ``flexible`` lets m change from step to step."""
    r, rr, ended = _start(sp, b, x, stop)
    z = m(r) if m else r
    p, (rz,) = z, sp.dots((r, z))
    while not ended:
        q = sp.mul(p)
        pq, = sp.dots((p, q))
        if pq == 0 or not math.isfinite(pq):
            stop.status = Status.DIVERGED
            break
        alpha = rz / pq
        x = sp.lin((1.0, x), (alpha, p))
        last, r = r, sp.lin((1.0, r), (-alpha, q))
        z = m(r) if m else r
        rr, new, cross = sp.dots((r, r), (r, z), (last, z))
        if ended := stop.done(rr):
            break
        beta = (new - cross) / rz if flexible else new / rz
        p, rz = sp.lin((1.0, z), (beta, p)), new
        sp.forget(q, last)
    return x


def flexible_cg(sp, b, x, stop, m=None, opt=None):
    return cg(sp, b, x, stop, m, opt, flexible=True)


def bicgstab(sp, b, x, stop, m=None, opt=None):
    """Stabilized bi-conjugate gradients; on a breakdown it restarts from the true residual."""
    r, rr, ended = _start(sp, b, x, stop)
    shadow, p, rho = r, r, rr
    while not ended:
        ph = m(p) if m else p
        v = sp.mul(ph)
        sv, = sp.dots((shadow, v))
        if sv == 0:
            r = sp.lin((1.0, b), (-1.0, sp.mul(x)))
            shadow, p = r, r
            rr, = sp.dots((r, r))
            rho = rr
            ended = stop.done(rr)
            continue
        alpha = rho / sv
        s = sp.lin((1.0, r), (-alpha, v))
        sh = m(s) if m else s
        t = sp.mul(sh)
        tt, ts = sp.dots((t, t), (t, s))
        omega = ts / tt if tt else 0.0
        x = sp.lin((1.0, x), (alpha, ph), (omega, sh))
        r = sp.lin((1.0, s), (-omega, t))
        rr, new = sp.dots((r, r), (shadow, r))
        ended = stop.done(rr)
        if ended:
            break
        if omega == 0 or rho == 0 or abs(new) < 1e-30 * max(rr, 1e-300):
            shadow, p, rho = r, r, rr
            continue
        beta = new / rho * alpha / omega
        p, rho = sp.lin((1.0, r), (beta, p), (-beta * omega, v)), new
    return x


def gmres(sp, b, x, stop, m=None, opt=None):
    """Restarted flexible GMRES: classical Gram-Schmidt twice, so that all products of a step share a reduction."""
    restart = int((opt or {}).get("gmres_n_restart", 20))
    r, rr, ended = _start(sp, b, x, stop)
    while not ended:
        beta = math.sqrt(rr)
        basis, moved, columns, turns = [sp.lin((1 / beta, r))], [], [], []
        g = [beta]
        for k in range(restart):
            z = m(basis[k]) if m else basis[k]
            moved.append(z)
            w = sp.mul(z)
            h = np.zeros(k + 1)
            for _ in range(2):
                part = np.array(sp.dots(*[(v, w) for v in basis]))
                w = sp.lin((1.0, w), *[(-c, v) for c, v in zip(part, basis)])
                h += part
            ww, = sp.dots((w, w))
            column = [*h, math.sqrt(max(ww, 0.0))]
            for i, (c, s) in enumerate(turns):
                column[i], column[i + 1] = c * column[i] + s * column[i + 1], -s * column[i] + c * column[i + 1]
            d = math.hypot(column[k], column[k + 1])
            c, s = (1.0, 0.0) if d == 0 else (column[k] / d, column[k + 1] / d)
            turns.append((c, s))
            below = column[k + 1]
            column[k], column[k + 1] = d, 0.0
            g.append(-s * g[k])
            g[k] = c * g[k]
            columns.append(column[:k + 1])
            ended = stop.done(g[k + 1] ** 2)
            if ended or below == 0:
                break
            basis.append(sp.lin((1 / math.sqrt(ww), w)))
        size = len(columns)
        upper = np.zeros((size, size))
        for j, column in enumerate(columns):
            upper[:j + 1, j] = column
        y = np.linalg.lstsq(upper, np.array(g[:size]), rcond=None)[0]
        x = sp.lin((1.0, x), *[(float(c), z) for c, z in zip(y, moved)])
        if not ended:
            r = sp.lin((1.0, b), (-1.0, sp.mul(x)))
            rr, = sp.dots((r, r))
            if rr == 0:
                stop.status = Status.SUCCESS
                break
    return x


def idr(sp, b, x, stop, m=None, opt=None, fused=False):
    """IDR(s) with s shadow vectors (``subspace_dim_s``, 4).

    ``fused``: all inner products of a step with the shadow vectors share one reduction; what they become as the step is
    made orthogonal is worked out from them.
    """
    s = int((opt or {}).get("subspace_dim_s", 4))
    r, rr, ended = _start(sp, b, x, stop)
    shadow = [sp.random(k + 1) for k in range(s)]
    g, u = [sp.zero() for _ in range(s)], [sp.zero() for _ in range(s)]
    big = np.eye(s)
    omega = 1.0
    while not ended:
        f = np.array(sp.dots(*[(p, r) for p in shadow]))
        for k in range(s):
            try:
                c = np.linalg.solve(big[k:, k:], f[k:])
            except np.linalg.LinAlgError:
                stop.status = Status.DIVERGED
                return x
            v = sp.lin((1.0, r), *[(-c[i - k], g[i]) for i in range(k, s)])
            v = m(v) if m else v
            new = sp.lin((omega, v), *[(c[i - k], u[i]) for i in range(k, s)])
            image = sp.mul(new)
            if fused:
                tops = np.array(sp.dots(*[(p, image) for p in shadow]))
                turned = [(i, np.linalg.solve(big[:k, :k], tops[:k])[i]) for i in range(k)]
                image, new = (sp.lin((1.0, y), *[(-a, old[i]) for i, a in turned]) for y, old in ((image, g), (new, u)))
                big[k:, k] = tops[k:] - sum((a * big[k:, i] for i, a in turned), np.zeros(s - k))
            else:
                for i in range(k):
                    top, = sp.dots((shadow[i], image))
                    a = top / big[i, i]
                    image, new = sp.lin((1.0, image), (-a, g[i])), sp.lin((1.0, new), (-a, u[i]))
                big[k:, k] = sp.dots(*[(shadow[i], image) for i in range(k, s)])
            g[k], u[k] = image, new
            if big[k, k] == 0:
                stop.status = Status.DIVERGED
                return x
            beta = f[k] / big[k, k]
            r, x = sp.lin((1.0, r), (-beta, image)), sp.lin((1.0, x), (beta, new))
            rr, = sp.dots((r, r))
            if ended := stop.done(rr):
                return x
            f[k + 1:] -= beta * big[k + 1:, k]
        v = m(r) if m else r
        t = sp.mul(v)
        tt, tr = sp.dots((t, t), (t, r))
        omega = tr / tt if tt else 0.0
        if omega == 0:
            stop.status = Status.DIVERGED
            return x
        x, r = sp.lin((1.0, x), (omega, v)), sp.lin((1.0, r), (-omega, t))
        rr, = sp.dots((r, r))
        ended = stop.done(rr)
    return x


def idr_fused(sp, b, x, stop, m=None, opt=None):
    return idr(sp, b, x, stop, m, opt, fused=True)


def preconditioned_richardson(sp, b, x, stop, m=None, opt=None):
    """x += M r until the residual is small: how a relaxation or a multigrid cycle runs as a solver."""
    r, rr, ended = _start(sp, b, x, stop)
    while not ended:
        x = sp.lin((1.0, x), (1.0, m(r) if m else r))
        r = sp.lin((1.0, b), (-1.0, sp.mul(x)))
        rr, = sp.dots((r, r))
        ended = stop.done(rr)
    return x


# Relaxations: ``make(sp, opt) -> (r -> correction)``


def block_jacobi(sp, opt) -> Callable:
    """Point Jacobi; with block_dim k the k by k diagonal blocks are inverted."""
    omega, k = float(opt.get("relaxation_factor", 0.9)), int(opt.get("block_dim", 1))
    if k > 1:
        if sp.n % k:
            raise ValueError(f"{sp.n} rows do not divide into blocks of {k}")
        inverse = sp.block_inverse(k)
        return lambda r: sp.lin((omega, sp.product(inverse, r)))
    d = sp.inverse(sp.diagonal())
    return lambda r: sp.lin((omega, sp.times(d, r)))


def jacobi_l1(sp, opt) -> Callable:
    omega, d = float(opt.get("relaxation_factor", 1.0)), sp.inverse(sp.l1_diagonal())
    return lambda r: sp.lin((omega, sp.times(d, r)))


def _polynomial(sp, d, lo: float, hi: float, order: int) -> Callable:
    """The Chebyshev polynomial of the Jacobi-scaled matrix (``d``: its inverse diagonal) for eigenvalues from lo to hi."""
    theta, delta = (hi + lo) / 2, (hi - lo) / 2

    def apply(r):
        sigma = theta / delta
        rho = 1 / sigma
        step = sp.lin((1 / theta, sp.times(d, r)))
        z = step
        for _ in range(order - 1):
            left = sp.lin((1.0, r), (-1.0, sp.mul(z)))
            new = 1 / (2 * sigma - rho)
            step = sp.lin((new * rho, step), (2 * new / delta, sp.times(d, left)))
            z, rho = sp.lin((1.0, z), (1.0, step)), new
        return z

    return apply


def chebyshev(sp, opt) -> Callable:
    """A polynomial of degree ``chebyshev_polynomial_order`` in the Jacobi-scaled matrix; no inner products at all: Gershgorin's bound is the largest eigenvalue."""
    d = sp.inverse(sp.diagonal())
    hi = sp.largest(sp.times(d, sp.abs_row_sums()))
    return _polynomial(sp, d, hi * float(opt.get("cheby_min_ratio", 1 / 30)), hi, int(opt.get("chebyshev_polynomial_order", 5)))


def chebyshev_smoother(sp, opt) -> Callable:
    """The polynomial as a smoother: the largest eigenvalue is estimated by power steps, and only the upper part of the spectrum is damped."""
    d = sp.inverse(sp.diagonal())
    v, top = sp.random(1), 1.0
    for _ in range(int(opt.get("power_steps", 10))):
        size = math.sqrt(sp.dots((v, v))[0])
        w = sp.times(d, sp.mul(sp.lin((1 / size if size else 0.0, v))))
        top, v = math.sqrt(sp.dots((w, w))[0]), w
    hi = 1.1 * (top or 1.0)
    return _polynomial(sp, d, hi / float(opt.get("eigenvalue_ratio", 8)), hi, int(opt.get("chebyshev_polynomial_order", 5)))


def colors_of(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Colors of the rows so that no two that share an entry have the same: greedy by rounds of local maxima of a hash."""
    off = r != c
    u, v = np.concatenate([r[off], c[off]]), np.concatenate([c[off], r[off]])
    weight = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    weight ^= weight >> np.uint64(29)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), weight))] = np.arange(n)
    color = np.full(n, -1)
    for k in range(n):
        free = color < 0
        if not free.any():
            break
        live = free[u] & free[v]
        top = np.full(n, -1)
        np.maximum.at(top, u[live], rank[v[live]])
        color[free & (rank > top)] = k
    return color


def swept(sp, color, order, p, q, factors=None):
    """z += p - q (A z) from zero, on the rows of one color after the other; ``factors``: a block space's own matrix in A's place."""
    if hasattr(sp, "one_pass"):
        return sp.one_pass(order, p, q, factors)
    z = None
    for k in order:
        image = None if z is None else sp.mul_on(color, k, z)
        step = sp.only(color, k, p if image is None else sp.lin((1.0, p), (-1.0, sp.times(q, image))))
        z = step if z is None else sp.lin((1.0, z), (1.0, step))
    return sp.zero() if z is None else z


def multicolor_gs(sp, opt) -> Callable:
    """Gauss-Seidel in the order of the colors; ``symmetric`` sweeps back again."""
    omega = float(opt.get("relaxation_factor", 1.0))
    color, n_colors = sp.colors()
    d = sp.lin((omega, sp.inverse(sp.diagonal())))
    order = list(range(n_colors))
    if opt.get("symmetric_GS"):
        order += order[::-1]
    return lambda r: swept(sp, color, order, sp.times(d, r), d)


def multicolor_dilu(sp, opt) -> Callable:
    """(E + L) E^-1 (E + U) with the triangles of the color order and E chosen so that the diagonals agree.

    A product with A on the rows of a color is one with a triangle as long as the vector is zero on that color and the later
    (or the earlier) ones, so both sweeps need no other matrix.
    """
    omega = float(opt.get("relaxation_factor", 1.0))
    color, n_colors = sp.colors()
    if hasattr(sp, "pivots"):
        inv = sp.pivots()
    else:
        mirrored, e = sp.mirrored(), sp.diagonal()
        for k in range(1, n_colors):
            e = sp.lin((1.0, e), (-1.0, sp.only(color, k, sp.product_on(mirrored, color, k, sp.before(color, k, sp.inverse(e))))))
        inv = sp.inverse(e)
    order = list(range(n_colors))

    def apply(r):
        y = swept(sp, color, order, sp.times(inv, r), inv)
        return sp.lin((omega, swept(sp, color, order[::-1], y, inv)))

    return apply


def multicolor_ilu(sp, opt) -> Callable:
    """ILU(0) in the order of the colors."""
    omega = float(opt.get("relaxation_factor", 1.0))
    if hasattr(sp, "incomplete_factors"):
        return _colored_factors(sp, omega)
    color = colors_of(sp.n, sp.r, sp.c)
    order = np.lexsort((np.arange(sp.n), color))
    place = np.empty(sp.n, np.int64)
    place[order] = np.arange(sp.n)
    rows: list[dict[int, float]] = [{} for _ in range(sp.n)]
    for i, j, v in zip(place[sp.r].tolist(), place[sp.c].tolist(), sp.v.tolist()):
        rows[i][j] = v
    for i in range(sp.n):
        row = rows[i]
        for k in sorted(j for j in row if j < i):
            factor = row[k] = row[k] / rows[k][k]
            for j, v in rows[k].items():
                if j > k and j in row:
                    row[j] -= factor * v

    def apply(r):
        y = np.asarray(r)[order].copy()
        for i in range(sp.n):
            y[i] -= sum(v * y[j] for j, v in rows[i].items() if j < i)
        for i in reversed(range(sp.n)):
            y[i] = (y[i] - sum(v * y[j] for j, v in rows[i].items() if j > i)) / rows[i][i]
        return omega * y[place]

    return apply


def _colored_factors(sp, omega: float) -> Callable:
    """The same sweeps where rows are dealt by color: a vector that is zero on a color and the later ones meets L alone, and U in the other direction."""
    color, n_colors = sp.colors()
    factors, diagonal = sp.incomplete_factors()
    inv, order = sp.inverse(diagonal), list(range(n_colors))

    def apply(r):
        y = swept(sp, color, order, r, np.ones(sp.n), factors)
        return omega * swept(sp, color, order[::-1], inv * y, inv, factors)

    return apply


def cf_jacobi(sp, opt) -> Callable:
    """Jacobi on the coarse points, then on the fine ones."""
    omega = float(opt.get("relaxation_factor", 0.9))
    coarse = sp.coarse_rows(float(opt.get("strength_threshold", 0.5)))
    d = sp.inverse(sp.diagonal())

    def apply(r):
        z = sp.lin((omega, sp.times(coarse, sp.times(d, r))))
        step = sp.lin((omega, sp.times(d, sp.lin((1.0, r), (-1.0, sp.mul(z))))))
        return sp.lin((1.0, z), (1.0, step), (-1.0, sp.times(coarse, step)))

    return apply


def dense_lu(sp, opt=None) -> Callable:
    a = sp.dense()

    def apply(r):
        try:
            return np.linalg.solve(a, r)
        except np.linalg.LinAlgError as e:
            raise SolveError(f"dense factorization failed: {e}") from e

    return apply


def nosolver(sp, opt=None) -> Callable:
    return lambda r: r


KRYLOV = {"CG": cg, "PCG": cg, "PCGF": flexible_cg, "BICGSTAB": bicgstab, "PBICGSTAB": bicgstab, "GMRES": gmres, "FGMRES": gmres, "IDR": idr, "IDRMSYNC": idr_fused}
#: Methods that take no preconditioner.
PLAIN = {"CG", "BICGSTAB"}
RELAXATIONS = {
    "BLOCK_JACOBI": block_jacobi, "JACOBI_L1": jacobi_l1, "GS": multicolor_gs, "MULTICOLOR_GS": multicolor_gs, "MULTICOLOR_DILU": multicolor_dilu, "MULTICOLOR_ILU": multicolor_ilu,
    "CHEBYSHEV": chebyshev, "CHEBYSHEV_POLY": chebyshev_smoother, "CF_JACOBI": cf_jacobi, "DENSE_LU_SOLVER": dense_lu, "NOSOLVER": nosolver,
}
#: What does not run on tables: the factors of the one need a row's neighbours in order (blocks of colors have them), the other is dense.
LOCAL_ONLY = {"MULTICOLOR_ILU", "DENSE_LU_SOLVER"}
