"""Batched solvers of local regressions: arrays of (targets, neighbours, predictors).

Weights of a target are normalised to one; the loss is half the weighted sum
of squares, so a penalty means the same everywhere.  Everything is solved for
a batch of targets at once, with a mask of those not yet converged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.penalties import exact_minimum, penalty_curvature, penalty_slope, penalty_value, soft
from ..functions.weights import INFLATE, TINY, kernel_values

#: Status codes of a solve, fixed values.
STATUS = {0: "direct_solve", 1: "pseudoinverse", 2: "failed_solve", 3: "zero_weights", 4: "invalid_neighbor"}


@dataclass(frozen=True)
class Spec:
    """What is fitted at each target."""

    model: str = "gwr"
    lam: float = 0.0
    alpha: float = 1.0
    d: float = 0.0
    gamma: float = 3.7
    kernel: str = "bisquare"
    bandwidth: float | None = None
    tolerance: float = 1e-7
    max_iterations: int = 1000
    guarded: bool = False


@dataclass
class Moments:
    """Weighted moments of a batch."""

    w: np.ndarray
    total: np.ndarray
    bandwidth: np.ndarray
    y_mean: np.ndarray
    x_mean: np.ndarray
    xc: np.ndarray
    yc: np.ndarray
    gram: np.ndarray
    score: np.ndarray
    valid: np.ndarray


def moments(dist: np.ndarray, x: np.ndarray, y: np.ndarray, spec: Spec) -> Moments:
    far = np.where(np.isfinite(dist), dist, 0).max(1)
    b = np.where(far <= TINY, 1.0, far) * (1 + INFLATE) if spec.bandwidth is None else np.full(len(dist), spec.bandwidth)
    with np.errstate(invalid="ignore"):
        w = np.where(np.isfinite(dist) & (dist >= 0), kernel_values(dist / b[:, None], spec.kernel), 0.0)
    total = w.sum(1)
    valid = np.isfinite(total) & (total > TINY)
    w = np.where(valid[:, None], w / np.where(valid, total, 1)[:, None], 0.0)
    y_mean, x_mean = (w * y).sum(1), np.einsum("bk,bkp->bp", w, x)
    xc, yc = x - x_mean[:, None, :], y - y_mean[:, None]
    wx = w[:, :, None] * xc
    return Moments(w, total, b, y_mean, x_mean, xc, yc, np.einsum("bkp,bkq->bpq", wx, xc), np.einsum("bkp,bk->bp", wx, yc), valid)


def direct(gram: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions and status codes: Cholesky where it works, else the pseudoinverse.

    A batch without any singular system is factorised at once.
    """
    beta, status = np.zeros_like(score), np.zeros(len(score), int)
    if not score.shape[1]:
        return beta, status
    try:
        low = np.linalg.cholesky(gram)
        if (np.einsum("bpp->bp", low).min(1) ** 2 > np.maximum(1.0, np.abs(gram).sum(2).max(1)) * 1e-15).all():
            half = np.linalg.solve(low, score[:, :, None])
            return np.linalg.solve(low.transpose(0, 2, 1), half)[:, :, 0], status
    except np.linalg.LinAlgError:
        pass
    for i in range(len(score)):
        try:
            low = np.linalg.cholesky(gram[i])
            if low.diagonal().min() ** 2 <= max(1.0, np.abs(gram[i]).sum(1).max()) * 1e-15:
                raise np.linalg.LinAlgError
            beta[i] = np.linalg.solve(low.T, np.linalg.solve(low, score[i]))
        except np.linalg.LinAlgError:
            beta[i] = pseudo(gram[i]) @ score[i]
            status[i] = 1
    return beta, status


def pseudo(g: np.ndarray) -> np.ndarray:
    """Pseudoinverses of symmetric matrices, one or a batch."""
    values, vectors = np.linalg.eigh(g)
    cut = np.maximum(1.0, np.abs(g).sum(-2).max(-1, initial=0))[..., None] * 1e-10
    inverse = np.where(values > cut, 1 / np.where(values > cut, values, 1), 0)
    return (vectors * inverse[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def coordinate_descent(m: Moments, spec: Spec, pilot: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, iterations and convergence of the lasso family, SCAD or MCP."""
    convex = spec.model not in ("scad", "mcp")
    l1, l2 = spec.lam * spec.alpha, spec.lam * (1 - spec.alpha)
    beta = start.copy()
    g = np.einsum("bpp->bp", m.gram)
    n, p = beta.shape
    iterations, open_ = np.zeros(n, int), m.valid.copy()
    for _ in range(spec.max_iterations):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        b, moved = beta[at], np.zeros(len(at))
        gram, score, gg = m.gram[at], m.score[at], g[at]
        for j in range(p):
            z = score[:, j] - np.einsum("bp,bp->b", gram[:, j, :], b) + gg[:, j] * b[:, j]
            ok = gg[:, j] > 1e-12
            if convex:
                new = np.where(ok, soft(z + l2 * spec.d * pilot[at, j], l1) / (np.where(ok, gg[:, j], 1) + l2), 0.0)
            else:
                new = np.where(ok, exact_minimum(z, np.where(ok, gg[:, j], 1), spec.lam, spec.gamma, spec.model), 0.0)
            moved = np.maximum(moved, np.abs(new - b[:, j]))
            b[:, j] = new
        beta[at] = b
        iterations[at] += 1
        open_[at] = moved > spec.tolerance * (1 + np.abs(b).max(1, initial=0))
    return beta, iterations, m.valid & ~open_


def quadratic(gram: np.ndarray, score: np.ndarray, b: np.ndarray, spec: Spec) -> float:
    """Objective of a SCAD or MCP target, less its constant."""
    return float(0.5 * b @ gram @ b - score @ b + penalty_value(b, spec.lam, spec.gamma, spec.model).sum())


def coordinate_gaps(m: Moments, beta: np.ndarray, spec: Spec) -> np.ndarray:
    """Most that one exact coordinate step could still lower each target's SCAD or MCP objective."""
    diag = np.einsum("bpp->bp", m.gram)
    ok = diag > 1e-12
    g = np.where(ok, diag, 1)
    z = m.score - np.einsum("bpq,bq->bp", m.gram, beta) + diag * beta
    value = lambda b: 0.5 * g * b * b - z * b + penalty_value(b, spec.lam, spec.gamma, spec.model)
    gap = value(beta) - value(exact_minimum(z, g, spec.lam, spec.gamma, spec.model))
    return np.where(ok, np.maximum(gap, 0), 0).max(1, initial=0)


#: Fixed values of the guarded solver: sweeps between helps, coordinates looked at for a pair, least correlation of a pair, sizes of a flat-tail block, least fall of the objective in units of its rounding.
GUARD_EVERY, GUARD_PAIR_OF, GUARD_CORRELATION, GUARD_BLOCK, GUARD_FALL = 5, 8, 0.99, (3, 32), 64


def pair_minimum(g: np.ndarray, z: np.ndarray, spec: Spec) -> np.ndarray:
    """Exact minimiser of a two-coordinate problem.

    Either both coordinates are inside pieces of the penalty, where the
    objective is one quadratic and its stationary point counts if it lies there,
    or one sits at a knot and the other is its exact one-dimensional minimum.
    """
    lam, top = spec.lam, spec.gamma * spec.lam
    knots = [0.0, top, -top] if spec.model == "mcp" else [0.0, lam, -lam, top, -top]
    cuts = sorted([*knots, -np.inf, np.inf])
    pieces = []
    for lo, hi in zip(cuts, cuts[1:]):
        t = np.clip((max(lo, -2 * top) + min(hi, 2 * top)) / 2, -2 * top, 2 * top)
        curve = float(penalty_curvature(np.array([t]), lam, spec.gamma, spec.model)[0])
        slope = float(np.sign(t) * penalty_slope(np.array([t]), lam, spec.gamma, spec.model)[0]) - curve * t
        pieces.append((lo, hi, curve, slope))
    found = [np.zeros(2)]
    for a in pieces:
        for b in pieces:
            h = g + np.diag([a[2], b[2]])
            if np.linalg.det(h) > 1e-14 and h[0, 0] > 0:
                v = np.linalg.solve(h, z - np.array([a[3], b[3]]))
                if a[0] <= v[0] <= a[1] and b[0] <= v[1] <= b[1]:
                    found.append(v)
    for k in knots:
        for i in (0, 1):
            o = 1 - i
            if g[o, o] > 1e-12:
                v = np.empty(2)
                v[i], v[o] = k, exact_minimum(np.array([z[o] - g[o, i] * k]), np.array([g[o, o]]), lam, spec.gamma, spec.model)[0]
                found.append(v)
    return min(found, key=lambda v: (quadratic(g, z, v, spec), np.abs(v).sum()))


def guarded_descent(m: Moments, spec: Spec, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coordinate descent for SCAD and MCP with two helps where it stalls.

    After every fifth sweep and when sweeps stop moving, the most correlated
    pair among the eight coordinates that moved most is solved exactly, and
    then all coordinates on the flat tail are solved as one block.  Either step
    is kept only if the objective truly falls.  The last array counts, for each
    target, accepted pairs, accepted blocks and blocks tried.
    """
    beta, n = start.copy(), len(start)
    iterations, converged = np.zeros(n, int), np.zeros(n, bool)
    helps = np.zeros((n, 3), int)
    for i in np.flatnonzero(m.valid):
        g, z, b = m.gram[i], m.score[i], beta[i]
        diag = g.diagonal()
        for sweep in range(1, spec.max_iterations + 1):
            before = b.copy()
            for j in range(len(b)):
                r = z[j] - g[j] @ b + diag[j] * b[j]
                b[j] = exact_minimum(np.array([r]), np.array([diag[j]]), spec.lam, spec.gamma, spec.model)[0] if diag[j] > 1e-12 else 0.0
            moved = np.abs(b - before)
            still = moved.max(initial=0) <= spec.tolerance * (1 + np.abs(b).max(initial=0))
            helped = False
            if still or sweep % GUARD_EVERY == 0:
                value = quadratic(g, z, b, spec)
                top = np.argsort(-moved, kind="stable")[:GUARD_PAIR_OF]
                pairs = [(abs(g[p, q]) / np.sqrt(diag[p] * diag[q]), p, q) for k, p in enumerate(top) for q in top[:k] if diag[p] > 1e-12 and diag[q] > 1e-12]
                trials = []
                if pairs and (best := max(pairs))[0] >= GUARD_CORRELATION:
                    at = np.array(best[1:])
                    rest = np.setdiff1d(np.arange(len(b)), at)
                    trials.append((0, at, pair_minimum(g[np.ix_(at, at)], z[at] - g[np.ix_(at, rest)] @ b[rest], spec)))
                flat = np.flatnonzero(np.abs(b) >= spec.gamma * spec.lam)
                if GUARD_BLOCK[0] <= len(flat) <= GUARD_BLOCK[1]:
                    rest = np.setdiff1d(np.arange(len(b)), flat)
                    trials.append((1, flat, np.linalg.lstsq(g[np.ix_(flat, flat)], z[flat] - g[np.ix_(flat, rest)] @ b[rest], rcond=None)[0]))
                    helps[i, 2] += 1
                for kind, at, v in trials:
                    new = b.copy()
                    new[at] = v
                    if (now := quadratic(g, z, new, spec)) < value - GUARD_FALL * np.finfo(float).eps * (1 + abs(value)):
                        helped |= bool(np.abs(new - b).max() > spec.tolerance * (1 + np.abs(b).max()))
                        b[:], value = new, now
                        helps[i, kind] += 1
            if still and not helped:
                converged[i] = True
                break
        iterations[i] = sweep
    return beta, iterations, converged, helps


def absolute_deviations(m: Moments, x: np.ndarray, y: np.ndarray, spec: Spec, pilot: np.ndarray, rho: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted least absolute deviations with the scaled lasso penalty, by splitting residuals and coefficients (ADMM).

    Returns (intercept and slopes), iterations, convergence, and the last primal and dual residuals.
    """
    n, k, p = x.shape
    l1, l2 = spec.lam * spec.alpha, spec.lam * (1 - spec.alpha)
    z = np.concatenate((np.ones((n, k, 1)), m.xc), axis=2)
    penal = np.diag(np.r_[0.0, np.ones(p)])
    inverse = np.linalg.inv(rho * np.einsum("bkp,bkq->bpq", z, z) + rho * penal + 1e-12 * np.eye(p + 1))
    theta = np.concatenate((m.y_mean[:, None], pilot), axis=1)
    r = y - np.einsum("bkp,bp->bk", z, theta)
    c, u, v = pilot.copy(), np.zeros((n, k)), np.zeros((n, p))
    iterations, done = np.zeros(n, int), ~m.valid
    primal, dual = np.zeros(n), np.zeros(n)
    for _ in range(spec.max_iterations):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        za = z[at]
        rhs = rho * np.einsum("bkp,bk->bp", za, y[at] - r[at] + u[at])
        rhs[:, 1:] += rho * (c[at] - v[at])
        t = np.einsum("bpq,bq->bp", inverse[at], rhs)
        fit = np.einsum("bkp,bp->bk", za, t)
        r_new = soft(y[at] - fit + u[at], m.w[at] / rho)
        q = t[:, 1:] + v[at]
        c_new = soft(rho * q + l2 * spec.d * pilot[at], l1) / (rho + l2)
        e1, e2 = y[at] - fit - r_new, t[:, 1:] - c_new
        s1, s2 = rho * np.einsum("bkp,bk->bp", za, r_new - r[at]), rho * (c_new - c[at])
        s1[:, 1:] -= s2
        u[at], v[at], r[at], c[at], theta[at] = u[at] + e1, v[at] + e2, r_new, c_new, t
        scale = 1 + np.maximum(np.abs(y[at]).max(1), np.abs(t).max(1))
        primal[at] = np.sqrt((e1**2).mean(1) + (e2**2).mean(1) if p else (e1**2).mean(1))
        dual[at] = np.abs(s1).max(1)
        iterations[at] += 1
        done[at] = (primal[at] <= spec.tolerance * scale) & (dual[at] <= spec.tolerance * scale)
    slopes = np.where(np.abs(c) > 0, theta[:, 1:], 0.0) if l1 > 0 else theta[:, 1:]
    return np.concatenate((theta[:, :1], slopes), axis=1), iterations, done & m.valid, primal, dual


def ridge(m: Moments, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """Ridge slopes and status codes: Cholesky of p equations, or of k where there are more predictors than neighbours.

    A system without a factor fails; nothing is added to it and no pseudoinverse replaces it.
    """
    n, k, p = m.xc.shape
    half = np.sqrt(m.w)[:, :, None] * m.xc
    dual = p > k
    system = np.einsum("bkp,bjp->bkj", half, half) if dual else m.gram
    system = system + lam * np.eye(system.shape[1])
    right = np.sqrt(m.w) * m.yc if dual else m.score
    out, status = np.full(right.shape, np.nan), np.zeros(n, int)

    def solved(at) -> np.ndarray:
        low = np.linalg.cholesky(system[at])
        return np.linalg.solve(np.swapaxes(low, -1, -2), np.linalg.solve(low, right[at][..., None]))[..., 0]

    at = np.flatnonzero(m.valid)
    try:
        out[at] = solved(at)
    except np.linalg.LinAlgError:
        for i in at:
            try:
                out[i] = solved(i)
            except np.linalg.LinAlgError:
                status[i] = 2
    return (np.einsum("bkp,bk->bp", half, out) if dual else out), status


def solve(dist: np.ndarray, x: np.ndarray, y: np.ndarray, spec: Spec, start: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Local fit of a batch on standardised predictors: slopes, level at the weighted mean, and the audit."""
    m = moments(dist, x, y, spec)
    n, p = m.score.shape
    l1, l2 = spec.lam * spec.alpha, spec.lam * (1 - spec.alpha)
    out = {"m": m, "level": m.y_mean.copy(), "iterations": np.zeros(n, int)}
    if spec.model == "ridge":
        beta, status = ridge(m, spec.lam)
        converged = status == 0
        l1, l2 = 0.0, spec.lam
    elif spec.model in ("scad", "mcp"):
        first = np.zeros((n, p)) if start is None else start
        if spec.guarded:
            beta, out["iterations"], converged, out["helps"] = guarded_descent(m, spec, first)
        else:
            beta, out["iterations"], converged = coordinate_descent(m, spec, np.zeros((n, p)), first)
        status = np.zeros(n, int)
    else:
        beta, status = direct(m.gram, m.score)
        converged = np.ones(n, bool)
        pilot = beta
        if spec.model == "lad":
            both, out["iterations"], converged, out["primal"], out["dual"] = absolute_deviations(m, x, y, spec, pilot)
            out["level"], beta = both[:, 0], both[:, 1:]
        elif spec.lam > 0:
            beta, out["iterations"], converged = coordinate_descent(m, spec, pilot, pilot if start is None else start)
        out["pilot"] = pilot
    bad = ~m.valid
    status = np.where(bad, 3, status)
    beta = np.where(bad[:, None], np.nan, beta)
    out["level"] = np.where(bad, np.nan, out["level"])
    gradient = m.score - np.einsum("bpq,bq->bp", m.gram, beta)
    residual = m.yc - np.einsum("bkp,bp->bk", m.xc, beta)
    loss = 0.5 * (m.w * residual**2).sum(1)
    if spec.model in ("scad", "mcp"):
        out["objective"] = loss + penalty_value(beta, spec.lam, spec.gamma, spec.model).sum(1)
        # a sweep may move little far from a minimum: a coordinate must also have next to nothing left to gain
        out["gap"] = coordinate_gaps(m, beta, spec)
        converged = converged & (out["gap"] <= 10 * spec.tolerance * (1 + np.abs(out["objective"])))
        pull = gradient - np.sign(beta) * penalty_slope(beta, spec.lam, spec.gamma, spec.model)
        out["kkt"] = np.where(np.abs(beta) > 0, np.abs(pull), np.maximum(np.abs(gradient) - spec.lam, 0)).max(1, initial=0)
    else:
        base = out.get("pilot", np.zeros_like(beta)) * spec.d
        gradient = gradient - l2 * (beta - base)
        if spec.model == "lad":
            r = y - out["level"][:, None] - np.einsum("bkp,bp->bk", m.xc, beta)
            loss = (m.w * np.abs(r)).sum(1)
        out["objective"] = loss + l1 * np.abs(beta).sum(1) + 0.5 * l2 * ((beta - base) ** 2).sum(1)
        if spec.model == "lad":
            # there is no gradient where a residual is zero: the split's own residuals say how far it got
            out["kkt"] = np.maximum(out["primal"], out["dual"])
        else:
            out["kkt"] = np.where(np.abs(beta) > 0, np.abs(gradient - l1 * np.sign(beta)), np.maximum(np.abs(gradient) - l1, 0)).max(1, initial=0)
    return out | {"beta": beta, "status": status, "converged": converged & m.valid & (status < 2)}


def active_groups(beta: np.ndarray, good: np.ndarray, all_: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(targets, active predictors) of each active set among the ``good`` targets."""
    at = np.flatnonzero(good)
    if not len(at):
        return []
    active = np.ones((len(at), beta.shape[1]), bool) if all_ else np.abs(beta[at]) > 1e-10
    sets, own = np.unique(active, axis=0, return_inverse=True)
    own = own.reshape(-1)
    return [(at[own == s], np.flatnonzero(sets[s])) for s in range(len(sets))]


def smoother(fit: dict[str, np.ndarray], spec: Spec, x0: np.ndarray, centre: np.ndarray | None = None, keep_maps: bool = False) -> dict[str, np.ndarray]:
    """Rows of the smoother at ``x0``; with ``centre`` (in units of the scale) also the squared coefficient maps, or the maps themselves.

    Targets of one active set are solved together.
    """
    m, beta = fit["m"], fit["beta"]
    n, k, p = m.xc.shape
    rows, squares = np.full((n, k), np.nan), np.full((n, p + 1), np.nan)
    kept = np.zeros((n, k, p + 1)) if keep_maps else None
    convex, least = np.zeros(n, bool), np.full(n, np.nan)
    l2 = spec.lam if spec.model == "ridge" else spec.lam * (1 - spec.alpha)
    whole = spec.model in ("gwr", "ridge") or spec.lam == 0
    for at, active in active_groups(beta, m.valid & np.isfinite(beta).all(1), whole):
        if not len(active):
            rows[at], convex[at], squares[at] = m.w[at], True, 0.0
            if centre is not None:
                squares[at, 0] = (m.w[at] ** 2).sum(1)
            if keep_maps:
                kept[at, :, 0] = m.w[at]
            continue
        h = m.gram[np.ix_(at, active, active)]
        right = (m.w[at][:, :, None] * m.xc[np.ix_(at, np.arange(k), active)]).transpose(0, 2, 1)
        own = np.arange(len(active))
        if spec.model in ("scad", "mcp"):
            h[:, own, own] += penalty_curvature(beta[np.ix_(at, active)], spec.lam, spec.gamma, spec.model)
        elif spec.lam > 0 and l2:
            h[:, own, own] += l2
            if spec.d and spec.model != "ridge":
                full = (m.w[at][:, :, None] * m.xc[at]).transpose(0, 2, 1)
                right = right + l2 * spec.d * (pseudo(m.gram[at]) @ full)[:, active]
        values = np.linalg.eigvalsh(h)
        top = np.maximum(1.0, values[:, -1])
        least[at], convex[at] = values[:, 0], values[:, 0] > top * 1e-10
        fine = values[:, 0] > top * 1e-12
        maps = np.empty_like(right)
        maps[fine] = np.linalg.solve(h[fine], right[fine])
        if not fine.all():
            maps[~fine] = pseudo(h[~fine]) @ right[~fine]
        rows[at] = m.w[at] + np.einsum("ba,bak->bk", (x0 - m.x_mean)[np.ix_(at, active)], maps)
        if centre is not None:
            squares[at] = 0.0
            squares[np.ix_(at, active + 1)] = (maps**2).sum(2)
            level = m.w[at] - np.einsum("ba,bak->bk", (m.x_mean + centre)[np.ix_(at, active)], maps)
            squares[at, 0] = (level**2).sum(1)
            if keep_maps:
                kept[at, :, 0] = level
                kept[np.ix_(at, np.arange(k), active + 1)] = maps.transpose(0, 2, 1)
    return {"rows": rows, "squares": squares, "convex": convex, "least": least, "maps": kept}


def knots(beta: np.ndarray, spec: Spec) -> np.ndarray:
    """How many coefficients of each target lie on a knot of the SCAD or MCP penalty, where its slope has a kink."""
    if spec.model not in ("scad", "mcp") or not spec.lam:
        return np.zeros(len(beta), int)
    at = [spec.gamma * spec.lam] if spec.model == "mcp" else [spec.lam, spec.gamma * spec.lam]
    slack = 1e-8 * (1 + spec.gamma * spec.lam)
    return sum((np.abs(np.abs(beta) - k) <= slack).sum(1) for k in at)


def lambda_max(m: Moments, alpha: float) -> np.ndarray:
    """Least lambda at which all slopes of the lasso family are zero, per target."""
    return np.abs(m.score).max(1, initial=0) / alpha


def nonconvex_lambda_max(m: Moments, spec: Spec) -> np.ndarray:
    """Least lambda (by bisection) at which zero is each coordinate's exact minimum, per target."""
    g, z = np.einsum("bpp->bp", m.gram), np.abs(m.score)
    ok = g > 1e-12
    low, high = np.zeros_like(z), np.maximum(z, 1e-300)

    def zero(lam: np.ndarray) -> np.ndarray:
        return ~ok | (exact_minimum(z, np.where(ok, g, 1), lam, spec.gamma, spec.model) == 0)

    for _ in range(64):
        good = zero(high)
        if good.all():
            break
        high = np.where(good, high, 2 * high)
    for _ in range(80):
        middle = (low + high) / 2
        good = zero(middle)
        low, high = np.where(good, low, middle), np.where(good, middle, high)
    return np.where(ok, high, 0).max(1, initial=0) * (1 + 1e-10)


def lambda_path(top: float, count: int = 50, ratio: float = 1e-3) -> np.ndarray:
    """Log-spaced from ``top`` down to ``top * ratio``."""
    if top <= TINY or count == 1:
        return np.array([top])
    return top * ratio ** (np.arange(count) / (count - 1))
