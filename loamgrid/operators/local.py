"""Local models over nearest-neighbour edges.

Edges meet observations once; each target's neighbourhood becomes one row of
arrays (bounded by k), and batches of such rows are solved in Arrow kernels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import solvers
from .solvers import Spec

FIT = (
    "target_id bigint, coef array<double>, fitted double, residual double, converged boolean, iterations int, solver string, "
    "weight_sum double, bandwidth double, objective double, max_kkt_violation double, leverage double, smoother_row_norm2 double, "
    "effective_sample_size double, positive_weights int, condition_number double, local_rank int, map_ss array<double>, "
    "locally_convex boolean, min_hessian double, post_hat double, post_s2 double, post_coef array<double>, post_map_ss array<double>, "
    "primal_residual double, dual_residual double, max_coordinate_gap double, active_coordinates int, knots int, pair_accepted int, block_accepted int, block_checks int"
)
#: Targets solved together: so many, and so many numbers in their predictors.
BATCH, BATCH_CELLS = 512, 1 << 21


def standardisation(data: DataFrame, x: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Centre and population scale of the predictors; constant or non-finite columns are an error."""
    if not x:
        return np.empty(0), np.empty(0)
    bad = sum((F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), 1).otherwise(0) for c in x), F.lit(0))
    row = data.agg(F.coalesce(F.sum(bad), F.lit(0)), *[F.avg(F.col(c).cast("double")) for c in x], *[F.stddev_pop(F.col(c).cast("double")) for c in x]).first()
    if row[0]:
        raise ValueError("predictors must be finite")
    centre, scale = np.array(row[1 : len(x) + 1], float), np.array(row[len(x) + 1 :], float)
    if not (scale > 1e-12).all():
        raise ValueError(f"constant predictors: {[c for c, s in zip(x, scale) if not s > 1e-12]}")
    return centre, scale


def standardised(data: DataFrame, x: list[str], centre: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Each predictor less its centre, by its scale."""
    return data.withColumns({c: (F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(x, centre, scale)})


def neighbourhoods(edges: DataFrame, data: DataFrame, y: str, x: list[str], key: str = "id") -> DataFrame:
    """``target_id, n, source array, dist array, y array, x array`` (row-major), a row per target in rank order."""
    obs = data.select(F.col(key).cast("long").alias("source_id"), F.col(y).cast("double").alias("_y"), F.array(*[F.col(c).cast("double") for c in x]).alias("_x"))
    # Spark takes edges for as many rows as points, and compressed points for less than they are: neither is to be broadcast
    met = edges.join(obs.hint("merge"), "source_id")
    part = F.sort_array(F.collect_list(F.struct("rank", "source_id", "dist", "_y", "_x")))
    out = met.groupBy("target_id").agg(part.alias("_n"))
    return out.select("target_id", F.col("_n.source_id").alias("source"), F.col("_n.dist").alias("dist"), F.col("_n._y").alias("y"), F.flatten("_n._x").alias("x"))


def batches_of(batch: pa.RecordBatch, p: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Equal-sized neighbourhoods of a batch as arrays: rows, target ids, sources, distances, y, x."""
    sizes = np.asarray(pc.list_value_length(batch.column(1)))
    for k in np.unique(sizes):
        rows = np.flatnonzero(sizes == k)
        step = max(1, min(BATCH, BATCH_CELLS // max(1, int(k) * max(p, 1))))
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step]
            part = batch.take(pa.array(own))
            flat = [np.asarray(part.column(c).flatten()) for c in range(1, 5)]
            yield own, np.asarray(part.column(0)), flat[0].reshape(-1, k), flat[1].reshape(-1, k), flat[2].reshape(-1, k), flat[3].reshape(-1, k, p)


def original_scale(level: np.ndarray, beta: np.ndarray, x_mean: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Intercept and slopes for predictors as given."""
    slopes = beta / scale
    return np.concatenate(((level - (beta * x_mean).sum(1) - slopes @ centre)[:, None], slopes), axis=1)


def fit_local(hoods: DataFrame, spec: Spec, centre: np.ndarray, scale: np.ndarray, at: DataFrame | None = None, diagnostics: str = "standard", xs: list[str] | None = None, key: str = "id") -> DataFrame:
    """One fit per neighbourhood.

    Without ``at`` the targets are training points, whose own row is the first
    neighbour; with it, new points whose (already standardised) predictors
    ``xs`` it holds, and nothing that needs an own observation is given.
    """
    p, train, own = len(centre), at is None, hoods
    if at is not None:
        own = hoods.join(at.select(F.col(key).cast("long").alias("target_id"), F.array(*[F.col(c).cast("double") for c in xs]).alias("x0")), "target_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows, ids, source, dist, y, x in batches_of(whole, p):
                f = solvers.solve(dist, x, y, spec)
                m, n = f["m"], len(ids)
                x0 = x[:, 0, :] if train else np.asarray(whole.take(pa.array(rows)).column(5).flatten()).reshape(-1, p)
                coef = original_scale(f["level"], f["beta"], m.x_mean, centre, scale)
                fitted = f["level"] + ((x0 - m.x_mean) * f["beta"]).sum(1)
                nan = np.full(n, np.nan)
                hat, s2, ss, ok, least = nan, nan, None, np.ones(n, bool), nan
                ph, ps, pc, pss = nan, nan, None, None
                if diagnostics != "none" and train and spec.model != "lad":
                    s = solvers.smoother(f, spec, x0, centre / scale if diagnostics == "full" else None)
                    self_ = source == ids[:, None]
                    hat, s2, ok, least = (s["rows"] * self_).sum(1), (s["rows"] ** 2).sum(1), s["convex"], s["least"]
                    if diagnostics == "full":
                        ss = s["squares"]
                        ss[:, 1:] /= scale**2
                        ph, ps, pc, pss = post_selection(f, x0, self_, centre, scale)
                eigen = np.linalg.eigvalsh(m.gram) if p else np.zeros((n, 1))
                cut = np.maximum(1.0, eigen[:, -1]) * 1e-10
                rank = (eigen > cut[:, None]).sum(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cond = np.where(rank < p, np.inf, np.sqrt(eigen[:, -1] / np.where(eigen[:, 0] > 0, eigen[:, 0], np.nan)))
                lists = lambda a: pa.array([None] * n if a is None else list(a), pa.list_(pa.float64()))
                names = [solvers.STATUS[int(v)] if spec.lam == 0 or v or spec.model == "ridge" else ("admm" if spec.model == "lad" else "coordinate_descent") for v in f["status"]]
                with np.errstate(divide="ignore"):
                    ess = 1 / (m.w**2).sum(1)
                cols = [
                    pa.array(ids, pa.int64()), lists(coef), fitted, (y[:, 0] - fitted) if train else nan, pa.array(f["converged"]), pa.array(f["iterations"], pa.int32()), pa.array(names),
                    m.total, m.bandwidth, f["objective"], f["kkt"], hat, s2, ess, pa.array((m.w > 1e-12).sum(1), pa.int32()), cond, pa.array(rank, pa.int32()), lists(ss),
                    pa.array(ok), least, ph, ps, lists(pc), lists(pss),
                    f.get("primal", nan), f.get("dual", nan), f.get("gap", nan), pa.array((np.abs(f["beta"]) > 1e-10).sum(1), pa.int32()), pa.array(solvers.knots(f["beta"], spec), pa.int32()),
                    *[pa.array(f["helps"][:, c] if "helps" in f else [None] * n, pa.int32()) for c in range(3)],
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.float64()) for c in cols], names=[part.strip().split()[0] for part in FIT.split(", ")])

    return own.mapInArrow(run, FIT)


def post_selection(f: dict, x0: np.ndarray, self_: np.ndarray, centre: np.ndarray, scale: np.ndarray):
    """Unpenalised weighted fits on each target's active set: hat values, row norms, coefficients, squared maps."""
    m, beta = f["m"], f["beta"]
    n, k, p = m.xc.shape
    hat, s2, coef, ss = np.full(n, np.nan), np.full(n, np.nan), np.full((n, p + 1), np.nan), np.full((n, p + 1), np.nan)
    for at, a in solvers.active_groups(beta, m.valid & np.isfinite(beta).all(1), False):
        inverse = solvers.pseudo(m.gram[np.ix_(at, a, a)]) if len(a) else np.zeros((len(at), 0, 0))
        maps = inverse @ (m.w[at][:, :, None] * m.xc[np.ix_(at, np.arange(k), a)]).transpose(0, 2, 1)
        b = np.zeros((len(at), p))
        b[:, a] = (inverse @ m.score[np.ix_(at, a)][:, :, None])[:, :, 0]
        row = m.w[at] + np.einsum("ba,bak->bk", (x0 - m.x_mean)[np.ix_(at, a)], maps)
        hat[at], s2[at] = (row * self_[at]).sum(1), (row**2).sum(1)
        coef[at] = original_scale(m.y_mean[at], b, m.x_mean[at], centre, scale)
        ss[at] = 0.0
        ss[at, 0] = ((m.w[at] - np.einsum("ba,bak->bk", (m.x_mean + centre / scale)[np.ix_(at, a)], maps)) ** 2).sum(1)
        ss[np.ix_(at, a + 1)] = (maps**2).sum(2) / scale[a] ** 2
    return hat, s2, coef, ss


PATH = "target_id bigint, lambda_idx int, lambda double, coef array<double>, fitted double, residual double, converged boolean, iterations int, max_kkt_violation double, leverage double, smoother_row_norm2 double"


def fit_path(hoods: DataFrame, spec: Spec, lambdas: np.ndarray, centre: np.ndarray, scale: np.ndarray, at: DataFrame | None = None, xs: list[str] | None = None, key: str = "id") -> DataFrame:
    """Fits along decreasing lambdas, warm-started inside each target; a row per target and lambda.

    Moments are taken once a target.  The path starts at zero slopes.
    """
    p, train, own = len(centre), at is None, hoods
    if at is not None:
        own = hoods.join(at.select(F.col(key).cast("long").alias("target_id"), F.array(*[F.col(c).cast("double") for c in xs]).alias("x0")), "target_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows, ids, source, dist, y, x in batches_of(whole, p):
                start, n = np.zeros((len(ids), p)), len(ids)
                x0 = x[:, 0, :] if train else np.asarray(whole.take(pa.array(rows)).column(5).flatten()).reshape(-1, p)
                for k, lam in enumerate(lambdas):
                    now = replace(spec, lam=float(lam))
                    f = solvers.solve(dist, x, y, now, start)
                    m = f["m"]
                    start = np.where(np.isfinite(f["beta"]), f["beta"], 0)
                    fitted = f["level"] + ((x0 - m.x_mean) * f["beta"]).sum(1)
                    hat = s2 = np.full(n, np.nan)
                    if train:
                        s = solvers.smoother(f, now, x0)
                        hat, s2 = (s["rows"] * (source == ids[:, None])).sum(1), (s["rows"] ** 2).sum(1)
                    coef = original_scale(f["level"], f["beta"], m.x_mean, centre, scale)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(np.full(n, k), pa.int32()), pa.array(np.full(n, lam)), pa.array(list(coef), pa.list_(pa.float64())), pa.array(fitted), pa.array(y[:, 0] - fitted if train else np.full(n, np.nan)),
                         pa.array(f["converged"]), pa.array(f["iterations"], pa.int32()), pa.array(f["kkt"]), pa.array(hat), pa.array(s2)],
                        names=[part.strip().split()[0] for part in PATH.split(", ")],
                    )

    return own.mapInArrow(run, PATH)


def predict_at(hoods: DataFrame, spec: Spec, ks: list[int], at: DataFrame, xs: list[str], key: str = "id") -> DataFrame:
    """``target_id, k, fitted`` at new points for several numbers of neighbours, in one pass."""
    own = hoods.join(at.select(F.col(key).cast("long").alias("target_id"), F.array(*[F.col(c).cast("double") for c in xs]).alias("x0")), "target_id")
    p = len(xs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows, ids, _, dist, y, x in batches_of(whole, p):
                x0 = np.asarray(whole.take(pa.array(rows)).column(5).flatten()).reshape(-1, p)
                for k in ks:
                    f = solvers.solve(dist[:, :k], x[:, :k], y[:, :k], spec)
                    fitted = f["level"] + ((x0 - f["m"].x_mean) * f["beta"]).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), k, np.int32)), pa.array(fitted)], names=["target_id", "k", "fitted"])

    return own.mapInArrow(run, "target_id bigint, k int, fitted double")


def lambda_max(hoods: DataFrame, spec: Spec, p: int) -> float:
    """The least lambda at which every target's slopes are zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for _, _, _, dist, y, x in batches_of(whole, p):
                m = solvers.moments(dist, x, y, spec)
                top = solvers.nonconvex_lambda_max(m, spec) if spec.model in ("scad", "mcp") else solvers.lambda_max(m, spec.alpha)
                yield pa.RecordBatch.from_arrays([pa.array(top)], names=["top"])

    return float(hoods.mapInArrow(run, "top double").agg(F.max("top")).first()[0] or 0.0)
