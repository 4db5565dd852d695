"""Simulation studies: data by seeded hashes, oracle fits, retries, fold caches, certificates and progress."""

from __future__ import annotations

import json
import math
import os
import time

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import local, neighbors, solvers
from . import workflow


def uniform(seed: int, stream: str, *keys: str) -> Column:
    """A uniform number in (0, 1) that depends on seed, stream and keys alone, so partitions don't matter."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *keys), 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, stream: str, *keys: str) -> Column:
    """A standard normal number by the Box-Muller transform."""
    return F.sqrt(-2 * F.log(uniform(seed, stream + "r", *keys))) * F.cos(2 * math.pi * uniform(seed, stream + "a", *keys))


def wendland(d: Column, radius: float) -> Column:
    """A smooth bump of compact support: one at its middle, zero from ``radius`` on."""
    r = F.least(d / radius, F.lit(1.0))
    return F.pow(1 - r, 4) * (4 * r + 1)


def simulate(spark: SparkSession, n: int, p: int, seed: int, scenario: str = "smooth", layout: str = "uniform", rho: float = 0.5, snr: float = 4.0) -> DataFrame:
    """``id, cx, cy, x1.., truth array, y``.

    Layouts: uniform, clustered, l_shape.  Scenarios: smooth (coefficients
    drift), regional (the second acts in one region), stationary, null,
    collinear (predictors correlate with ``rho`` near one corner).
    """
    df = spark.range(n)
    u, v = uniform(seed, "u", "id"), uniform(seed, "v", "id")
    if layout == "clustered":
        c = F.floor(uniform(seed, "c", "id") * 4)
        u, v = F.pmod(c % 2 * 0.5 + 0.25 + 0.08 * normal(seed, "cu", "id"), F.lit(1.0)), F.pmod(F.floor(c / 2) * 0.5 + 0.25 + 0.08 * normal(seed, "cv", "id"), F.lit(1.0))
    elif layout == "l_shape":
        side = uniform(seed, "l", "id") < 2 / 3
        u, v = F.when(side, u).otherwise(u / 2), F.when(side, v / 2).otherwise(0.5 + v / 2)
    elif layout != "uniform":
        raise ValueError(layout)
    df = df.withColumn("cx", u).withColumn("cy", v)
    link = F.lit(rho) * wendland(F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2), 0.8) if scenario == "collinear" else F.lit(0.0)
    for j in range(1, p + 1):
        z = normal(seed, f"x{j}", "id")
        df = df.withColumn(f"x{j}", z if j == 1 else link * F.col(f"x{j - 1}") + F.sqrt(1 - link * link) * z)
    near = wendland(F.sqrt((F.col("cx") - 0.7) ** 2 + (F.col("cy") - 0.7) ** 2), 0.4)
    first = {"smooth": 1 + F.col("cx"), "collinear": 1 + F.col("cx"), "regional": F.lit(1.0), "stationary": F.lit(1.0), "null": F.lit(0.0)}[scenario]
    second = {"smooth": F.sin(math.pi * F.col("cy")), "collinear": F.lit(0.0), "regional": 2 * near, "stationary": F.lit(-0.5), "null": F.lit(0.0)}[scenario]
    beta = [first, second, *[F.lit(0.0)] * (p - 2)][:p]
    df = df.withColumn("truth", F.array(*[b.cast("double") for b in beta]))
    df = df.withColumn("_s", sum((F.element_at("truth", j + 1) * F.col(f"x{j + 1}") for j in range(p)), F.lit(0.0)))
    spread = df.agg(F.stddev_pop("_s")).first()[0] or 0.0
    return df.withColumn("y", F.col("_s") + (spread / math.sqrt(snr) or 1.0) * normal(seed, "e", "id")).drop("_s")


def oracle_union(data: DataFrame, y: str, truth: str, x: list[str], coords: list[str], k: int, key: str = "id", **options) -> workflow.Fit:
    """The unpenalised model on the predictors that are active somewhere."""
    used = data.agg(*[F.max(F.abs(F.element_at(truth, j + 1))).alias(c) for j, c in enumerate(x)]).first()
    names = [c for c in x if (used[c] or 0) > 0]
    if not names:
        raise ValueError("no predictor is active anywhere")
    return workflow.fit(data, y, names, coords, k, key=key, **options)


def oracle_local(data: DataFrame, y: str, truth: str, x: list[str], coords: list[str], k: int, key: str = "id", **options) -> DataFrame:
    """Unpenalised fits of each location on the predictors that are active there: ``target_id, support, coef, fitted, residual``.

    ``truth`` is the array of true slopes.  Targets of one support in a batch
    are solved together; coefficients that aren't in it are zero.
    """
    spec = workflow.spec_of("gwr", **options)
    centre, scale = local.standardisation(data, x)
    hoods = local.neighbourhoods(neighbors.knn(data, k, coords, key), local.standardised(data, x, centre, scale), y, x, key)
    active = data.select(F.col(key).cast("long").alias("target_id"), F.transform(F.col(truth), lambda v: (F.abs(v) > 0)).alias("on"))
    p = len(x)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for rows, ids, _, dist, xs, z in local.batches_of(whole, p):
                on = np.asarray(whole.take(pa.array(rows)).column(5).flatten()).reshape(-1, p).astype(bool)
                kinds, own = np.unique(on, axis=0, return_inverse=True)
                for c, kind in enumerate(kinds):
                    at, cols = np.flatnonzero(own.reshape(-1) == c), np.flatnonzero(kind)
                    f = solvers.solve(dist[at], z[np.ix_(at, np.arange(z.shape[1]), cols)], xs[at], spec)
                    beta = np.zeros((len(at), p))
                    beta[:, cols] = f["beta"]
                    mean = np.zeros((len(at), p))
                    mean[:, cols] = f["m"].x_mean
                    coef = local.original_scale(f["level"], beta, mean, centre, scale)
                    fitted = f["level"] + ((z[at, 0] - mean) * beta).sum(1)
                    name = "".join("1" if b else "0" for b in kind)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array([name] * len(at)), pa.array(list(coef), pa.list_(pa.float64())), pa.array(fitted), pa.array(xs[at, 0] - fitted)], names=["target_id", "support", "coef", "fitted", "residual"])

    return hoods.join(active, "target_id").mapInArrow(run, "target_id bigint, support string, coef array<double>, fitted double, residual double")


def fold_cache(data: DataFrame, x: list[str], coords: list[str], k: int, fold: str, key: str = "id") -> dict:
    """Per fold: training scale and cross-fold edges, kept for reuse; no response enters."""
    out = {}
    for (f,) in data.select(fold).distinct().orderBy(fold).collect():
        train, test = data.filter(F.col(fold) != f), data.filter(F.col(fold) == f)
        centre, scale = local.standardisation(train, x)
        out[f] = {"centre": centre, "scale": scale, "edges": neighbors.knn(train, k, coords, key, test).persist()}
    return out


def path_with_retry(data: DataFrame, *args, caps: tuple[int, ...] = (1000, 5000, 20_000), **options) -> tuple[DataFrame, int]:
    """A path run again with more iterations until every target converges; the rows and the cap that did."""
    for cap in caps:
        rows = workflow.path(data, *args, max_iterations=cap, **options).persist()
        if rows.filter(~F.col("converged")).isEmpty():
            break
    return rows, cap


def duality_gap(gram: np.ndarray, score: np.ndarray, yy: float, beta: np.ndarray, lam: float, alpha: float = 1.0) -> float:
    """Gap between primal and dual objective of one target's lasso or elastic net.

    ``yy`` is the weighted sum of squares of the centred response.  The dual
    point is the residual, shrunk until it is feasible for the lasso of the
    data augmented by the ridge part.
    """
    l1, l2 = lam * alpha, lam * (1 - alpha)
    g = gram + l2 * np.eye(len(beta))
    quad = beta @ g @ beta
    rr = max(yy - 2 * beta @ score + quad, 0.0)
    primal = 0.5 * rr + l1 * np.abs(beta).sum()
    top = np.abs(score - g @ beta).max(initial=0)
    s = min(1.0, l1 / top) if top > 0 else 1.0
    return float(primal - (s * (yy - beta @ score) - 0.5 * s * s * rr))


def kkt_gap(dist: np.ndarray, x: np.ndarray, y: np.ndarray, spec: solvers.Spec) -> np.ndarray:
    """Duality gap of every target of a batch."""
    f = solvers.solve(dist, x, y, spec)
    m = f["m"]
    return np.array([duality_gap(m.gram[i], m.score[i], float((m.w[i] * m.yc[i] ** 2).sum()), f["beta"][i], spec.lam, spec.alpha) for i in range(len(dist))])


def progress(path: str, done: int, total: int, began: float) -> dict:
    """Write counts, rate and time left as JSON, by a new file that replaces the old one."""
    rate = done / max(time.time() - began, 1e-9)
    state = {"done": done, "total": total, "per_second": rate, "seconds_left": (total - done) / rate if rate else None, "at": time.time()}
    with open(f"{path}.part", "w") as f:
        json.dump(state, f)
    os.replace(f"{path}.part", path)
    return state


def bivariate_palette(bins: int, corners: tuple[str, str, str, str] = ("#e8e8e8", "#be64ac", "#5ac8c8", "#3b4994")) -> list[str]:
    """Colours of ``bins * bins`` classes, mixed bilinearly from four corners (low-low, high-low, low-high, high-high)."""
    rgb = [np.array([int(c[i : i + 2], 16) for i in (1, 3, 5)], float) for c in corners]
    out = []
    for b in range(bins):
        for a in range(bins):
            u, v = a / max(bins - 1, 1), b / max(bins - 1, 1)
            mix = (1 - u) * (1 - v) * rgb[0] + u * (1 - v) * rgb[1] + (1 - u) * v * rgb[2] + u * v * rgb[3]
            out.append("#" + "".join(f"{round(float(c)):02x}" for c in mix))
    return out
