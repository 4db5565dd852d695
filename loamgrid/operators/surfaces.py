"""Value tables behind maps: variables of a fit, gridded surfaces, bivariate classes, boundaries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import rank_bin
from . import neighbors, statistics

SPECIAL = ("fitted", "residuals", "abs_residuals", "response", "local_r2")


def resolve_variable(fit, name: str) -> str:
    """The variable that a name means: exact, then without case, then ``beta_k``, then a special name."""
    names = fit.names
    if name in names:
        return name
    low = [n for n in names if n.lower() == name.lower()]
    if len(low) > 1:
        raise ValueError(f"{name} could be {', '.join(low)}")
    if low:
        return low[0]
    if name.lower().startswith("beta_") and name[5:].isdigit() and int(name[5:]) < len(names):
        return names[int(name[5:])]
    if name.lower() in SPECIAL:
        return name.lower()
    raise ValueError(f"unknown variable {name}")


def variable(fit, name: str) -> DataFrame:
    """``id, <coords>, value, selected`` of a variable of a fit; rows that aren't finite are left out, three locations must remain."""
    v = resolve_variable(fit, name)
    rows = fit.local.withColumn("_y", F.col("fitted") + F.col("residual"))
    selected = F.lit(True)
    if v in fit.names:
        value = F.element_at("coef", fit.names.index(v) + 1)
        selected = F.abs(value) > 1e-10
    elif v == "local_r2":
        q = fit.local_diagnostics().select(F.col("location").alias("target_id"), F.col("local_r_squared").alias("_r2"))
        rows, value = rows.join(q, "target_id"), F.col("_r2")
    else:
        value = {"fitted": F.col("fitted"), "residuals": F.col("residual"), "abs_residuals": F.abs("residual"), "response": F.col("_y")}[v]
    at = fit.data.select(F.col(fit.key).alias("target_id"), *fit.coords)
    out = rows.join(at, "target_id").select(F.col("target_id").alias("id"), *fit.coords, value.alias("value"), selected.alias("selected"))
    out = out.filter(~F.isnan("value") & (F.abs("value") != float("inf")))
    if out.select(*fit.coords).distinct().limit(3).count() < 3:
        raise ValueError("fewer than three locations have a value")
    return out


def convex_hull(points: DataFrame, x: str, y: str, grow: float = 1.02) -> list[tuple[float, float]]:
    """Hull of the points, widened about its middle.

    Each partition gives the hull of its own points, so the driver sees only corners.
    """
    def corners(p: np.ndarray) -> np.ndarray:
        p = np.unique(p, axis=0)
        if len(p) < 3:
            return p
        chain = []
        for seq in (p, p[::-1]):
            half: list[np.ndarray] = []
            for q in seq:
                while len(half) > 1 and (half[-1][0] - half[-2][0]) * (q[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (q[0] - half[-2][0]) <= 0:
                    half.pop()
                half.append(q)
            chain += half[:-1]
        return np.array(chain)

    def run(frames):
        import pandas as pd

        for f in frames:
            if len(f):
                yield pd.DataFrame(corners(f.to_numpy(float)), columns=["x", "y"])

    got = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).mapInPandas(run, "x double, y double").collect()
    hull = corners(np.array([tuple(r) for r in got], float))
    middle = hull.mean(0)
    return [tuple(map(float, middle + grow * (p - middle))) for p in hull]


def diameter(points: DataFrame, x: str, y: str) -> float:
    """Largest distance between two points: it lies between corners of the hull."""
    hull = np.array(convex_hull(points, x, y, grow=1.0))
    return float(np.sqrt(((hull[:, None] - hull[None]) ** 2).sum(2)).max()) if len(hull) else 0.0


def surface(fit, names: list[str], resolution: int = 50, boundary: list[tuple[float, float]] | None = None, method: str = "gaussian", k: int = 200, extrapolation: float = 3.0, layers: DataFrame | None = None) -> DataFrame:
    """``grid_id, x, y, inside_boundary, value_1 .., nearest_observation_distance, within_extrapolation, interpolation_valid``."""
    if not 25 <= resolution <= 1000:
        raise ValueError("resolution must be from 25 to 1000")
    cx, cy = fit.coords
    tables = [variable(fit, n).select("id", cx, cy, F.col("value").alias(f"value_{i + 1}")) for i, n in enumerate(names)]
    src = tables[0]
    for t in tables[1:]:
        src = src.join(t.drop(cx, cy), "id")
    more = [c for c in layers.columns if c != "id"] if layers is not None else []
    if layers is not None:
        src = src.join(layers, "id")
    values = [*[f"value_{i + 1}" for i in range(len(names))], *more]
    src = statistics.merge_duplicates(src, [cx, cy], values).withColumn("id", F.xxhash64(cx, cy)).persist()
    boundary = boundary or convex_hull(src, cx, cy)
    low, high = np.min(boundary, axis=0), np.max(boundary, axis=0)
    long = max(high - low)
    nx, ny = (max(1, math.ceil(resolution * (high[i] - low[i]) / long)) for i in (0, 1))
    cells = statistics.grid(fit.data.sparkSession, nx, ny, tuple(low), tuple(high)).withColumn("inside_boundary", statistics.inside_ring(F.col("x"), F.col("y"), boundary))
    n = src.count()
    own = statistics.nearest_distances(neighbors.knn(src, min(n, 21), [cx, cy])).first()
    targets = cells.select(F.col("grid_id").alias("id"), F.col("x").alias(cx), F.col("y").alias(cy))
    e = neighbors.knn(src, min(n, k), [cx, cy], targets=targets)
    s = statistics.interpolate(e, src, values, method, own["auto_bandwidth"] or own["typical_nn"])
    near = F.col("nearest_observation_distance") <= extrapolation * own["typical_nn"]
    out = cells.join(s.withColumnRenamed("target_id", "grid_id"), "grid_id").withColumn("within_extrapolation", near)
    return out.withColumn("interpolation_valid", F.col("inside_boundary") & F.col("within_extrapolation") & F.col(values[0]).isNotNull())


def heatmap(fit, name: str, resolution: int = 50, significance: bool = False, threshold: float = 0.5, alpha: float = 0.05, adjust: str = "BH", estimator: str = "auto", **options) -> DataFrame:
    """A variable's surface with its layers of selection and, for coefficients, significance.

    ``selection_support`` and ``significance_support`` are interpolated shares
    of selected and significant locations; a cell has the layer where they
    reach ``threshold``.
    """
    layers = ["selected"]
    v = resolve_variable(fit, name)
    rows = variable(fit, name).withColumn("selected", F.col("selected").cast("double"))
    if significance:
        if v not in fit.names:
            raise ValueError("only coefficients have tests")
        tests = fit.inference(adjust=adjust, estimator=estimator, alpha=alpha).filter(F.col("coefficient") == v)
        rows = rows.join(tests.select(F.col("location").alias("id"), F.coalesce(F.col("significant"), F.lit(False)).cast("double").alias("significant")), "id", "left")
        layers.append("significant")
    out = surface(fit, [name], resolution, layers=rows.select("id", *layers), **options)
    for layer, support in (("selected", "selection_support"), ("significant", "significance_support")):
        if layer in layers:
            out = out.withColumnRenamed(layer, support).withColumn(layer, F.coalesce(F.col(support) >= threshold, F.lit(False)))
    return out if significance else out.withColumn("significant", F.lit(True))


def bivariate(cells: DataFrame, first: str = "value_1", second: str = "value_2", bins: int = 3) -> DataFrame:
    """Quantile bins of two values by average rank, and their class ``(b2 - 1) * bins + b1``."""
    out = rank_bin(rank_bin(cells, first, bins, [], "bin_1"), second, bins, [], "bin_2")
    return out.withColumn("class", (F.col("bin_2") - 1) * bins + F.col("bin_1"))
