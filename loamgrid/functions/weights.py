"""Distance kernels and bandwidths, as columns and as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KERNELS = ("gaussian", "bisquare", "exponential", "tricube", "boxcar")
#: Inflation of an adaptive bandwidth, and the least distance and weight taken as positive.
INFLATE, TINY = 1e-10, 1e-12


def kernel_weight(dist: Column, bandwidth: Column, kernel: str) -> Column:
    """Weight of a distance; 0 where the distance isn't finite or is negative, or the bandwidth isn't positive."""
    r = dist / bandwidth
    inside = {
        "gaussian": F.exp(F.lit(-0.5) * r * r),
        "bisquare": F.when(r < 1, (1 - r * r) * (1 - r * r)).otherwise(0.0),
        "exponential": F.exp(-r),
        "tricube": F.when(r < 1, (1 - r * r * r) * (1 - r * r * r) * (1 - r * r * r)).otherwise(0.0),
        "boxcar": F.when(r <= 1, 1.0).otherwise(0.0),
    }[kernel]
    ok = dist.isNotNull() & ~F.isnan(dist) & (F.abs(dist) != float("inf")) & (dist >= 0) & (bandwidth > 0)
    return F.when(ok, inside).otherwise(0.0)


def kernel_values(r: np.ndarray, kernel: str) -> np.ndarray:
    """The same on ratios of distance to bandwidth."""
    if kernel == "gaussian":
        return np.exp(-0.5 * r * r)
    if kernel == "exponential":
        return np.exp(-r)
    if kernel == "boxcar":
        return (r <= 1).astype(float)
    inner = np.where(r < 1, 1 - r**2 if kernel == "bisquare" else 1 - r**3, 0.0)
    return inner**2 if kernel == "bisquare" else inner**3


def adaptive_bandwidth(furthest: Column) -> Column:
    return F.when(furthest <= TINY, F.lit(1.0)).otherwise(furthest) * (1 + INFLATE)


def weighted_edges(edges: DataFrame, kernel: str, bandwidth: float | None = None) -> DataFrame:
    """Edges with ``bandwidth``, raw weight ``w`` and ``wn``, normalised per target.

    Without a bandwidth each target uses its furthest neighbour's distance.
    ``wn`` is null where a target's weights don't sum to more than 1e-12.
    """
    own = Window.partitionBy("target_id")
    b = adaptive_bandwidth(F.max("dist").over(own)) if bandwidth is None else F.lit(float(bandwidth))
    out = edges.withColumn("bandwidth", b)
    out = out.withColumn("w", kernel_weight(F.col("dist"), F.col("bandwidth"), kernel))
    total = F.sum("w").over(own)
    return out.withColumn("wn", F.when(total > TINY, F.col("w") / total))
