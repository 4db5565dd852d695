"""Diagnostics and summaries as aggregates over fits, edges and observations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def inf() -> Column:
    return F.lit(float("inf"))


def nan() -> Column:
    return F.lit(float("nan"))



# --- of a fit -------------------------------------------------------------

def local_fit_quality(weighted: DataFrame, observed: DataFrame, y: str = "y", fitted: str = "fitted", key: str = "id") -> DataFrame:
    """Per target: local R2 from each neighbour's own fit, weighted RMSE and MAE, effective size, positive weights.

    ``weighted`` are edges with ``wn``; ``observed`` has id, observed and fitted value.
    """
    o = observed.select(F.col(key).alias("source_id"), F.col(y).cast("double").alias("_y"), F.col(fitted).cast("double").alias("_f"))
    e = weighted.join(o.hint("merge"), "source_id")  # else Spark may broadcast the edges
    mean = F.sum(F.col("wn") * F.col("_y")).over(Window.partitionBy("target_id"))
    e = e.withColumn("_m", mean)
    a = e.groupBy("target_id").agg(
        F.sum(F.col("wn") * (F.col("_y") - F.col("_f")) ** 2).alias("_rss"), F.sum(F.col("wn") * (F.col("_y") - F.col("_m")) ** 2).alias("_tss"),
        F.sum(F.col("wn") * F.abs(F.col("_y") - F.col("_f"))).alias("local_mae"), (1 / F.sum(F.col("wn") ** 2)).alias("effective_sample_size"),
        F.count_if(F.col("wn") > 1e-12).cast("int").alias("positive_weights"),
    )
    return a.select("target_id", F.when(F.col("_tss") > 0, 1 - F.col("_rss") / F.col("_tss")).otherwise(nan()).alias("local_r_squared"), F.sqrt("_rss").alias("local_rmse"), "local_mae", "effective_sample_size", "positive_weights")


def smoother_diagnostics(rows: DataFrame, y: str = "y", residual: str = "residual", hat: str = "leverage", s2: str = "smoother_row_norm2", by: list[str] | None = None) -> DataFrame:
    """The global scalars of a linear smoother, one row (or one per group).

    NaN stands for undefined, infinity for a criterion that its own
    denominator rules out.
    """
    e, h = F.col(residual), F.col(hat)
    by = by or []
    a = rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(e * e).alias("rss"), (F.var_pop(y) * F.count(F.lit(1))).alias("tss"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        F.sum(h).alias("trS"), F.sum(s2).alias("trStS"), F.bool_and(~F.isnan(1 - h) & (F.abs(1 - h) > 1e-10)).alias("_loo"), F.sum((e / F.when(F.abs(1 - h) > 1e-10, 1 - h)) ** 2).alias("_cv"),
    )
    n, rss, tss, tr = F.col("n"), F.col("rss"), F.col("tss"), F.col("trS")
    a = a.withColumn("rmse", F.sqrt(rss / n)).withColumn("r_squared", F.when(tss > 0, 1 - rss / tss).otherwise(nan()))
    a = a.withColumn("enp", 2 * tr - F.col("trStS")).withColumn("edf", n - F.col("enp"))
    a = a.withColumn("adjusted_r_squared", F.when(~F.isnan("r_squared") & (F.col("edf") > 0), 1 - (1 - F.col("r_squared")) * (n - 1) / F.col("edf")).otherwise(nan()))
    a = a.withColumn("sigma2", F.when(F.col("edf") > 2.220446049250313e-16, rss / F.col("edf")).otherwise(nan()))
    a = a.withColumn("deviance", n * (F.log(F.greatest(rss, F.lit(2.2250738585072014e-308)) / n) + math.log(2 * math.pi) + 1)).withColumn("logLik", -0.5 * F.col("deviance"))
    a = a.withColumn("model_df", tr + 1).withColumn("aic", F.col("deviance") + 2 * F.col("model_df"))
    a = a.withColumn("aicc", F.when(n - tr - 2 > 0, F.col("deviance") + 2 * n * F.col("model_df") / (n - tr - 2)).otherwise(inf()))
    a = a.withColumn("bic", F.col("deviance") + F.log(n) * F.col("model_df")).withColumn("gcv", F.when(1 - tr / n > 0, rss / n / (1 - tr / n) ** 2).otherwise(inf()))
    a = a.withColumn("loo_cv", F.when(F.col("_loo"), F.col("_cv")).otherwise(inf()))
    names = ["n", "rss", "tss", "rmse", "mae", "bias", "r_squared", "adjusted_r_squared", "trS", "trStS", "enp", "edf", "sigma2", "deviance", "logLik", "model_df", "aic", "aicc", "bic", "gcv", "loo_cv"]
    return a.select(*by, *names)


def coefficient_summary(coefs: DataFrame, names: list[str], coef: str = "coef") -> DataFrame:
    """Mean, sd, quartiles and share of zeros of each coefficient."""
    long = coefs.select(F.posexplode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("c"), F.col(coef).alias("v"))).alias("i", "s")).select("i", F.col("s.c").alias("coefficient"), F.col("s.v").alias("v"))
    q = lambda p: F.percentile("v", F.lit(p))
    return long.groupBy("coefficient").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max("v").alias("max"),
        F.avg(F.when(F.abs("v") <= 1e-10, 1.0).otherwise(0.0)).alias("zero_fraction"),
    )


def path_criteria(path: DataFrame, p: int, ebic_gamma: float = 0.5) -> DataFrame:
    """Per lambda: sparsity, convergence, all smoother scalars and the extended BIC.

    The extended BIC counts the coordinates that are active anywhere on the surface.
    """
    slopes = F.slice("coef", 2, max(p, 1))
    active = path.select("lambda_idx", F.posexplode(slopes).alias("j", "b")).groupBy("lambda_idx", "j").agg(F.max((F.abs("b") > 1e-10).cast("int")).alias("a"))
    size = active.groupBy("lambda_idx").agg(F.sum("a").alias("surface_size"))
    about = path.groupBy("lambda_idx").agg(
        F.first("lambda").alias("lambda"), F.avg(F.size(F.filter(slopes, lambda b: F.abs(b) > 1e-10)).cast("double")).alias("mean_nonzero"), F.avg("iterations").alias("mean_iterations"),
        F.avg(F.col("converged").cast("double")).alias("convergence_rate"), F.max("max_kkt_violation").alias("max_kkt_violation"),
    )
    every = smoother_diagnostics(path.withColumn("y", F.col("fitted") + F.col("residual")), by=["lambda_idx"])
    choose = [math.lgamma(p + 1) - math.lgamma(s + 1) - math.lgamma(p - s + 1) for s in range(p + 1)]
    ebic = F.col("bic") + 2 * ebic_gamma * F.element_at(F.array(*[F.lit(c) for c in choose]), F.col("surface_size").cast("int") + 1)
    return about.join(size, "lambda_idx", "left").join(every, "lambda_idx").withColumn("ebic", ebic)


# --- spatial autocorrelation ----------------------------------------------

def spatial_weights(edges: DataFrame, kernel_weight: Column | None = None, row_standardise: bool = True) -> DataFrame:
    """``i, j, v`` without self weights."""
    w = edges.filter("target_id <> source_id").select(F.col("target_id").alias("i"), F.col("source_id").alias("j"), (kernel_weight if kernel_weight is not None else F.lit(1.0)).cast("double").alias("v"))
    if not row_standardise:
        return w
    total = F.sum("v").over(Window.partitionBy("i"))
    return w.withColumn("v", F.when(total > 0, F.col("v") / total).otherwise(0.0))


def check_weights(weights: DataFrame, zero_policy: str = "error", nodes: DataFrame | None = None) -> None:
    """Weights are finite, not negative, unique and off the diagonal; islands only where allowed."""
    bad, n, pairs = weights.agg(F.coalesce(F.sum(F.when(F.col("v").isNull() | F.isnan("v") | (F.col("v") < 0) | (F.abs("v") == float("inf")) | ((F.col("i") == F.col("j")) & (F.col("v") != 0)), 1).otherwise(0)), F.lit(0)), F.count(F.lit(1)), F.countDistinct("i", "j")).first()
    if bad or n != pairs:
        raise ValueError("weights must be finite, not negative, unique and zero on the diagonal")
    if zero_policy == "error" and nodes is not None:
        if not nodes.join(weights.filter("v > 0").select("i").distinct(), "i", "left_anti").isEmpty():
            raise ValueError("some locations have no neighbours; zero_policy='keep' allows that")


def moran(weights: DataFrame, values: DataFrame, value: str = "residual", key: str = "id") -> DataFrame:
    """Global Moran's I: ``n, observed, expected, s0``."""
    z = values.select(F.col(key).alias("i"), F.col(value).cast("double").alias("z"))
    mean, n, ss = z.agg(F.avg("z"), F.count(F.lit(1)), F.var_pop("z") * F.count(F.lit(1))).first()
    c = z.withColumn("z", F.col("z") - F.lit(mean))
    cross = weights.join(c, "i").join(c.select(F.col("i").alias("j"), F.col("z").alias("zj")), "j")
    return cross.agg((F.lit(float(n)) / F.sum("v") * F.sum(F.col("v") * F.col("z") * F.col("zj")) / F.lit(ss)).alias("observed"), F.sum("v").alias("s0")).select(F.lit(n).cast("long").alias("n"), "observed", F.lit(-1.0 / (n - 1) if n > 1 else None).cast("double").alias("expected"), "s0")


def local_moran(weights: DataFrame, values: DataFrame, value: str = "residual", key: str = "id") -> DataFrame:
    """``location, local_I, residual, residual_centered, spatial_lag``; islands have NaN lag and I."""
    z = values.select(F.col(key).alias("i"), F.col(value).cast("double").alias("residual"))
    mean, m2 = z.agg(F.avg("residual"), F.var_pop("residual")).first()
    z = z.withColumn("residual_centered", F.col("residual") - F.lit(mean))
    lag = weights.join(z.select(F.col("i").alias("j"), F.col("residual_centered").alias("_z")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_z")).alias("spatial_lag"))
    out = z.join(lag, "i", "left").withColumn("spatial_lag", F.coalesce("spatial_lag", nan()))
    return out.select(F.col("i").alias("location"), (F.col("residual_centered") * F.col("spatial_lag") / F.lit(m2)).alias("local_I"), "residual", "residual_centered", "spatial_lag")


def cluster_label(z: Column, lag: Column, p: Column, alpha: float = 0.05) -> Column:
    """LISA cluster of a location."""
    named = F.when((z > 0) & (lag > 0), "High-High").when((z < 0) & (lag < 0), "Low-Low").when((z > 0) & (lag < 0), "High-Low").when((z < 0) & (lag > 0), "Low-High").otherwise("Not Significant")
    return F.when(p.isNotNull() & ~F.isnan(p) & (p <= alpha), named).otherwise("Not Significant")


#: Rows of a permutation that one task sorts, and permutations whose sums are columns of one aggregate.
SORTED_ROWS, PERMUTATION_BLOCK = 200_000, 50


def _slots(z: DataFrame, n: int, numbers: range, seed: int) -> DataFrame:
    """``perm, i, z, slot``: each row's place from 1 in the order of md5(seed:permutation:id), for each permutation.

    Digests are uniform, so their first digits deal each permutation to even
    buckets; a place is the rows of the buckets before plus the place inside.
    """
    spark = z.sparkSession
    perms = spark.range(numbers.start, numbers.stop).select(F.col("id").alias("perm"))
    rows = z.crossJoin(F.broadcast(perms)).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("i").cast("string"))))
    buckets = max(1, -(-n // SORTED_ROWS))
    rows = rows.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / F.lit(4294967296)).cast("int") if buckets > 1 else F.lit(0))
    place = F.row_number().over(Window.partitionBy("perm", "_b").orderBy("_h", "i"))
    if buckets == 1:
        return rows.select("perm", "i", "z", place.alias("slot"))
    # a row per permutation and bucket
    total = rows.groupBy("perm", "_b").agg(F.count(F.lit(1)).alias("_t"))
    total = total.withColumn("_off", F.sum("_t").over(Window.partitionBy("perm").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_t")).drop("_t")
    return rows.withColumn("_in", place).join(F.broadcast(total), ["perm", "_b"]).select("perm", "i", "z", (F.col("_off") + F.col("_in")).alias("slot"))


def permutation_moran(weights: DataFrame, values: DataFrame, permutations: int = 99, seed: int = 1, value: str = "residual", key: str = "id", alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Permutation tests of global and local Moran statistics.

    In permutation p the location whose place in the order 0 is s gets the
    value whose place in the order p is s; orders are by a seeded digest of
    the id, so they depend on nothing else.  A location's permuted values
    travel as arrays, so edges are shuffled once for all permutations.
    """
    weights = weights.persist()  # read for the sum, the observed statistics and the permuted ones
    z = values.select(F.col(key).alias("i"), F.col(value).cast("double").alias("z"))
    mean, m2, n = z.agg(F.avg("z"), F.var_pop("z"), F.count(F.lit(1))).first()
    s0 = weights.agg(F.sum("v")).first()[0]
    z = z.withColumn("z", F.col("z") - F.lit(mean))
    size = min(PERMUTATION_BLOCK, permutations)
    # values of a slot by permutation, in blocks of so many
    dealt = _slots(z, n, range(1, permutations + 1), seed).select("slot", F.floor((F.col("perm") - 1) / size).cast("int").alias("block"), "perm", "z")
    cells = dealt.groupBy("slot", "block").agg(F.sort_array(F.collect_list(F.struct("perm", "z"))).alias("_c")).select("slot", "block", F.col("_c.z").alias("zp"))
    mixed = cells.join(_slots(z, n, range(0, 1), seed).select("slot", "i"), "slot").select("i", "block", "zp").persist()
    sums = [F.sum(F.col("v") * F.get("zp", F.lit(p))).alias(f"_l{p}") for p in range(size)]
    lag = weights.join(mixed.withColumnRenamed("i", "j"), "j").groupBy("i", "block").agg(*sums).select("i", "block", F.array(*[f"_l{p}" for p in range(size)]).alias("lag"))
    stars = lag.join(mixed, ["i", "block"]).select("i", "block", F.zip_with("zp", F.slice("lag", 1, F.size("zp")), lambda a, b: a * b / F.lit(m2)).alias("local"))
    each = stars.groupBy(F.col("i").alias("location")).agg(F.flatten(F.collect_list("local")).alias("s"))
    total = lambda f: F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x))
    each = each.withColumn("_m", total(lambda x: x) / permutations)
    each = each.withColumn("_s", F.sqrt(total(lambda x: (x - F.col("_m")) ** 2) / F.lit(permutations - 1 or None)))
    observed = local_moran(weights, values, value, key)
    local = observed.join(each, "location", "left")
    beyond = F.size(F.filter("s", lambda x: F.abs(x - F.col("_m")) >= F.abs(F.col("local_I") - F.col("_m"))))
    local = local.withColumn("p_value", F.when(F.col("s").isNotNull(), (beyond + 1) / F.lit(permutations + 1.0)))
    cluster = cluster_label(F.col("residual_centered"), F.col("spatial_lag"), F.col("p_value"), alpha)
    local = local.select("location", "local_I", ((F.col("local_I") - F.col("_m")) / F.col("_s")).alias("z_score"), "p_value", cluster.alias("cluster"), "residual", "residual_centered", "spatial_lag")
    i_star = stars.select("block", F.posexplode("local").alias("p", "x")).groupBy("block", "p").agg((F.sum("x") / F.lit(s0)).alias("I"))
    now = moran(weights, values, value, key).select("n", "observed", "expected", "s0")
    far = F.abs(F.col("I") - F.col("expected")) >= F.abs(F.col("observed") - F.col("expected"))
    out = i_star.crossJoin(F.broadcast(now)).agg(F.first("n").alias("n"), F.first("observed").alias("observed"), F.first("expected").alias("expected"), F.avg("I").alias("permutation_mean"), F.stddev_samp("I").alias("permutation_sd"), ((F.sum(far.cast("int")) + 1) / F.lit(permutations + 1.0)).alias("p_value"))
    return out.withColumn("z_score", (F.col("observed") - F.col("permutation_mean")) / F.col("permutation_sd")), local


# --- collinearity ---------------------------------------------------------

def global_collinearity(data: DataFrame, x: list[str]) -> dict:
    """Population correlations, eigenvalues, rank, condition number and VIFs; constants give infinity and NaN."""
    pairs = [(i, j) for i in range(len(x)) for j in range(i)]
    row = data.agg(*[F.stddev_pop(c) for c in x], *[F.corr(x[i], x[j]) for i, j in pairs]).first()
    r = np.eye(len(x))
    for (i, j), v in zip(pairs, row[len(x) :]):
        r[i, j] = r[j, i] = np.nan if v is None else v
    constant = [not (s or 0) > 1e-12 for s in row[: len(x)]]
    if any(constant) or np.isnan(r).any():
        return {"correlation": r, "eigenvalues": np.full(len(x), np.nan), "rank": sum(not c for c in constant), "condition_number": np.inf, "vif": np.full(len(x), np.inf)}
    values = np.linalg.eigvalsh(r)[::-1]
    full = values[-1] > max(1.0, values[0]) * 1e-10
    return {"correlation": r, "eigenvalues": values, "rank": int((values > max(1.0, values[0]) * 1e-10).sum()), "condition_number": float(np.sqrt(values[0] / values[-1])) if full else np.inf, "vif": np.diag(np.linalg.inv(r)) if full else np.full(len(x), np.inf)}


def local_correlations(weighted: DataFrame, data: DataFrame, x: list[str], key: str = "id") -> DataFrame:
    """``target_id, i, j, correlation``: weighted correlation of each pair of predictors around each target."""
    obs = data.select(F.col(key).alias("source_id"), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(x)])
    own = Window.partitionBy("target_id")
    e = weighted.join(obs, "source_id")
    for k in range(len(x)):
        e = e.withColumn(f"_{k}", F.col(f"_{k}") - F.sum(F.col("wn") * F.col(f"_{k}")).over(own))
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    a = e.groupBy("target_id").agg(*[F.sum(F.col("wn") * F.col(f"_{i}") * F.col(f"_{j}")).alias(f"c{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(j + 1).alias("i"), F.lit(i + 1).alias("j"), F.when((F.col(f"c{i}_{i}") > 0) & (F.col(f"c{j}_{j}") > 0), F.col(f"c{i}_{j}") / F.sqrt(F.col(f"c{i}_{i}") * F.col(f"c{j}_{j}"))).otherwise(nan()).alias("correlation")) for i, j in pairs if i != j]
    return a.select("target_id", F.explode(F.array(*cells)).alias("s")).select("target_id", "s.*")


def local_collinearity(weighted: DataFrame, data: DataFrame, x: list[str], key: str = "id", cn_limit: float = 30.0, vif_limit: float = 10.0) -> DataFrame:
    """``location, condition_number, vif array, max_abs_correlation, flagged`` per target."""
    p = len(x)
    pairs = local_correlations(weighted, data, x, key).groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("i", "j", "correlation"))).alias("r"))

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for t, cells in zip(f["target_id"], f["r"]):
                r = np.eye(p)
                for c in cells:
                    r[c["i"] - 1, c["j"] - 1] = r[c["j"] - 1, c["i"] - 1] = c["correlation"]
                off = np.abs(r[~np.eye(p, dtype=bool)])
                if np.isnan(r).any():
                    cn, vif = np.inf, np.full(p, np.inf)
                else:
                    v = np.linalg.eigvalsh(r)
                    full = v[0] > max(1.0, v[-1]) * 1e-10
                    cn, vif = (np.sqrt(v[-1] / v[0]), np.diag(np.linalg.inv(r))) if full else (np.inf, np.full(p, np.inf))
                out.append((int(t), float(cn), [float(v) for v in vif], float(np.nanmax(off)) if off.size else 0.0, bool(cn > cn_limit or (vif > vif_limit).any())))
            yield pd.DataFrame(out, columns=["location", "condition_number", "vif", "max_abs_correlation", "flagged"])

    return pairs.mapInPandas(run, "location bigint, condition_number double, vif array<double>, max_abs_correlation double, flagged boolean")


def pair_condition(weighted: DataFrame, data: DataFrame, x: list[str], key: str = "id") -> DataFrame:
    """Condition number and VIF for two predictors, in closed form and without Python."""
    r = local_correlations(weighted, data, x[:2], key)
    c = F.col("correlation")
    return r.select(F.col("target_id").alias("location"), "correlation", F.when(F.abs(c) < 1, F.sqrt((1 + F.abs(c)) / (1 - F.abs(c)))).otherwise(inf()).alias("condition_number"), F.when(F.abs(c) < 1, 1 / (1 - c * c)).otherwise(inf()).alias("vif"))


# --- surfaces, metrics, records -------------------------------------------

def interpolate(edges: DataFrame, sources: DataFrame, values: list[str], method: str = "idw", bandwidth: float = 1.0, power: float = 2.0, key: str = "id") -> DataFrame:
    """Values at targets from their nearest sources; where a source coincides, only such sources count."""
    d = F.col("dist")
    w = {"idw": 1 / F.pow(F.greatest(d, F.lit(2.220446049250313e-16)), F.lit(power)), "gaussian": F.exp(-0.5 * (d / bandwidth) ** 2), "exponential": F.exp(-d / bandwidth), "bisquare": F.when(d < bandwidth, (1 - (d / bandwidth) ** 2) ** 2).otherwise(0.0)}[method]
    e = edges.join(sources.select(F.col(key).alias("source_id"), *values), "source_id").withColumn("_hit", d <= 1e-10).withColumn("_w", F.when(d <= 1e-10, 0.0).otherwise(w))
    sums = [f(F.col(v) * g).alias(f"_{n}{k}") for k, v in enumerate(values) for n, g, f in (("h", F.col("_hit").cast("double"), F.sum), ("w", F.col("_w"), F.sum))]
    a = e.groupBy("target_id").agg(F.sum(F.col("_hit").cast("double")).alias("_n"), F.sum("_w").alias("_t"), F.min("dist").alias("nearest_observation_distance"), *sums)
    out = [F.when(F.col("_n") > 0, F.col(f"_h{k}") / F.col("_n")).when(F.col("_t") > 2.220446049250313e-16, F.col(f"_w{k}") / F.col("_t")).alias(v) for k, v in enumerate(values)]
    return a.select("target_id", *out, "nearest_observation_distance")


def merge_duplicates(points: DataFrame, coords: list[str], values: list[str], key: str = "id") -> DataFrame:
    """One row per location: means, ids in order, count."""
    return points.groupBy(*coords).agg(*[F.avg(v).alias(v) for v in values], F.array_join(F.array_sort(F.collect_list(F.col(key))), ",").alias("ids"), F.count(F.lit(1)).alias("n_merged"))


def grid(spark, nx: int, ny: int, low: tuple[float, float] = (0.0, 0.0), high: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Centres of a regular grid: ``grid_id, x, y``."""
    dx, dy = (high[0] - low[0]) / nx, (high[1] - low[1]) / ny
    return spark.range(nx * ny).select(F.col("id").alias("grid_id"), (F.lit(low[0]) + (F.col("id") % nx + 0.5) * dx).alias("x"), (F.lit(low[1]) + (F.floor(F.col("id") / nx) + 0.5) * dy).alias("y"))


def inside_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test of a point against a closed ring."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            at = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def distance_band(d: Column) -> Column:
    """Right-open kilometre bands."""
    return F.when(d < 50, "[0,50)").when(d < 100, "[50,100)").when(d < 200, "[100,200)").when(d < 400, "[200,400)").otherwise("[400,Inf)")


def prediction_metrics(rows: DataFrame, by: list[str], observed: str = "observed", prediction: str = "prediction", baseline: str = "baseline") -> DataFrame:
    """RMSE, MAE, bias and R2 against a baseline."""
    e = F.col(prediction) - F.col(observed)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), (1 - F.sum(e * e) / F.sum((F.col(observed) - F.col(baseline)) ** 2)).alias("predictive_r_squared"))


def support_metrics(rows: DataFrame, by: list[str], truth: str = "truth", estimate: str = "estimate", cut: float = 1e-8) -> DataFrame:
    """Confusion counts and rates of selected against true coefficients."""
    t, s = F.abs(truth) > cut, F.abs(estimate) > cut
    a = rows.groupBy(*by).agg(F.count_if(t & s).cast("double").alias("tp"), F.count_if(~t & s).cast("double").alias("fp"), F.count_if(t & ~s).cast("double").alias("fn"), F.count_if(~t & ~s).cast("double").alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when(((tp + fn) == 0) | ((tn + fp) == 0), None).when(product == 0, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt(product))
    return a.select(*by, "tp", "fp", "fn", "tn", ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"), ratio(tn, tn + fp).alias("specificity"), ratio(tp, tp + fp).alias("precision"), ratio(fp, tp + fp).alias("fdr"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), mcc.alias("mcc"), ratio(tp, tp + fp + fn).alias("iou"), ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"))


def monte_carlo(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, spread, its standard error and quartiles of a metric over replicates; NaN values don't count."""
    v = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_finite"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("mcse"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.25)).alias("q25"), F.percentile(v, F.lit(0.75)).alias("q75"))


def nearest_distances(edges: DataFrame) -> DataFrame:
    """Typical distance to the nearest other point, and the automatic bandwidth."""
    n = edges.filter("rank = 0").count()
    k = max(2, min(20, math.ceil(math.sqrt(n))))
    other = edges.filter("target_id <> source_id")
    return other.agg(F.percentile(F.when(F.col("rank") == 1, F.col("dist")), F.lit(0.5)).alias("typical_nn"), F.percentile(F.when(F.col("rank") == k, F.col("dist")), F.lit(0.5)).alias("auto_bandwidth"))


def collinearity_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Median, 0.9 quantile and maximum (values that occur) of each column; infinity counts as a value."""
    parts = None
    for c in columns:
        one = rows.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{c}`)").alias(n) for p, n in ((0.5, "median"), (0.9, "q90"), (1.0, "max"))]).select(F.lit(c).alias("measure"), "median", "q90", "max")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def best_by_criterion(ranking: DataFrame, criteria: list[str]) -> DataFrame:
    """The eligible candidate of least value for each criterion, among local models and overall; ties go to the smaller id."""
    long = ranking.filter("eligible").select("candidate_id", "terms", "family", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("value")) for c in criteria])).alias("s")).select("candidate_id", "terms", "family", "s.*")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    both = long.filter("family = 'gwr'").withColumn("scope", F.lit("gwr")).unionByName(long.withColumn("scope", F.lit("overall")))
    return both.groupBy("criterion", "scope").agg(F.min_by(F.struct("candidate_id", "terms", "value"), F.struct("value", "candidate_id")).alias("b")).select("criterion", "scope", "b.*")


def paired_loss(rows: DataFrame, by: list[str], method: str, sample: str, base: str = "ols", observed: str = "observed", prediction: str = "prediction") -> DataFrame:
    """Mean difference of squared errors from a base method on the same samples, with its standard error."""
    loss = (F.col(prediction) - F.col(observed)) ** 2
    one = rows.withColumn("_l", loss)
    ref = one.filter(F.col(method) == base).select(sample, F.col("_l").alias("_b"))
    d = one.filter(F.col(method) != base).join(ref, sample).withColumn("_d", F.col("_l") - F.col("_b"))
    return d.groupBy(*by, method).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_difference"), (F.stddev_samp("_d") / F.sqrt(F.count(F.lit(1)))).alias("standard_error"))


def paired_interval(losses: DataFrame, base: str = "ols", method: str = "method", level: float = 0.95) -> DataFrame:
    """:func:`paired_loss` with a t interval of the mean difference and whom it favours.

    A negative difference means a smaller loss of the method; an interval that
    holds zero, or a single sample, favours nobody.
    """
    from ..functions.distributions import t_quantile

    sizes = [r[0] for r in losses.select("n").distinct().collect()]  # numbers of samples, few
    table = losses.sparkSession.createDataFrame([(n, float(t_quantile(0.5 + level / 2, n - 1))) for n in sizes], "n bigint, _t double")
    out = losses.join(F.broadcast(table), "n")
    half = F.col("_t") * F.col("standard_error")
    low, high = F.col("mean_difference") - half, F.col("mean_difference") + half
    favours = F.when(high < 0, F.col(method)).when((low > 0) & ~F.isnan(low), F.lit(base)).otherwise(F.lit("neither"))
    return out.withColumn("low", low).withColumn("high", high).withColumn("favours", favours).drop("_t")


def sample_flow(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """``step, name, n_before, n_removed, n_left``: conditions that rows must meet, one after another, in one pass."""
    ok, counts = F.lit(True), [F.count(F.lit(1)).alias("_0")]
    for k, c in enumerate(steps.values()):
        ok = ok & F.coalesce(c, F.lit(False))
        counts.append(F.count_if(ok).alias(f"_{k + 1}"))
    cells = [F.struct(F.lit(k + 1).alias("step"), F.lit(n).alias("name"), F.col(f"_{k}").alias("n_before"), (F.col(f"_{k}") - F.col(f"_{k + 1}")).alias("n_removed"), F.col(f"_{k + 1}").alias("n_left")) for k, n in enumerate(steps)]
    return rows.agg(*counts).select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def column_quantiles(rows: DataFrame, columns: list[str], probabilities: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Interpolated quantiles of the finite values of each column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    v = F.col("v")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return rows.select(F.explode(cells).alias("s")).select("s.*").groupBy("column").agg(*[F.percentile(finite, F.lit(p)).alias(f"q{round(100 * p)}") for p in probabilities])


def missingness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, non-finite values, zeros and negatives of each column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    v = F.col("v")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return rows.select(F.explode(cells).alias("s")).select("s.*").groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(v.isNotNull() & ~ok).alias("n_not_finite"), F.count_if(ok & (v == 0)).alias("n_zero"), F.count_if(ok & (v < 0)).alias("n_negative"))


def fold_summary(rows: DataFrame, fold: str, coords: list[str], group: str) -> DataFrame:
    """Size, groups and extent of each fold."""
    return rows.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("n_groups"), *[f(c).alias(f"{n}_{c}") for c in coords for n, f in (("min", F.min), ("max", F.max))])


def process_descriptive(rows: DataFrame, residual: str = "residual") -> DataFrame:
    """Loss-free summary of residuals, for models without a Gaussian likelihood."""
    e = F.col(residual)
    return rows.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_absolute_error"))
