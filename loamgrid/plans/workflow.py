"""Fits, paths, cross-validation, selection and prediction from tables of located observations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions
from ..functions.penalties import check_gamma
from ..functions.ranking import p_adjust
from ..functions.weights import weighted_edges
from ..operators import local, neighbors, statistics
from ..operators.solvers import Spec, lambda_path
from . import selection
from .selection import rank_candidates, refit, select, stepwise, subsets

__all__ = ["Fit", "NotConverged", "Tuned", "tune", "best_lambda_nested", "bandwidth_search", "cross_validate", "fit", "global_fit", "ols", "path", "rank_candidates", "refit", "report", "require_converged", "select", "spatial_folds", "spec_of", "stepwise", "subsets", "with_lambda"]

#: Presets of the named penalties: model, alpha (None: the caller's).
PENALTIES = {"gwr": ("gwr", 1.0), "scaled_lasso": ("scaled_lasso", None), "lasso": ("lasso", 1.0), "ridge": ("ridge", 0.0), "elastic_net": ("en", None), "scad": ("scad", 1.0), "mcp": ("mcp", 1.0), "lad": ("lad", None)}


def spec_of(penalty: str, lam: float = 0.0, alpha: float = 1.0, d: float = 0.0, gamma: float | None = None, kernel: str = "bisquare", bandwidth: float | None = None, tolerance: float = 1e-7, max_iterations: int | None = None, guarded: bool = False) -> Spec:
    """A checked specification of a named penalty."""
    if penalty not in PENALTIES:
        raise ValueError(f"penalty must be one of {', '.join(PENALTIES)}")
    model, preset = PENALTIES[penalty]
    if lam < 0 or not 0 <= alpha <= 1 or (bandwidth is not None and bandwidth <= 0):
        raise ValueError("lambda must not be negative, alpha must be in [0, 1], a bandwidth must be positive")
    if guarded and penalty not in ("scad", "mcp"):
        raise ValueError("the guarded solver belongs to SCAD and MCP")
    if d and penalty not in ("scaled_lasso", "lad"):
        raise ValueError("d belongs to the scaled lasso")
    alpha = alpha if preset is None else preset
    if model != "gwr" and model != "lad" and alpha == 0 and not d:
        model = "ridge"
    g = check_gamma(penalty, gamma) if penalty in ("scad", "mcp") else 3.7
    return Spec(model, 0.0 if penalty == "gwr" else float(lam), alpha, d, g, kernel, bandwidth, tolerance, max_iterations or (2000 if model == "lad" else 1000), guarded)


@dataclass
class Fit:
    """A fitted model: tables, and what predictions need."""

    spec: Spec
    data: DataFrame
    y: str
    x: list[str]
    coords: list[str]
    key: str
    k: int
    centre: np.ndarray
    scale: np.ndarray
    edges: DataFrame
    local: DataFrame
    cache: dict = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return ["(Intercept)", *self.x]

    def coefficients(self) -> DataFrame:
        return self.local.select("target_id", *[F.element_at("coef", i + 1).alias(n) for i, n in enumerate(self.names)])

    def fitted(self) -> DataFrame:
        obs = self.data.select(F.col(self.key).alias("target_id"), F.col(self.y).cast("double").alias("y"))
        return obs.join(self.local.select("target_id", "fitted"), "target_id").withColumn("residual", F.col("y") - F.col("fitted"))

    def solver(self) -> DataFrame:
        return self.local.select(F.col("target_id").alias("location"), "converged", "iterations", "solver", "weight_sum", "bandwidth", "objective", "max_kkt_violation", *self._audit())

    def _audit(self) -> list[str]:
        if self.spec.model == "lad":
            return ["primal_residual", "dual_residual"]
        if self.spec.model not in ("scad", "mcp"):
            return []
        return ["max_coordinate_gap", "active_coordinates", *(["pair_accepted", "block_accepted", "block_checks"] if self.spec.guarded else [])]

    def diagnostics(self) -> DataFrame:
        """The global scalars, one row."""
        if self.spec.model == "lad":
            raise ValueError("information criteria aren't defined for absolute deviations")
        return statistics.smoother_diagnostics(self.local.withColumn("y", F.col("fitted") + F.col("residual")))

    def validity(self) -> dict:
        """What the smoother's scalars mean for this model; the strings are fixed values."""
        model, lam, alpha = self.spec.model, self.spec.lam, self.spec.alpha
        if model in ("scad", "mcp"):
            row = self.local.agg(F.avg(F.col("locally_convex").cast("double")), F.sum("knots")).first()
            note = (
                "Trace, information-criterion, and coefficient-derivative quantities condition on the selected local stationary solution. Non-locally convex fits and "
                "coefficients at penalty knots require additional caution; these are not exact post-selection inference."
            )
            return {"basis": "conditional local-stationary nonconvex smoother", "exact_linear": False, "conditional": True, "locally_convex_fraction": row[0], "penalty_knots": row[1], "information_criteria": True, "note": note}
        linear = model == "ridge" or lam <= 0 or alpha <= 0
        if lam <= 0:
            basis, note = "classical GWR linear smoother", "Local coefficient tests remain exploratory because neighboring local fits are dependent."
        elif linear:
            basis, note = "exact linear penalized smoother", "Trace quantities are exact for the fitted linear smoother; penalized coefficient inference remains bias-aware and exploratory."
        else:
            basis, note = "conditional active-set smoother", "Degrees of freedom and information criteria condition on the selected local active sets; they are intended for model comparison, not exact post-selection inference."
        return {"basis": basis, "exact_linear": linear, "conditional": not linear, "information_criteria": model != "lad", "note": note}

    def local_diagnostics(self) -> DataFrame:
        w = weighted_edges(self.edges, self.spec.kernel, self.spec.bandwidth)
        q = statistics.local_fit_quality(w, self.local.select(F.col("target_id").alias("id"), (F.col("fitted") + F.col("residual")).alias("y"), "fitted"))
        more = ["locally_convex", "min_hessian", "knots"] if self.spec.model in ("scad", "mcp") else []
        cols = self.local.select("target_id", "leverage", "smoother_row_norm2", "condition_number", "local_rank", "solver", *more)
        return cols.join(q, "target_id").withColumnRenamed("target_id", "location").withColumnRenamed("solver", "operator_solver")

    def summary(self) -> DataFrame:
        return statistics.coefficient_summary(self.local, self.names)

    def predict(self, targets: DataFrame, k: int | None = None) -> DataFrame:
        """``target_id, coef, fitted``: re-fitted at new locations from training rows only, on the training scale."""
        edges = neighbors.knn(self.data, k or self.k, self.coords, self.key, targets)
        data = local.standardised(self.data, self.x, self.centre, self.scale)
        hoods = local.neighbourhoods(edges, data, self.y, self.x, self.key)
        at = local.standardised(targets, self.x, self.centre, self.scale)
        return local.fit_local(hoods, self.spec, self.centre, self.scale, at, "none", self.x, self.key).select("target_id", "coef", "fitted", "converged", "solver")

    def inference(self, df: str = "edf", adjust: str = "BH", scope: str = "coefficient", estimator: str = "auto", alpha: float = 0.05) -> DataFrame:
        """Two-sided tests of each local coefficient; needs ``diagnostics='full'``."""
        post = estimator == "post_selection" or (estimator == "auto" and self.spec.model not in ("gwr", "ridge") and self.spec.lam > 0)
        rows = self.local
        if post:
            obs = rows.withColumn("y", F.col("fitted") + F.col("residual"))
            x = self.data.select(F.col(self.key).alias("target_id"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in self.x]).alias("_x"))
            obs = obs.join(x, "target_id").withColumn("fitted", F.aggregate(F.zip_with("_x", "post_coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
            obs = obs.withColumn("residual", F.col("y") - F.col("fitted"))
            g = statistics.smoother_diagnostics(obs, hat="post_hat", s2="post_s2").first()
        else:
            g = self.diagnostics().first()
        degrees = {"edf": g["edf"], "residual": g["n"] - g["trS"], "normal": np.inf}[df]
        sigma2 = g["sigma2"]
        coef, ss = ("post_coef", "post_map_ss") if post else ("coef", "map_ss")
        long = rows.select("target_id", F.posexplode(F.arrays_zip(F.col(coef).alias("b"), F.col(ss).alias("s"))).alias("j", "v"))
        long = long.select(F.col("target_id").alias("location"), F.element_at(F.array(*[F.lit(n) for n in self.names]), F.col("j") + 1).alias("coefficient"), F.col("v.b").alias("estimate"), F.sqrt(F.col("v.s") * F.lit(float(sigma2))).alias("standard_error"), ((F.col("j") == 0) | (F.abs("v.b") > 1e-10)).alias("selected"))
        long = long.withColumn("statistic", F.when(F.col("standard_error") > 0, F.col("estimate") / F.col("standard_error")))

        def tails(frames):
            for f in frames:
                t = f["statistic"].to_numpy(float)
                ok = np.isfinite(t)
                p = np.full(len(t), np.nan)
                if np.isinf(degrees):
                    p[ok] = distributions.normal_two_sided(t[ok])
                elif np.isfinite(degrees) and degrees > 0 and ok.any():
                    p[ok] = distributions.t_two_sided(t[ok], float(degrees))
                yield f.assign(p_value=p)

        kind = "location bigint, coefficient string, estimate double, standard_error double, selected boolean, statistic double, p_value double"
        tested = long.mapInPandas(tails, kind).withColumn("p_value", F.when(~F.isnan("p_value"), F.col("p_value"))).persist()
        out = p_adjust(tested, "p_value", ["coefficient"] if scope == "coefficient" else [], adjust)
        return out.withColumn("significant", F.col("p_adjusted") < alpha)

    def inference_summary(self, **options) -> DataFrame:
        i = self.inference(**options)
        hit = F.col("significant").cast("double")
        return i.groupBy("coefficient").agg(
            (100 * F.avg(F.col("selected").cast("double"))).alias("selected_percent"), (100 * F.avg(hit)).alias("significant_percent"), F.percentile(F.abs("statistic"), F.lit(0.5)).alias("median_abs_t"), F.min("p_adjusted").alias("min_adjusted_p"),
            F.count(F.lit(1)).alias("n"), F.count("p_value").alias("defined_tests"), F.count_if(F.col("selected")).alias("selected"), F.count_if(F.col("significant")).alias("significant"),
        )


def check_response(data: DataFrame, y: str) -> None:
    """Every response is a finite number."""
    v = F.col(y).cast("double")
    bad = data.agg(F.sum(F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 1).otherwise(0))).first()[0]
    if bad:
        raise ValueError(f"{bad} responses are missing or aren't finite")


def fit(data: DataFrame, y: str, x: list[str], coords: list[str], k: int, penalty: str = "gwr", key: str = "id", diagnostics: str = "standard", edges: DataFrame | None = None, **options) -> Fit:
    """Fit a local model at every observation."""
    spec = spec_of(penalty, **options)
    check_response(data, y)
    centre, scale = local.standardisation(data, x)
    edges = (neighbors.knn(data, k, coords, key) if edges is None else neighbors.prefix(edges, k)).persist()
    hoods = local.neighbourhoods(edges, local.standardised(data, x, centre, scale), y, x, key)
    rows = local.fit_local(hoods, spec, centre, scale, diagnostics=diagnostics).persist()
    return Fit(spec, data, y, x, coords, key, k, centre, scale, edges, rows)


class NotConverged(RuntimeError):
    """A guarded fit left targets unconverged; ``solver_result`` is the audit table."""

    def __init__(self, solver_result: DataFrame, count: int):
        super().__init__(f"{count} targets did not converge")
        self.solver_result = solver_result


def require_converged(f: Fit) -> Fit:
    """The fit, or an error that carries its audit."""
    bad = f.local.filter(~F.col("converged")).count()
    if bad:
        raise NotConverged(f.solver(), bad)
    return f


def path(data: DataFrame, y: str, x: list[str], coords: list[str], k: int, penalty: str = "lasso", lambdas: list[float] | None = None, count: int = 50, ratio: float = 1e-3, key: str = "id", edges: DataFrame | None = None, **options) -> DataFrame:
    """A row per target and lambda, along a decreasing path."""
    spec = spec_of(penalty, 1.0, **options)
    centre, scale = local.standardisation(data, x)
    edges = neighbors.knn(data, k, coords, key) if edges is None else neighbors.prefix(edges, k)
    hoods = local.neighbourhoods(edges, local.standardised(data, x, centre, scale), y, x, key).persist()
    if lambdas is None:
        lambdas = lambda_path(local.lambda_max(hoods, spec, len(x)), count, ratio)
    lambdas = np.asarray(lambdas, float)
    if (np.diff(lambdas) > 0).any():
        raise ValueError("lambdas must not increase")
    return local.fit_path(hoods, spec, lambdas, centre, scale)


def fold_neighbourhoods(data: DataFrame, y: str, x: list[str], coords: list[str], k: int, fold: str, key: str = "id") -> Iterator[tuple[object, DataFrame, DataFrame, np.ndarray, np.ndarray]]:
    """For each fold: its rows, their neighbourhoods of k training rows, and the training rows' centre and scale."""
    sizes = dict(data.groupBy(fold).count().orderBy(fold).collect())  # a row per fold
    if len(sizes) < 2:
        raise ValueError("at least two folds are needed")
    total = sum(sizes.values())
    for f, n in sizes.items():
        train, test = data.filter(F.col(fold) != f), data.filter(F.col(fold) == f)
        if total - n < k:
            raise ValueError(f"fold {f} leaves fewer than {k} rows")
        centre, scale = local.standardisation(train, x)
        edges = neighbors.knn(train, k, coords, key, test)
        yield f, test, local.neighbourhoods(edges, local.standardised(train, x, centre, scale), y, x, key), centre, scale


def cross_validate(data: DataFrame, y: str, x: list[str], coords: list[str], k: int, fold: str, lambdas: list[float], penalty: str = "lasso", ds: tuple[float, ...] = (0.0,), key: str = "id", **options) -> tuple[DataFrame, DataFrame]:
    """Spatial cross-validation: (scores per d and lambda, scores per fold).

    Each fold is standardised and searched on its training rows alone; errors
    are pooled over folds.  The best row is ``ranking.argmin(scores, 'rmse', 'lambda_idx')``.
    """
    parts = []
    for f, test, hoods, centre, scale in fold_neighbourhoods(data, y, x, coords, k, fold, key):
        at = local.standardised(test, x, centre, scale)
        seen = test.select(F.col(key).alias("target_id"), F.col(y).cast("double").alias("_y"))
        for d in ds:
            got = local.fit_path(hoods, spec_of(penalty, 1.0, d=d, **options), np.asarray(lambdas, float), centre, scale, at, x, key)
            parts.append(got.join(seen, "target_id").select(F.lit(f).cast(data.schema[fold].dataType).alias("fold"), F.lit(float(d)).alias("d"), "lambda_idx", "lambda", (F.col("fitted") - F.col("_y")).alias("e"), "converged"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.persist()
    e = F.col("e")
    n = F.count(F.lit(1))
    # with the guarded solver one target that didn't converge voids its lambda: no score, the same denominator
    usable = F.bool_and("converged") if options.get("guarded") else F.lit(True)
    scored = lambda c: F.when(usable, c)
    score = [n.alias("n"), scored(F.sqrt(F.avg(e * e))).alias("rmse"), scored(F.avg(e * e)).alias("mse"), scored(F.avg(F.abs(e))).alias("mae"), F.avg(F.col("converged").cast("double")).alias("convergence_rate")]
    return rows.groupBy("d", "lambda_idx", "lambda").agg(*score), rows.groupBy("fold", "d", "lambda_idx", "lambda").agg(*score)


@dataclass
class Tuned:
    """Scores of a cross-validation, its best row, and the model refitted on all rows with it."""

    scores: DataFrame
    folds: DataFrame
    best: dict
    refit: Fit

    def predict(self, targets: DataFrame, k: int | None = None) -> DataFrame:
        return self.refit.predict(targets, k)

    def coefficients(self) -> DataFrame:
        return self.refit.coefficients()


def tune(data: DataFrame, y: str, x: list[str], coords: list[str], k: int, fold: str, lambdas: list[float], penalty: str = "lasso", ds: tuple[float, ...] = (0.0,), key: str = "id", metric: str = "rmse", **options) -> Tuned:
    """Cross-validate, take the least error (then the smaller d and the first lambda), and refit on all rows."""
    scores, folds = cross_validate(data, y, x, coords, k, fold, lambdas, penalty, ds, key, **options)
    rows = [r.asDict() for r in scores.orderBy("d", "lambda_idx").collect()]  # a row per d and lambda
    usable = [r for r in rows if r[metric] is not None and np.isfinite(r[metric])]
    if not usable:
        raise ValueError("no lambda has a score")
    best = min(usable, key=lambda r: r[metric])
    own = {"d": best["d"]} if penalty in ("scaled_lasso", "lad") else {}
    return Tuned(scores, folds, best, fit(data, y, x, coords, k, penalty, key, lam=best["lambda"], **own, **options))


def spatial_folds(data: DataFrame, coords: list[str], k: int = 5, seed: int = 1) -> DataFrame:
    """``data`` with a ``fold`` of k-means on standardised coordinates."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=coords, outputCol="_v").transform(data)
    v = StandardScaler(withMean=True, inputCol="_v", outputCol="_s").fit(v).transform(v)
    model = KMeans(k=k, seed=seed, featuresCol="_s", predictionCol="fold", maxIter=50).fit(v)
    return model.transform(v).drop("_v", "_s")


def bandwidth_search(data: DataFrame, y: str, x: list[str], coords: list[str], fold: str, ks: list[int], key: str = "id", **options) -> DataFrame:
    """GWR cross-validation scores by number of neighbours; the best is the least RMSE, then the smaller k.

    Each fold is searched once, at the largest k, and all k go through one pass over it.
    """
    spec, parts = spec_of("gwr", **options), []
    for _, test, hoods, centre, scale in fold_neighbourhoods(data, y, x, coords, max(ks), fold, key):
        got = local.predict_at(hoods, spec, ks, local.standardised(test, x, centre, scale), x, key)
        seen = test.select(F.col(key).alias("target_id"), F.col(y).cast("double").alias("_y"))
        parts.append(got.join(seen, "target_id").select("k", (F.col("fitted") - F.col("_y")).alias("e")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    e = F.col("e")
    return rows.groupBy("k").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")).orderBy("rmse", "k")


def ols(data: DataFrame, y: str, x: list[str]) -> dict:
    """Global least squares: coefficients and the scalars of its smoother."""
    m = selection.global_moments(data, y, x)
    beta, _, rank = m.solve(x)
    d = statistics.smoother_diagnostics(selection.evaluate_global(data, y, m, [(0, x)], None)).first()
    scalars = {k: float(d[k]) for k in ("rss", "r_squared", "trS", "edf", "aic", "aicc", "bic", "gcv", "loo_cv")}
    return {"coefficients": dict(zip(["(Intercept)", *x], [m.level - float(beta @ m.centre), *beta.tolist()])), "n": m.n, "rank": rank + 1} | scalars


def report(f: Fit) -> dict:
    """Calibration, baseline, diagnostics and summary of a fit."""
    d = f.diagnostics().first().asDict()
    return {"model": f.spec.model, "kernel": f.spec.kernel, "k": f.k, "diagnostics": d, "ols": ols(f.data, f.y, f.x), "summary": f.summary(), "collinearity": statistics.global_collinearity(f.data, f.x)}


def best_lambda_nested(data: DataFrame, y: str, x: list[str], coords: list[str], k: int, outer: str, inner: str, lambdas: list[float], penalty: str = "lasso", key: str = "id", **options) -> DataFrame:
    """Nested cross-validation: for each outer fold, the lambda that the inner folds of its training rows choose, and the held-out errors.

    Inner errors are pooled over folds; a lambda with a target that didn't converge can't win, and an exact tie is an error.
    """
    from ..functions.ranking import argmin

    parts = []
    for f in [r[0] for r in data.select(outer).distinct().orderBy(outer).collect()]:
        train, test = data.filter(F.col(outer) != f), data.filter(F.col(outer) == f)
        scores, _ = cross_validate(train, y, x, coords, k, inner, lambdas, penalty, key=key, **options)
        good = scores.filter("convergence_rate = 1").persist()
        best = argmin(good, "rmse", "lambda_idx").first()
        if best is None or good.filter(F.col("rmse") == best["rmse"]).count() > 1:
            raise ValueError(f"outer fold {f}: no single best lambda")
        m = fit(train, y, x, coords, k, penalty, key, diagnostics="none", lam=best["lambda"], **options)
        got = m.predict(test).join(test.select(F.col(key).alias("target_id"), F.col(y).cast("double").alias("observed")), "target_id")
        base = train.agg(F.avg(y)).first()[0]
        parts.append(got.select(F.lit(f).cast(data.schema[outer].dataType).alias("outer_fold"), F.lit(best["lambda"]).alias("lambda"), "target_id", "observed", F.col("fitted").alias("prediction"), F.lit(float(base)).alias("baseline")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def global_fit(data: DataFrame, y: str, x: list[str], penalty: str = "lasso", **options) -> dict:
    """One penalised model for all rows: moments by a single aggregate, then the local solvers on them."""
    from ..operators import solvers

    spec = spec_of(penalty, **options)
    if spec.model == "lad":
        raise ValueError("absolute deviations have no moments")
    centre, scale = local.standardisation(data, x)
    z = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(x, centre, scale)]
    p = len(x)
    row = data.agg(F.avg(y), *[F.avg(a * b) for a in z for b in z], *[F.covar_pop(a, F.col(y).cast("double")) for a in z]).first()
    gram, score = np.array(row[1 : 1 + p * p], float).reshape(1, p, p), np.array(row[1 + p * p :], float).reshape(1, p)
    m = solvers.Moments(None, None, None, np.array([row[0]]), np.zeros((1, p)), None, None, gram, score, np.array([True]))
    if spec.model == "ridge":
        beta = np.linalg.solve(gram[0] + spec.lam * np.eye(p), score[0])[None]
    elif spec.model == "gwr":
        beta = solvers.direct(gram, score)[0]
    else:
        pilot = np.zeros((1, p)) if spec.model in ("scad", "mcp") else solvers.direct(gram, score)[0]
        beta = solvers.coordinate_descent(m, spec, pilot, pilot)[0]
    coef = local.original_scale(np.array([row[0]]), beta, np.zeros((1, p)), centre, scale)[0]
    return dict(zip(["(Intercept)", *x], coef.tolist()))


def with_lambda(f: Fit, lam: float) -> Fit:
    """The same fit at another penalty."""
    spec = replace(f.spec, lam=lam)
    hoods = local.neighbourhoods(f.edges, local.standardised(f.data, f.x, f.centre, f.scale), f.y, f.x, f.key)
    return replace(f, spec=spec, local=local.fit_local(hoods, spec, f.centre, f.scale).persist())
