"""Formulas, guarded solver, maps and searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid import api, queries
from loamgrid.functions import formula
from loamgrid.operators import neighbors, solvers, statistics, surfaces
from loamgrid.operators.solvers import Spec
from loamgrid.plans import selection, workflow


@pytest.fixture(scope="module")
def points(spark):
    df = spark.range(140).select("id", (F.col("id") * 37 % 101 / 101.0).alias("cx"), (F.col("id") * 53 % 97 / 97.0).alias("cy"), F.sin(F.col("id") / 3.0).alias("a"), F.cos(F.col("id") / 5.0).alias("b"), F.when(F.col("id") % 3 == 0, "u").when(F.col("id") % 3 == 1, "v").otherwise("w").alias("kind"))
    return df.withColumn("y", 1 + F.col("a") * (1 + F.col("cx")) - F.col("b") + F.when(F.col("kind") == "v", 0.4).otherwise(0.0) + 0.05 * F.sin(F.col("id") * 1.7)).persist()


def test_parse():
    assert formula.parse("y ~ a*b + c + 1") == ("y", ["a", "b", "a:b", "c"])
    for bad in ("y", "y ~ 0 + a", "y ~ a + offset(b)"):
        with pytest.raises(ValueError):
            formula.parse(bad)


def test_formula_fit(points):
    f = api.gwr("y ~ a*b + kind", points, ["cx", "cy"], 40)
    assert f.x == ["a", "b", "a_x_b", "kindv", "kindw"] and f.local.count() == 140
    assert f.diagnostics().first()["r_squared"] > 0.95
    with pytest.raises(ValueError):
        formula.build(points.withColumn("kind", F.lit("z")), "y ~ kind", {"kind": ["u", "v"]})


def test_guarded_solver_is_never_worse():
    r = np.random.default_rng(6)
    for model, gamma in (("scad", 3.7), ("mcp", 3.0)):
        x = r.normal(size=(6, 40, 5))
        x[:, :, 1] = x[:, :, 0] + 0.01 * r.normal(size=(6, 40))
        y = x @ np.array([1.0, 1.0, 0, -2, 0.5]) + 0.1 * r.normal(size=(6, 40))
        dist = np.sort(r.random((6, 40)), axis=1)
        plain = solvers.solve(dist, x, y, Spec(model, 0.1, gamma=gamma, tolerance=1e-10, max_iterations=5000))
        guarded = solvers.solve(dist, x, y, Spec(model, 0.1, gamma=gamma, tolerance=1e-10, max_iterations=5000, guarded=True))
        assert guarded["converged"].all() and (guarded["objective"] <= plain["objective"] + 1e-9).all()


def test_pair_minimum_by_grid():
    r = np.random.default_rng(2)
    t = np.linspace(-4, 4, 401)
    for model, gamma in (("scad", 3.7), ("mcp", 3.0)):
        spec = Spec(model, 0.5, gamma=gamma)
        for _ in range(6):
            a = r.normal(size=(2, 2))
            g, z = a @ a.T + 0.1 * np.eye(2), r.normal(size=2)
            v = solvers.pair_minimum(g, z, spec)
            grid = min(solvers.quadratic(g, z, np.array([p, q]), spec) for p in t for q in t)
            assert solvers.quadratic(g, z, v, spec) <= grid + 1e-9


def test_convergence_is_required(points):
    f = workflow.fit(points, "y", ["a", "b"], ["cx", "cy"], 30, "scad", lam=0.05, max_iterations=1, tolerance=1e-14)
    with pytest.raises(workflow.NotConverged) as e:
        workflow.require_converged(f)
    assert e.value.solver_result.filter(~F.col("converged")).count() > 0


def test_variables_and_surfaces(points):
    f = workflow.fit(points, "y", ["a", "b"], ["cx", "cy"], 30)
    assert [surfaces.resolve_variable(f, n) for n in ("a", "A", "beta_2", "Local_R2")] == ["a", "a", "b", "local_r2"]
    with pytest.raises(ValueError):
        surfaces.resolve_variable(f, "nope")
    s = surfaces.surface(f, ["a", "residuals"], 25)
    assert s.filter("inside_boundary").count() > 200 and s.filter("interpolation_valid and value_1 is null").isEmpty()
    assert {r[0] for r in surfaces.bivariate(s).select("class").distinct().collect()} <= set(range(1, 10))


def test_hull(spark):
    p = spark.createDataFrame([(float(x), float(y)) for x in range(5) for y in range(5)], "x double, y double")
    assert sorted(surfaces.convex_hull(p, "x", "y", 1.0)) == [(0.0, 0.0), (0.0, 4.0), (4.0, 0.0), (4.0, 4.0)]


def test_global_fit_matches_least_squares(points):
    a = workflow.global_fit(points, "y", ["a", "b"], "gwr")
    b = workflow.ols(points, "y", ["a", "b"])["coefficients"]
    assert all(abs(a[k] - b[k]) < 1e-9 for k in b)


def test_subsets_keep_hierarchy():
    assert ["a:b"] not in workflow.subsets(["a", "b", "a:b"]) and ["a", "b", "a:b"] in workflow.subsets(["a", "b", "a:b"])
    with pytest.raises(ValueError):
        workflow.subsets([str(i) for i in range(12)])


def test_stepwise_goes_on_until_no_neighbour_is_left(points, monkeypatch):
    terms = [f"t{k:02d}" for k in range(26)]
    wanted, data = set(terms[:12]), points
    for t in terms:
        data = data.withColumn(t, F.lit(1.0))

    def scored(self, candidates):
        blank = {f: None for f in ("rss tss rmse mae bias r_squared adjusted_r_squared trS trStS enp edf sigma2 deviance logLik model_df aic bic gcv loo_cv min_rank min_neff min_positive_weights max_leverage min_abs_loo_denominator max_condition_number max_vif moran_I moran_status n flags reason").split()}
        return [blank | g | {"aicc": float(len(wanted ^ set(g["columns"]))), "eligible": True, "status": "eligible"} for g in candidates]

    monkeypatch.setattr(selection.Search, "evaluate", scored)
    got = workflow.stepwise(data, "y", terms, ["cx", "cy"], ["bisquare"], [40], include_ols=False).collect()
    best = min(got, key=lambda r: r["rank"])
    assert len(got) > 200 and best["aicc"] == 0 and set(best["subset"].split("+")) == wanted
    assert {(r["complete"], r["search_reason"]) for r in got} == {(True, None)}
    cut = workflow.stepwise(data, "y", terms, ["cx", "cy"], ["bisquare"], [40], include_ols=False, max_models=30).collect()
    assert len(cut) <= 30 and {(r["complete"], r["search_reason"]) for r in cut} == {(False, "max_models")}


def test_search_by_single_fits(points, tmp_path):
    """One pass over all candidates against a fit each, resumed after a stop, and the winner again."""
    xy, grid = ["cx", "cy"], {"kernels": ["bisquare", "gaussian"], "ks": [20, 35], "bandwidths": [0.4, 0.9]}
    w = statistics.spatial_weights(neighbors.knn(points, 6, xy))
    path = f"file://{tmp_path}/search"
    cut = workflow.select(points, "y", ["a", "b"], xy, **grid, moran_weights=w, checkpoint=path, max_evaluations=9).collect()
    assert len(cut) == 9 and {r["search_reason"] for r in cut} == {"max_evaluations"} and not any(r["complete"] for r in cut)
    done = workflow.select(points, "y", ["a", "b"], xy, **grid, moran_weights=w, checkpoint=path)
    whole = workflow.select(points, "y", ["a", "b"], xy, **grid, moran_weights=w)
    key = lambda t: [(r["rank"], r["candidate_id"], round(r["aicc"], 9), r["flags"], round(r["moran_I"], 9)) for r in t.orderBy("rank", "candidate_id").collect()]
    assert key(done) == key(whole) and len(key(whole)) == 1 + 3 + 3 * 2 * 4
    with pytest.raises(ValueError):
        workflow.select(points, "y", ["a"], xy, **grid, checkpoint=path)
    for r in whole.filter("family = 'gwr'").collect():
        fixed = r["bandwidth_type"] == "fixed"
        f = workflow.fit(points, "y", r["terms"].split("+"), xy, r["k"], kernel=r["kernel"], bandwidth=r["bw"] if fixed else None)
        d, local_ = f.diagnostics().first(), f.local.agg(F.min("local_rank"), F.max("leverage"), F.min("effective_sample_size"), F.min("positive_weights")).first()
        for c in ("aicc", "loo_cv", "trS", "trStS", "rss"):
            assert abs(d[c] - r[c]) <= 1e-8 * max(1, abs(d[c])) or d[c] == r[c], (r["candidate_id"], c)
        assert (local_[0], local_[3]) == (r["min_rank"], r["min_positive_weights"]) and abs(local_[1] - r["max_leverage"]) < 1e-9 and abs(local_[2] - r["min_neff"]) < 1e-8
    x = np.array([[1, r["a"], r["b"]] for r in points.orderBy("id").collect()])
    y = np.array([r["y"] for r in points.orderBy("id").collect()])
    o = {r["terms"]: r for r in whole.filter("family = 'ols'").collect()}
    assert set(o) == {"1", "a", "b", "a+b"}
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    hat = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
    assert abs(o["a+b"]["rss"] - e @ e) < 1e-9 and abs(o["a+b"]["max_leverage"] - hat.max()) < 1e-10 and abs(o["a+b"]["loo_cv"] - ((e / (1 - hat)) ** 2).sum()) < 1e-8
    assert abs(o["1"]["rss"] - ((y - y.mean()) ** 2).sum()) < 1e-9
    best = workflow.refit(whole, points, "y", xy)
    assert best.local.first()["map_ss"] is not None


def test_search_grid(points):
    plan = workflow.select(points, "y", ["a", "b"], ["cx", "cy"], ["bisquare"], None, dry_run=True)
    assert len([g for g in plan if g["terms"] == "a"]) == 1 + 140 - 3 + 1 and [g["terms"] for g in plan][0] == "1"
    auto = selection.auto_bandwidths(points, ["cx", "cy"])
    xy = np.array([[r["cx"], r["cy"]] for r in points.collect()])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    assert len(auto) == 30 and abs(auto[0] - d[d > 0].min()) < 1e-12 and abs(auto[-1] - 2 * d.max()) < 1e-9
    got = workflow.select(points, "y", ["a"], ["cx", "cy"], ["bisquare"], [], bandwidths="auto").collect()
    assert len(got) == 2 + 30
    least = min((r for r in got if r["family"] == "gwr"), key=lambda r: r["bw"])
    assert least["status"] == "invalid" and "rank_deficient_local_design" in least["reason"] and "grid_boundary" in least["flags"]
    with pytest.raises(ValueError):
        workflow.select(points, "y", ["a", "b"], ["cx", "cy"], ["bisquare"], [20], max_models=3)


def test_least_squares_far_from_zero(spark):
    df = spark.range(50).select((F.col("id") * 1.0 + 1e8).alias("x"), (2.0 * F.col("id") + 3e8 + F.sin("id")).alias("y"))
    o = workflow.ols(df, "y", ["x"])
    x, y = np.arange(50.0), 2 * np.arange(50.0) + np.sin(np.arange(50.0))
    z = np.column_stack((np.ones(50), x))
    e = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    assert abs(o["rss"] - e @ e) < 1e-4 and o["rank"] == 2 and abs(o["trS"] - 2) < 1e-9


def test_what_scalars_mean(points):
    xy = ["cx", "cy"]
    f = {p: workflow.fit(points, "y", ["a", "b"], xy, 30, p, lam=l) for p, l in (("gwr", 0.0), ("ridge", 0.1), ("lasso", 0.05), ("scad", 0.05))}
    got = {p: v.validity() for p, v in f.items()}
    assert [got[p]["exact_linear"] for p in ("gwr", "ridge", "lasso", "scad")] == [True, True, False, False]
    assert got["scad"]["basis"].startswith("conditional local-stationary") and 0 <= got["scad"]["locally_convex_fraction"] <= 1
    assert {"max_coordinate_gap", "active_coordinates"} <= set(f["scad"].solver().columns) and "knots" in f["scad"].local_diagnostics().columns
    with pytest.raises(ValueError):
        workflow.fit(points.withColumn("y", F.when(F.col("id") > 3, F.col("y"))), "y", ["a"], xy, 30)
    s = workflow.fit(points, "y", ["a", "b"], xy, 30, diagnostics="full").inference_summary().collect()
    assert all(r["defined_tests"] == r["n"] == r["selected"] == 140 for r in s)


def test_tuned_model(points):
    df = points.withColumn("fold", F.col("id") % 3)
    t = workflow.tune(df, "y", ["a", "b"], ["cx", "cy"], 30, "fold", [0.3, 0.1, 0.02], "lasso")
    rows = t.scores.collect()
    assert t.best["rmse"] == min(r["rmse"] for r in rows) and t.refit.spec.lam == t.best["lambda"]
    assert t.predict(points.limit(4)).count() == 4 and t.coefficients().count() == 140
    loose = workflow.cross_validate(df, "y", ["a", "b"], ["cx", "cy"], 30, "fold", [0.1], "scad", guarded=True, max_iterations=1, tolerance=1e-14)[0].first()
    assert loose["rmse"] is None and loose["n"] == 140 and loose["convergence_rate"] < 1


def test_heatmap_layers(points):
    f = workflow.fit(points, "y", ["a", "b"], ["cx", "cy"], 30, "lasso", lam=0.2, diagnostics="full")
    h = surfaces.heatmap(f, "a", 25, significance=True, k=20)
    r = h.agg(F.min("selection_support"), F.max("selection_support"), F.count_if("selected"), F.count_if("significant"), F.count(F.lit(1))).first()
    assert 0 <= r[0] <= r[1] <= 1 + 1e-12 and r[3] <= r[2] <= r[4] and r[2] > 0
    assert {"value_1", "significance_support", "inside_boundary"} <= set(h.columns)
    with pytest.raises(ValueError):
        surfaces.heatmap(f, "fitted", 25, significance=True)


def test_ranks_of_whole_tables(spark):
    from loamgrid.functions import ranking

    rng = np.random.default_rng(3)
    values = [*rng.normal(size=300).round(1).tolist(), 0.0, -0.0, 1e300, -1e-300, float("inf"), float("-inf"), None, float("nan"), *np.exp(rng.normal(size=200) * 9).tolist()]
    rows = [(i, "g" if i % 2 else None, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    for by in ([], ["g"]):
        got = {r["id"]: (r["average_rank"], r["bin"]) for r in ranking.rank_bin(ranking.average_rank(df, "v", by), "v", 4, by).collect()}
        for group in ([None, "g"] if by else [0]):
            own = [(i, v) for i, g, v in rows if (not by or g == group) and v is not None and v == v]
            n = len(own)
            for i, v in own:
                rank = sum(w < v for _, w in own) + (sum(w == v for _, w in own) + 1) / 2
                assert got[i] == (rank, min(max(int(np.ceil(rank / n * 4)), 1), 4)), (i, v)
    assert got[rows[306][0]] == (None, None) and got[rows[307][0]] == (None, None) and len(got) == len(rows)
    p = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0.01, 0.04, 0.03, 0.03, 0.5, 0.0005])], "id int, p double")
    for method, want in (("BH", [0.03, 0.048, 0.045, 0.045, 0.5, 0.003]), ("holm", [0.05, 0.12, 0.12, 0.12, 0.5, 0.003]), ("bonferroni", [0.06, 0.24, 0.18, 0.18, 1.0, 0.003])):
        assert np.allclose([r["p_adjusted"] for r in ranking.p_adjust(p, "p", [], method).orderBy("id").collect()], want)


def test_permuted_places(spark, monkeypatch):
    """Places are the same permutation whatever the number of buckets."""
    z = spark.range(300).select(F.col("id").alias("i"), F.lit(0.0).alias("z"))
    one = statistics._slots(z, 300, range(0, 4), 1).collect()
    monkeypatch.setattr(statistics, "SORTED_ROWS", 17)
    many = statistics._slots(z, 300, range(0, 4), 1).collect()
    assert {(r["perm"], r["i"], r["slot"]) for r in one} == {(r["perm"], r["i"], r["slot"]) for r in many}
    assert all(sorted(r["slot"] for r in many if r["perm"] == p) == list(range(1, 301)) for p in range(4))


def test_radius_summary_lists_no_pairs(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, *xy) for i, xy in enumerate([*r.random((300, 2)).tolist(), *(r.random((200, 2)) * 0.01 + 0.4).tolist(), *[[0.1, 0.9]] * 50, [5.0, 5.0]])]
    df = spark.createDataFrame([*rows, (600, None, 0.5), (601, float("nan"), 0.5), (300, *rows[300][1:])], "id long, cx double, cy double")
    for radius in (0.004, 0.1, 3.0):
        want = neighbors.radius_join(df, radius, ["cx", "cy"]).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("furthest"))
        got = neighbors.radius_summary(df, radius, ["cx", "cy"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with monkeypatch.context() as m:
        m.setattr(neighbors, "BOX_POINTS", 40)
        assert sorted(map(tuple, neighbors.radius_summary(df, 3.0, ["cx", "cy"]).collect())) == sorted(map(tuple, want.collect()))
    assert neighbors.radius_summary(df.filter("id < 0"), 0.1, ["cx", "cy"]).count() == 0
    # 20,000 places within the radius of each other: 400 million pairs
    dense = spark.range(20_000).select("id", (F.col("id") * 37 % 1009 / 1e5).alias("cx"), (F.col("id") * 53 % 997 / 1e5).alias("cy"))
    assert neighbors.radius_summary(dense, 0.05, ["cx", "cy"]).filter("n = 20000 and furthest > 0.007").count() == 20_000
    assert "Join" not in queries.QUERIES["radius_neighbours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
