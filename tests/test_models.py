"""Local models against golden numbers and independent computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import distributions, penalties
from loamgrid.functions.weights import kernel_values
from loamgrid.operators import advanced, local, neighbors, solvers, statistics
from loamgrid.operators.solvers import Spec
from loamgrid.plans import workflow

#: Published predictions at rows 49 to 54 of the 8 x 8 example.
GOLD = {
    "ridge": [0.43369460, 0.36477466, 0.20863631, 0.01394306, -0.31935765, -0.55231892],
    "lasso": [0.7426695, 0.6552055, 0.3947105, 0.1098925, -0.3125693, -0.5637020],
    "elastic_net": [0.56788760, 0.49266114, 0.29357838, 0.05861234, -0.31622899, -0.55797958],
    "scad": [0.22530960, 0.16179572, 0.04253704, -0.13117765, -0.42455670, -0.62960456],
    "mcp": [0.22530958, 0.16179572, 0.04253704, -0.13117765, -0.42455670, -0.62960456],
}


@pytest.fixture(scope="module")
def example(spark):
    g, i = np.linspace(0, 1, 8), np.arange(1, 65)
    east, north = np.tile(g, 8), np.repeat(g, 8)
    x1, x2 = np.sin(i / 5), np.cos(i / 7)
    y = 1 + (0.8 + east) * x1 - 0.7 * x2 + 0.05 * np.sin(i)
    rows = list(zip(i.tolist(), east.tolist(), north.tolist(), x1.tolist(), x2.tolist(), y.tolist()))
    return spark.createDataFrame(rows, "id bigint, cx double, cy double, x1 double, x2 double, y double").persist()


@pytest.mark.parametrize("penalty", sorted(GOLD))
def test_published_predictions(example, penalty):
    o = {"lam": 0.02} | ({"alpha": 0.5} if penalty == "elastic_net" else {})
    f = workflow.fit(example.filter("id <= 48"), "y", ["x1", "x2"], ["cx", "cy"], 18, penalty, **o)
    got = [r["fitted"] for r in f.predict(example.filter("id between 49 and 54")).orderBy("target_id").collect()]
    assert np.abs(np.array(got) - GOLD[penalty]).max() < (1e-7 if penalty in ("ridge", "scad", "mcp") else 5e-6)


def test_scad_coefficients(example):
    f = workflow.fit(example.filter("id <= 48"), "y", ["x1", "x2"], ["cx", "cy"], 18, "scad", lam=0.02)
    got = [list(r)[1:] for r in f.coefficients().orderBy("target_id").limit(3).collect()]
    want = [(1.0116238, 0.8978659, -0.6488478), (1.0082939, 0.9520375, -0.6512968), (1.0044745, 1.0496238, -0.6647299)]
    assert np.abs(np.array(got) - want).max() < 5e-6


def test_neighbours_by_brute_force(spark):
    r = np.random.default_rng(4)
    xy = np.round(r.random((300, 2)), 2)  # ties and duplicate locations
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], "id bigint, cx double, cy double")
    d = np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2)
    first = d.copy()
    np.fill_diagonal(first, -1)
    want = {(i, int(j), k) for i in range(300) for k, j in enumerate(np.lexsort((np.arange(300), first[i]))[:9])}
    for size in (1 << 20, 0):
        e = neighbors.knn(df, 9, ["cx", "cy"], broadcast_bytes=size)
        assert {(r["target_id"], r["source_id"], r["rank"]) for r in e.collect()} == want
    with pytest.raises(ValueError):
        neighbors.knn(df, 301, ["cx", "cy"])
    with pytest.raises(ValueError):
        neighbors.knn(df.withColumn("cx", F.when(F.col("id") > 0, F.col("cx"))), 3, ["cx", "cy"])


def test_neighbours_of_clusters_by_brute_force(spark, monkeypatch):
    """Crowded places, hundreds of copies of one location, three coordinates, and targets far outside."""
    monkeypatch.setattr(neighbors, "BOX_POINTS", 60)
    r = np.random.default_rng(9)
    xyz = np.concatenate((r.normal(size=(300, 3)) * 0.01, r.normal(size=(150, 3)) + 5, np.full((250, 3), 2.0), r.random((60, 3)) * 100))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id bigint, cx double, cy double, cz double")
    far = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate([[-500, 0, 0], [2, 2, 2], [50, 50, 400], [5, 5, 5]])], "id bigint, cx double, cy double, cz double")
    for dims in (["cx", "cy", "cz"], ["cx"]):
        p = xyz[:, : len(dims)]

        def dist(a):
            return np.sqrt(sum((a[:, None, c] - p[None, :, c]) ** 2 for c in range(len(dims))))  # noqa: B023

        d = dist(p)
        np.fill_diagonal(d, -1)
        want = {(i, int(j), k) for i in range(len(p)) for k, j in enumerate(np.lexsort((np.arange(len(p)), d[i]))[:7])}
        assert {(e["target_id"], e["source_id"], e["rank"]) for e in neighbors.knn(df, 7, dims, broadcast_bytes=0).collect()} == want
        q = np.array([[x[c] for c in dims] for x in far.orderBy("id").collect()])
        want = {(i, int(j), k) for i in range(4) for k, j in enumerate(np.lexsort((np.arange(len(p)), dist(q)[i]))[:7])}
        assert {(e["target_id"], e["source_id"], e["rank"]) for e in neighbors.knn(df, 7, dims, targets=far, broadcast_bytes=0).collect()} == want


@pytest.mark.parametrize("penalty,gamma", [("scad", 3.7), ("mcp", 3.0)])
def test_exact_minimum(penalty, gamma):
    b = np.linspace(-6, 6, 240001)
    for z in (-1.7, -0.2, 0.15, 1.4):
        for g in (0.08, 0.3, 1.2):
            for lam in (0.07, 0.4):
                got = penalties.exact_minimum(np.array([z]), np.array([g]), lam, gamma, penalty)[0]
                f = lambda v: 0.5 * g * v * v - z * v + penalties.penalty_value(np.asarray(v), lam, gamma, penalty)  # noqa: E731,B023
                assert f(got) <= f(b).min() + 1e-9


def batch(n=3, k=30, p=3, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, k, p))
    return np.sort(r.random((n, k)), axis=1), x, x @ np.array([1.0, -0.5, 0.0]) + 0.1 * r.normal(size=(n, k))


@pytest.mark.parametrize("spec", [Spec("lasso", 0.1, 1.0, tolerance=1e-12), Spec("en", 0.1, 0.5, tolerance=1e-12), Spec("scaled_lasso", 0.2, 0.5, 0.7, tolerance=1e-12), Spec("scad", 0.1, tolerance=1e-12), Spec("mcp", 0.1, gamma=3.0, tolerance=1e-12)])
def test_stationarity(spec):
    f = solvers.solve(*batch(), spec)
    assert f["converged"].all() and f["kkt"].max() < 1e-9


def test_absolute_deviations_resist_an_outlier():
    dist, x, y = batch(2, 40, 3, 5)
    y = x @ np.array([1.0, -0.5, 0.2]) + 0.3
    y[:, 7] += 50
    f = solvers.solve(dist, x, y, Spec("lad", 0.0, max_iterations=4000, kernel="boxcar"))
    assert np.abs(f["beta"] - [1.0, -0.5, 0.2]).max() < 1e-3


def test_leverage_is_a_derivative():
    dist, x, y = batch(1, 25, 3, 9)
    for spec in (Spec("gwr"), Spec("ridge", 0.2, 0.0), Spec("scad", 0.05, tolerance=1e-12), Spec("lasso", 0.05, tolerance=1e-12)):
        f = solvers.solve(dist, x, y, spec)
        row = solvers.smoother(f, spec, x[:, 0, :])["rows"][0]
        value = lambda v: (lambda g: g["level"][0] + (x[0, 0] - g["m"].x_mean[0]) @ g["beta"][0])(solvers.solve(dist, x, v, spec))  # noqa: E731,B023
        for j in (0, 4):
            up, down = y.copy(), y.copy()
            up[0, j] += 1e-5
            down[0, j] -= 1e-5
            assert abs((value(up) - value(down)) / 2e-5 - row[j]) < 1e-4


@pytest.mark.parametrize("spec", [Spec("lasso", 0.1), Spec("scaled_lasso", 0.2, 0.5, 0.7), Spec("scad", 0.1), Spec("gwr")])
def test_smoother_by_active_sets(spec):
    """The batched smoother against one target at a time."""
    dist, x, y = batch(40, 25, 3, 21)
    y = y + np.linspace(-1, 1, 40)[:, None] * x[:, :, 2]
    c = np.array([0.3, -0.2, 0.1])
    f = solvers.solve(dist, x, y, spec)
    assert spec.model == "gwr" or len(np.unique(np.abs(f["beta"]) > 1e-10, axis=0)) > 1
    s = solvers.smoother(f, spec, x[:, 0, :], c, keep_maps=True)
    for i in range(40):
        one = solvers.smoother(solvers.solve(dist[i : i + 1], x[i : i + 1], y[i : i + 1], spec), spec, x[i : i + 1, 0, :], c, keep_maps=True)
        for name in ("rows", "squares", "maps", "convex"):
            assert np.allclose(s[name][i], one[name][0], atol=1e-9), name
    # fitted values are the rows applied to y wherever the fit is linear in y at a fixed active set
    if spec.model == "gwr":
        assert np.allclose((s["rows"] * y).sum(1), f["level"] + ((x[:, 0] - f["m"].x_mean) * f["beta"]).sum(1))
        assert np.allclose(np.einsum("bkp,bk->bp", s["maps"][:, :, 1:], y), f["beta"])


def test_ridge_with_more_predictors_than_neighbours():
    dist, x, y = np.sort(np.random.default_rng(2).random((3, 6)), axis=1), *(lambda r: (r.normal(size=(3, 6, 9)), r.normal(size=(3, 6))))(np.random.default_rng(3))
    f = solvers.solve(dist, x, y, Spec("ridge", 0.3, 0.0))
    for i in range(3):
        assert np.allclose(f["beta"][i], np.linalg.solve(f["m"].gram[i] + 0.3 * np.eye(9), f["m"].score[i]))
    assert f["converged"].all() and f["kkt"].max() < 1e-10


@pytest.mark.parametrize("model,gamma", [("scad", 3.7), ("mcp", 3.0)])
def test_nonconvex_audit(model, gamma):
    dist, x, y = batch(6, 30, 3, 8)
    spec = Spec(model, 0.1, gamma=gamma, tolerance=1e-9)
    f = solvers.solve(dist, x, y, spec)
    assert f["converged"].all() and f["gap"].max() <= 1e-8
    assert (solvers.coordinate_gaps(f["m"], f["beta"] + 0.05, spec) > 1e-5).all()
    # one sweep isn't enough, and the gap says so
    assert not solvers.solve(dist, x, y, Spec(model, 0.1, gamma=gamma, tolerance=1e-9, max_iterations=1))["converged"].any()
    top = solvers.nonconvex_lambda_max(f["m"], spec)
    g = np.einsum("bpp->bp", f["m"].gram)
    for i in range(6):
        assert (penalties.exact_minimum(f["m"].score[i], g[i], float(top[i]), gamma, model) == 0).all()
        assert (penalties.exact_minimum(f["m"].score[i], g[i], float(top[i]) * (1 - 1e-6), gamma, model) != 0).any()
    at = np.array([[gamma * 0.1, -gamma * 0.1, 0.0], [0.5, 0.02, 0.1]])
    assert solvers.knots(at, spec).tolist() == ([2, 1] if model == "scad" else [2, 0])


def test_audit_columns(example):
    xy, x = ["cx", "cy"], ["x1", "x2"]
    lad = workflow.fit(example, "y", x, xy, 18, "lad", lam=0.01).local.first()
    assert lad["primal_residual"] >= 0 and lad["dual_residual"] >= 0 and lad["max_kkt_violation"] == max(lad["primal_residual"], lad["dual_residual"])
    g = workflow.fit(example, "y", x, xy, 18, "scad", lam=0.02, guarded=True).local.agg(F.min("block_checks"), F.max("max_coordinate_gap"), F.min("active_coordinates")).first()
    assert g[0] >= 0 and g[1] < 1e-6 and g[2] >= 0
    plain = workflow.fit(example, "y", x, xy, 18).local.first()
    assert plain["max_coordinate_gap"] != plain["max_coordinate_gap"] and plain["pair_accepted"] is None and plain["knots"] == 0


def test_singular_predictors_use_the_pseudoinverse():
    dist, x, y = batch(2, 20, 3, 3)
    x[:, :, 2] = x[:, :, 1]
    f = solvers.solve(dist, x, y, Spec("gwr"))
    assert (f["status"] == 1).all() and np.allclose(f["beta"][:, 1], f["beta"][:, 2])
    z = solvers.solve(np.full((1, 20), np.nan), x[:1], y[:1], Spec("gwr"))
    assert z["status"][0] == 3 and np.isnan(z["beta"]).all()


def test_path_equals_single_fits(example):
    lambdas = [0.2, 0.08, 0.02]
    p = workflow.path(example, "y", ["x1", "x2"], ["cx", "cy"], 18, "lasso", lambdas, tolerance=1e-11)
    for k, lam in enumerate(lambdas):
        one = workflow.fit(example, "y", ["x1", "x2"], ["cx", "cy"], 18, "lasso", lam=lam, tolerance=1e-11)
        a = np.array([r["coef"] for r in p.filter(F.col("lambda_idx") == k).orderBy("target_id").collect()])
        b = np.array([r["coef"] for r in one.local.orderBy("target_id").collect()])
        assert np.abs(a - b).max() < 2e-7


def test_lambda_max_zeroes_everything(example):
    for penalty in ("lasso", "mcp"):
        rows = workflow.path(example, "y", ["x1", "x2"], ["cx", "cy"], 18, penalty, count=3)
        top = rows.filter("lambda_idx = 0").agg(F.max(F.greatest(F.abs(F.element_at("coef", 2)), F.abs(F.element_at("coef", 3))))).first()[0]
        assert top < 1e-9


def test_f_tests_against_dense_algebra(example):
    f = workflow.fit(example, "y", ["x1", "x2"], ["cx", "cy"], 18)
    data = local.standardised(example, f.x, f.centre, f.scale)
    e = advanced.smoother_edges(local.neighbourhoods(f.edges, data, "y", f.x), f.spec, f.centre, f.scale).collect()
    s, c = np.zeros((64, 64)), np.zeros((3, 64, 64))
    for r in e:
        s[r["i"] - 1, r["j"] - 1] = r["s"]
        c[:, r["i"] - 1, r["j"] - 1] = r["c"]
    y = np.array([r["y"] for r in example.orderBy("id").collect()])
    assert np.allclose(s @ y, [r["fitted"] for r in f.local.orderBy("target_id").collect()])
    q = (np.eye(64) - s).T @ (np.eye(64) - s)
    x = np.column_stack([np.ones(64), *[[r[n] for r in example.orderBy("id").collect()] for n in f.x]])
    h = x @ np.linalg.solve(x.T @ x, x.T)
    d1, d2 = np.trace(q), np.trace(q @ q)
    rss0, rss1, df = ((y - h @ y) ** 2).sum(), ((y - s @ y) ** 2).sum(), 61
    tests, f3 = advanced.f_tests(f)
    assert np.isclose(tests[0]["statistic"], (rss1 / d1) / (rss0 / df)) and np.isclose(tests[0]["df1"], d1**2 / d2)
    assert np.isclose(tests[1]["df1"], (df - d1) ** 2 / (df - 2 * (d1 - np.trace(q @ h)) + d2))
    j = np.eye(64) - 1 / 64
    for k in range(3):
        b = c[k].T @ j @ c[k] / 64
        assert np.isclose(f3[k]["df1"], np.trace(b) ** 2 / np.trace(b @ b))
    with pytest.raises(ValueError):
        advanced.f_tests(workflow.fit(example, "y", ["x1"], ["cx", "cy"], 18, "lasso", lam=0.1))


def test_process_model_first_order_equations(example):
    df = example.filter("id <= 24")
    e = neighbors.knn(df, 12, ["cx", "cy"]).persist()
    lap = advanced.graph_laplacian(e).persist()
    src = df.select(F.col("id").alias("i"), F.sin(F.col("id") / 4).alias("v"))
    mean = src.agg(F.avg("v")).first()[0]
    m = advanced.process_model(df, "y", ["x1", "x2"], e, lap, src.withColumn("v", F.col("v") - mean), lap, 2.0, 0.08, "gaussian")
    assert m["converged"] and m["process_centered"]
    u = np.array([r["process"] for r in m["local"].orderBy("target_id").collect()])
    assert abs(u.mean()) < 1e-9
    best = m["objective"]
    for d in (1.0, 4.0):
        assert advanced.process_model(df, "y", ["x1", "x2"], e, lap, src.withColumn("v", F.col("v") - mean), lap, d, 0.08, "gaussian")["objective"] * max(1, 2 / d) >= best - 1e-9
    with pytest.raises(ValueError):
        advanced.check_laplacian(lap.withColumn("v", F.col("v") + 1))


def test_inference_and_distributions(example):
    grid = np.linspace(0, 2.0, 200001)
    density = 0.3891083839660310 * (1 + grid**2 / 10) ** -5.5  # of t with 10 degrees of freedom
    assert np.isclose(distributions.t_two_sided(np.array([2.0]), 10)[0], 1 - 2 * np.trapezoid(density, grid), atol=1e-8)
    assert np.isclose(distributions.f_upper(3.0, 2, 20), 0.07256, atol=1e-4) and np.isclose(distributions.normal_two_sided(1.96), 0.04999579, atol=1e-7)
    f = workflow.fit(example, "y", ["x1", "x2"], ["cx", "cy"], 18, diagnostics="full")
    rows = f.inference(df="normal", adjust="none").collect()
    assert len(rows) == 192 and all(0 <= r["p_value"] <= 1 and r["standard_error"] > 0 for r in rows)


def test_permutations_are_stable(example):
    e = neighbors.knn(example, 9, ["cx", "cy"])
    w, v = statistics.spatial_weights(e), example.select("id", F.col("y").alias("residual"))
    a = statistics.permutation_moran(w, v, 19, 3)[0].first()
    b = statistics.permutation_moran(w.repartition(7), v.repartition(3), 19, 3)[0].first()
    assert np.allclose(list(a), list(b)) and a["p_value"] == 1 / 20


def test_kernels():
    r = np.array([0.0, 0.5, 1.0, 2.0])
    assert np.allclose(kernel_values(r, "bisquare"), [1, 0.5625, 0, 0]) and np.allclose(kernel_values(r, "boxcar"), [1, 1, 1, 0])
    assert np.allclose(kernel_values(r, "tricube"), [1, 0.875**3, 0, 0]) and np.allclose(kernel_values(r, "gaussian"), np.exp(-r * r / 2))


def test_bad_arguments(example):
    for o in ({"penalty": "scad", "gamma": 2.0}, {"penalty": "lasso", "d": 0.5}, {"penalty": "huber"}, {"penalty": "lasso", "lam": -1}):
        with pytest.raises(ValueError):
            workflow.spec_of(**o)
    with pytest.raises(ValueError):
        workflow.fit(example.withColumn("x1", F.lit(1.0)), "y", ["x1"], ["cx", "cy"], 18)


def test_process_model_query_fits_all_locations(spark):
    from loamgrid import queries

    got = queries.QUERIES["process_model"](spark, "/root/testdata/sf0.01")
    ids = queries.points(spark, "/root/testdata/sf0.01").select(F.col("id").alias("target_id"))
    assert got.count() == ids.count() > 400 and ids.join(got, "target_id", "left_anti").isEmpty()


def test_process_model_takes_few_steps(spark, monkeypatch):
    from loamgrid import queries
    from loamgrid.operators import multigrid

    monkeypatch.setattr(multigrid, "DENSE", 60)
    p = queries.points(spark, "/root/testdata/sf0.01")
    e = neighbors.knn(p, 15, ["cx", "cy"]).persist()
    lap = advanced.graph_laplacian(e).persist()
    src = p.select(F.col("id").alias("i"), F.sin(F.col("id") / 4).alias("v"))
    few = advanced.process_model(p, "y", ["x1", "x2"], e, lap, src, lap, max_iterations=60)
    assert few["converged"]
    # as another operator it is solved without the multigrid cycle
    many = advanced.process_model(p, "y", ["x1", "x2"], e, lap.withColumn("v", F.col("v") * 1.0), src, lap)
    assert many["converged"] and np.isclose(few["objective"], many["objective"], rtol=1e-9)
    a, b = (np.array([[*r["coef"], r["process"]] for r in m["local"].orderBy("target_id").collect()]) for m in (few, many))
    assert np.abs(a - b).max() < 1e-6


def test_process_model_of_an_unlinked_place(spark):
    rows = [(i, float(i % 7), float(i % 5), float(i), 0.5 * i) for i in range(40)]
    p = spark.createDataFrame(rows, "id long, cx double, cy double, x1 double, y double").withColumn("x2", F.sin("x1"))
    e = neighbors.knn(p, 8, ["cx", "cy"]).filter("target_id <> 3 and source_id <> 3").persist()
    lap = advanced.graph_laplacian(e).persist()
    m = advanced.process_model(p, "y", ["x1", "x2"], e, lap, p.select(F.col("id").alias("i"), F.lit(0.0).alias("v")), lap)
    got = {r["target_id"]: r for r in m["local"].collect()}
    assert m["converged"] and len(got) == 40 and abs(got[3]["fitted"]) < 1e-9 and abs(got[3]["coef"][1]) == 0


def test_local_fit_quality_broadcasts_no_edges(spark):
    from loamgrid import queries

    plan = queries.QUERIES["local_r_squared"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
