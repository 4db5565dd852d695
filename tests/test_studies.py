"""Simulated data, certificates and helpers of studies."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import distributions
from loamgrid.operators import graphs, statistics
from loamgrid.operators.solvers import Spec
from loamgrid.plans import studies, workflow
from loamgrid.sources import tables


@pytest.mark.parametrize("scenario", ["smooth", "regional", "stationary", "null", "collinear"])
@pytest.mark.parametrize("layout", ["uniform", "clustered", "l_shape"])
def test_simulation_is_deterministic(spark, scenario, layout):
    a = studies.simulate(spark, 200, 3, 5, scenario, layout)
    b = studies.simulate(spark, 200, 3, 5, scenario, layout).repartition(7)
    assert sorted(r["y"] for r in a.collect()) == sorted(r["y"] for r in b.collect())
    s = a.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy"), F.avg("x1"), F.stddev_pop("x1")).first()
    assert 0 <= s[0] <= s[1] <= 1 and 0 <= s[2] <= s[3] <= 1 and abs(s[4]) < 0.3 and 0.8 < s[5] < 1.2


def test_duality_gap():
    r = np.random.default_rng(0)
    x, dist = r.normal(size=(4, 30, 3)), np.sort(r.random((4, 30)), axis=1)
    y = x @ np.array([1.0, 0, -0.5]) + 0.1 * r.normal(size=(4, 30))
    for model, alpha in (("lasso", 1.0), ("en", 0.5)):
        tight = studies.kkt_gap(dist, x, y, Spec(model, 0.1, alpha, tolerance=1e-12))
        loose = studies.kkt_gap(dist, x, y, Spec(model, 0.1, alpha, max_iterations=1))
        assert (tight > -1e-10).all() and (tight < 1e-8).all() and (loose >= tight - 1e-12).all()


def test_oracle_retry_and_cache(spark):
    d = studies.simulate(spark, 150, 3, 2, "regional").persist()
    assert studies.oracle_union(d, "y", "truth", ["x1", "x2", "x3"], ["cx", "cy"], 40).x == ["x1", "x2"]
    rows, cap = studies.path_with_retry(d, "y", ["x1", "x2"], ["cx", "cy"], 40, "scad", [0.2, 0.05], caps=(1, 5000))
    assert cap == 5000 and rows.filter(~F.col("converged")).isEmpty()
    c = studies.fold_cache(d.withColumn("f", F.col("id") % 3), ["x1"], ["cx", "cy"], 10, "f")
    assert set(c) == {0, 1, 2} and c[0]["edges"].filter("target_id % 3 <> 0 or source_id % 3 = 0").isEmpty()


def test_folds(spark):
    d = studies.simulate(spark, 200, 2, 3)
    got = workflow.spatial_folds(d, ["cx", "cy"], 4, 1)
    assert got.columns == [*d.columns, "fold"] and got.select("fold").distinct().count() == 4


def test_progress_and_palette(tmp_path):
    p = str(tmp_path / "p.json")
    studies.progress(p, 5, 10, time.time() - 1)
    assert json.load(open(p))["total"] == 10
    assert len(studies.bivariate_palette(3)) == 9 and studies.bivariate_palette(2) == ["#e8e8e8", "#be64ac", "#5ac8c8", "#3b4994"]


def test_local_oracle(spark):
    df = spark.range(80).select("id", (F.col("id") * 37 % 101 / 101.0).alias("cx"), (F.col("id") * 53 % 97 / 97.0).alias("cy"), F.sin(F.col("id") / 3.0).alias("a"), F.cos(F.col("id") / 5.0).alias("b"))
    df = df.withColumn("truth", F.array((F.col("id") % 2).cast("double"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0))).withColumn("y", 1 + F.col("truth")[0] * F.col("a") + F.col("truth")[1] * F.col("b") + 0.1 * F.sin(F.col("id") * 1.3)).persist()
    got = {r["target_id"]: r for r in studies.oracle_local(df, "y", "truth", ["a", "b"], ["cx", "cy"], 20).collect()}
    assert {r["support"] for r in got.values()} == {"00", "01", "10", "11"}
    for names, support in ((["a"], "10"), (["b"], "01"), (["a", "b"], "11")):
        f = {r["target_id"]: r for r in workflow.fit(df, "y", names, ["cx", "cy"], 20).local.collect()}
        for i, r in got.items():
            if r["support"] == support:
                assert abs(r["fitted"] - f[i]["fitted"]) < 1e-9 and abs(r["coef"][0] - f[i]["coef"][0]) < 1e-8
                assert [c for c in r["coef"][1:] if c] == pytest.approx(f[i]["coef"][1:])


def test_intervals_of_paired_differences(spark):
    assert abs(distributions.t_quantile(0.975, 9) - 2.2621571628540993) < 1e-9 and abs(distributions.t_quantile(0.05, 3) + 2.353363434801823) < 1e-9
    rows = [(k, m, 0.0, v) for k in range(10) for m, v in (("ols", 2.0 + 0.01 * k), ("good", 1.0), ("same", 2.0 + 0.01 * ((k * 7) % 10)))]
    losses = statistics.paired_loss(spark.createDataFrame(rows, "sample int, method string, observed double, prediction double"), [], "method", "sample")
    got = {r["method"]: r for r in statistics.paired_interval(losses).collect()}
    assert got["good"]["favours"] == "good" and got["good"]["high"] < 0 and got["same"]["favours"] == "neither"
    assert abs(got["good"]["high"] - got["good"]["mean_difference"] - 2.2621571628540993 * got["good"]["standard_error"]) < 1e-9


def test_alignment_asserts_coordinates(spark):
    a = spark.createDataFrame([(1, 0.0, 5), (2, 1.0, 6)], "id int, cx double, u int")
    b = spark.createDataFrame([(2, 1.0, 7), (3, 2.0, 8)], "id int, cx double, v int")
    assert [tuple(r) for r in tables.align([a, b], "id", ["cx"]).select("id", "cx", "u", "v").collect()] == [(2, 1.0, 6, 7)]
    for bad in (b.withColumn("cx", F.col("cx") + 1), b.unionByName(b)):
        with pytest.raises(ValueError):
            tables.align([a, bad], "id", ["cx"])


def test_contact_along_an_edge(spark):
    """A square whose side touches the middle of a longer side, without a shared corner."""
    rings = {1: [(0, 0), (10, 0), (10, 30), (0, 30)], 2: [(10, 10), (20, 10), (20, 20), (10, 20)], 3: [(40, 0), (50, 0), (50, 10)], 4: [(20, 20), (30, 20), (30, 30)]}
    df = spark.createDataFrame([(i, k, float(x), float(y)) for i, ring in rings.items() for k, (x, y) in enumerate(ring)], "id int, seq int, x double, y double")
    pairs = lambda d: {(r["i"], r["j"]) for r in d.collect()}
    assert pairs(graphs.queen_contiguity(df, 0.5)) == {(2, 4), (4, 2)}
    assert pairs(graphs.edge_contacts(df, 0.5)) == {(1, 2), (2, 1), (2, 4), (4, 2)}
