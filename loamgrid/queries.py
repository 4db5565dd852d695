"""Queries over the driver's tables, each with its DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formula, penalties, ranking, survey, weights
from .operators import advanced, graphs, local, neighbors, statistics, surfaces
from .plans import workflow
from .sources import tables
from .streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K, XY = 20, ["cx", "cy"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def out(df: DataFrame, *names: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    return df.select(*keys, *[r6(n).alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located observations derived from ``part`` by integer arithmetic."""
    p, d = F.col("p_partkey"), lambda v: F.lit(float(v))
    df = table(spark, sf_dir, "part").select(
        p.alias("id"), (((p * p * 31 + p * 7919) % 10007) / d(10007)).alias("cx"), (((p * p * 17 + p * 6101) % 9973) / d(9973)).alias("cy"),
        (F.col("p_size") / d(10)).alias("x1"), (((p * 37) % 97) / d(97)).alias("x2"), (((p * 17) % 101) / d(101)).alias("_e"),
    )
    y = d(1) + (d(0.8) + F.col("cx")) * F.col("x1") - d(0.7) * F.col("cy") * F.col("x2") + d(0.05) * F.col("_e")
    return df.withColumn("y", y).drop("_e")


PTS = """p0 AS (SELECT p_partkey AS id, ((p_partkey*p_partkey*31 + p_partkey*7919) % 10007) / 10007::DOUBLE AS cx,
  ((p_partkey*p_partkey*17 + p_partkey*6101) % 9973) / 9973::DOUBLE AS cy, p_size / 10::DOUBLE AS x1,
  ((p_partkey*37) % 97) / 97::DOUBLE AS x2, ((p_partkey*17) % 101) / 101::DOUBLE AS e FROM part),
pts AS (SELECT id, cx, cy, x1, x2, 1::DOUBLE + (0.8::DOUBLE + cx)*x1 - 0.7::DOUBLE*cy*x2 + 0.05::DOUBLE*e AS y FROM p0)"""
DIST = "sqrt((t.cx-s.cx)*(t.cx-s.cx)+(t.cy-s.cy)*(t.cy-s.cy))"


def knn_sql(k: int, name: str = "knn") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT t.id AS target_id, s.id AS source_id, {DIST} AS dist,
  (row_number() OVER (PARTITION BY t.id ORDER BY CASE WHEN s.id = t.id THEN -1.0 ELSE {DIST} END, s.id) - 1)::INTEGER AS rank
  FROM pts t, pts s) WHERE rank < {k})"""


def weight_sql(kernel: str = "bisquare", edges: str = "knn") -> str:
    r = "(dist / b)"
    w = {"gaussian": f"exp(-0.5*{r}*{r})", "bisquare": f"CASE WHEN {r} < 1 THEN pow(1-{r}*{r}, 2) ELSE 0 END", "exponential": f"exp(-{r})", "tricube": f"CASE WHEN {r} < 1 THEN pow(1-{r}*{r}*{r}, 3) ELSE 0 END", "boxcar": f"CASE WHEN {r} <= 1 THEN 1.0::DOUBLE ELSE 0 END"}[kernel]
    return f"""wb AS (SELECT *, max(dist) OVER (PARTITION BY target_id) * (1 + 1e-10) AS b FROM {edges}),
ww AS (SELECT *, {w} AS w FROM wb), we AS (SELECT *, w / sum(w) OVER (PARTITION BY target_id) AS wn FROM ww)"""


STD = """sd AS (SELECT avg(x1) AS c1, stddev_pop(x1) AS d1, avg(x2) AS c2, stddev_pop(x2) AS d2 FROM pts),
zp AS (SELECT pts.*, (x1-c1)/d1 AS z1, (x2-c2)/d2 AS z2, c1, d1, c2, d2 FROM pts, sd)"""
MOM = """ez AS (SELECT we.*, z1, z2, y FROM we JOIN zp ON zp.id = we.source_id),
mm AS (SELECT target_id, sum(wn*z1) AS m1, sum(wn*z2) AS m2, sum(wn*y) AS my, sum(w) AS tw FROM ez GROUP BY target_id),
gg AS (SELECT target_id, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, sum(wn*(z1-m1)*(z1-m1)) AS g11, sum(wn*(z1-m1)*(z2-m2)) AS g12,
  sum(wn*(z2-m2)*(z2-m2)) AS g22, sum(wn*(z1-m1)*(y-my)) AS s1, sum(wn*(z2-m2)*(y-my)) AS s2 FROM ez JOIN mm USING (target_id) GROUP BY target_id)"""


def base_sql(k: int = K, kernel: str = "bisquare") -> str:
    return f"WITH {PTS}, {knn_sql(k)}, {weight_sql(kernel)}, {STD}, {MOM}"


def linear_sql(lam: float = 0.0) -> str:
    """Two-predictor (ridge) coefficients in closed form."""
    return f"""bb AS (SELECT *, (g11+{lam})*(g22+{lam})-g12*g12 AS det FROM gg),
cc AS (SELECT *, ((g22+{lam})*s1-g12*s2)/det AS b1, ((g11+{lam})*s2-g12*s1)/det AS b2 FROM bb),
ff AS (SELECT cc.target_id, b1, b2, m1, m2, my, g11, g12, g22, det, z.z1 AS o1, z.z2 AS o2, z.y AS y, b1/d1 AS beta1, b2/d2 AS beta2,
  my-b1*m1-b2*m2-b1/d1*c1-b2/d2*c2 AS beta0, my+b1*(z.z1-m1)+b2*(z.z2-m2) AS fitted FROM cc JOIN zp z ON z.id = cc.target_id)"""


def rr(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


# --- scans and projections ------------------------------------------------

@query(f"WITH {PTS} SELECT id, {rr('cx', 'cy', 'x1', 'x2', 'y')} FROM pts")
def points_part(spark, sf_dir):
    return out(points(spark, sf_dir), "cx", "cy", "x1", "x2", "y")


@query("""SELECT c_custkey AS id, round(((c_custkey*c_custkey*31 + c_custkey*7919) % 10007) / 10007::DOUBLE, 6) AS cx, round(c_acctbal/1000, 6) AS y,
 count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total_price, any_value(c_mktsegment) AS seg
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal""")
def points_customer(spark, sf_dir):
    c = F.col("c_custkey")
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total_price"))
    df = table(spark, sf_dir, "customer").join(per, "c_custkey", "left")
    return df.select(c.alias("id"), F.round(((c * c * 31 + c * 7919) % 10007) / F.lit(10007.0), 6).alias("cx"), F.round(F.col("c_acctbal") / 1000, 6).alias("y"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total_price", F.lit(0.0)), 2).alias("total_price"), F.col("c_mktsegment").alias("seg"))


@query(f"WITH {PTS}, {STD} SELECT id, round(z1, 6) + 0.0 AS x1, round(z2, 6) + 0.0 AS x2 FROM zp")
def standardised_design(spark, sf_dir):
    p = points(spark, sf_dir)
    return out(local.standardised(p, ["x1", "x2"], *local.standardisation(p, ["x1", "x2"])), "x1", "x2")


@query("""SELECT c_custkey AS id, CASE WHEN t IS NULL THEN 'json_null' WHEN trim(t) = '' THEN 'blank' WHEN try_cast(trim(t) AS DOUBLE) IS NULL THEN 'nonnumeric'
 WHEN try_cast(trim(t) AS DOUBLE) = -555555555 THEN 'sentinel_controlled_moe' WHEN try_cast(trim(t) AS DOUBLE) = -666666666 THEN 'sentinel_insufficient_sample'
 WHEN try_cast(trim(t) AS DOUBLE) < 0 THEN 'other_negative' ELSE 'observed' END AS status,
 CASE WHEN try_cast(trim(t) AS DOUBLE) = -555555555 THEN 0.0 WHEN try_cast(trim(t) AS DOUBLE) >= 0 THEN try_cast(trim(t) AS DOUBLE) END AS margin
 FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'n/a' WHEN 3 THEN '-555555555' WHEN 4 THEN ' -666666666' WHEN 5 THEN '-12' ELSE ' ' || c_custkey END AS t FROM customer)""")
def survey_decoding(spark, sf_dir):
    k = F.col("c_custkey")
    t = F.when(k % 7 == 0, None).when(k % 7 == 1, "  ").when(k % 7 == 2, "n/a").when(k % 7 == 3, "-555555555").when(k % 7 == 4, " -666666666").when(k % 7 == 5, "-12").otherwise(F.concat(F.lit(" "), k.cast("string")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), t.alias("t")).select("id", survey.survey_status(F.col("t")).alias("status"), survey.survey_margin(F.col("t")).alias("margin"))


@query("""SELECT id, concat_ws(';', CASE WHEN a IS NULL THEN 'missing_estimate:a' END, CASE WHEN b IS NULL THEN 'missing_estimate:b' END, CASE WHEN b <= 0 THEN 'nonpositive_response' END) AS reason
 FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS b FROM customer)""")
def eligibility(spark, sf_dir):
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    df = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 > 0, v).alias("a"), F.when(k % 4 > 0, v).alias("b"))
    return df.select("id", survey.exclusion_reason(["a", "b"], "b").alias("reason"))


@query("SELECT id, round(sign(z)*greatest(abs(z)-0.4, 0), 9) + 0.0 AS soft, round(CASE WHEN abs(z) <= 0.9 THEN 0.3*abs(z)-z*z/6 ELSE 0.135 END, 9) AS mcp, round(CASE WHEN abs(z) <= 0.3 THEN 0.3*abs(z) WHEN abs(z) <= 1.11 THEN (2.22*abs(z)-z*z-0.09)/5.4 ELSE 0.2115 END, 9) AS scad FROM (SELECT c_custkey AS id, c_acctbal/4000 AS z FROM customer)")
def penalty_values(spark, sf_dir):
    z = F.col("c_acctbal") / 4000
    r9 = lambda c: F.round(c, 9) + F.lit(0.0)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), r9(penalties.soft_threshold(z, F.lit(0.4))).alias("soft"), r9(penalties.penalty_column(z, 0.3, 3.0, "mcp")).alias("mcp"), r9(penalties.penalty_column(z, 0.3, 3.7, "scad")).alias("scad"))


# --- neighbours and weights -----------------------------------------------

EDGE = ("target_id", "source_id", "rank")


@query(f"WITH {PTS}, {knn_sql(K)} SELECT target_id, source_id, rank, round(dist, 6) AS dist FROM knn")
def knn_self(spark, sf_dir):
    return out(neighbors.knn(points(spark, sf_dir), K, XY), "dist", keys=EDGE)


@query(f"WITH {PTS}, {knn_sql(K)} SELECT target_id, source_id, rank, round(dist, 6) AS dist FROM knn")
def knn_cells(spark, sf_dir):
    return out(neighbors.knn(points(spark, sf_dir), K, XY, broadcast_bytes=0), "dist", keys=EDGE)


GRID = "g AS (SELECT i AS id, (i % 16 + 0.5::DOUBLE) / 16 AS cx, (i // 16 + 0.5::DOUBLE) / 16 AS cy FROM range(256) r(i))"
CROSS = GRID + """, cross_ AS (SELECT * FROM (SELECT t.id AS target_id, s.id AS source_id, sqrt((t.cx-s.cx)*(t.cx-s.cx)+(t.cy-s.cy)*(t.cy-s.cy)) AS dist,
 (row_number() OVER (PARTITION BY t.id ORDER BY sqrt((t.cx-s.cx)*(t.cx-s.cx)+(t.cy-s.cy)*(t.cy-s.cy)), s.id) - 1)::INTEGER AS rank FROM g t, pts s) WHERE rank < 12)"""


def grid_points(spark) -> DataFrame:
    return statistics.grid(spark, 16, 16).select(F.col("grid_id").alias("id"), F.col("x").alias("cx"), F.col("y").alias("cy"))


@query(f"WITH {PTS}, {CROSS} SELECT target_id, source_id, rank, round(dist, 6) AS dist FROM cross_")
def knn_cross(spark, sf_dir):
    return out(neighbors.knn(points(spark, sf_dir), 12, XY, targets=grid_points(spark)), "dist", keys=EDGE)


@query(f"WITH {PTS} SELECT t.id AS target_id, count(*) AS n, round(max({DIST}), 6) AS furthest FROM pts t, pts s WHERE {DIST} < 0.05 GROUP BY t.id")
def radius_neighbours(spark, sf_dir):
    e = neighbors.radius_summary(points(spark, sf_dir), 0.05, XY)
    return e.select("target_id", "n", r6("furthest").alias("furthest"))


@query(f"WITH {PTS} SELECT t.id AS id, round(min({DIST}), 6) AS nearest FROM pts t, pts s WHERE t.id % 5 = 0 AND s.id % 5 <> 0 GROUP BY t.id")
def nearest_training_distance(spark, sf_dir):
    p = points(spark, sf_dir)
    e = neighbors.knn(p.filter("id % 5 <> 0"), 1, XY, targets=p.filter("id % 5 = 0"))
    return e.select(F.col("target_id").alias("id"), r6("dist").alias("nearest"))


def _weights(kernel: str):
    def run(spark, sf_dir):
        e = weights.weighted_edges(neighbors.knn(points(spark, sf_dir), K, XY), kernel)
        return out(e, "w", "wn", keys=("target_id", "source_id"))

    run.__name__ = f"weights_{kernel}"
    query(f"WITH {PTS}, {knn_sql(K)}, {weight_sql(kernel)} SELECT target_id, source_id, {rr('w', 'wn')} FROM we")(run)


for _k in weights.KERNELS:
    _weights(_k)


@query(f"WITH {PTS}, {knn_sql(K)} SELECT round(median(dist) FILTER (WHERE rank = 1), 6) AS typical_nn, round(median(dist) FILTER (WHERE rank = (SELECT greatest(2, least(20, ceil(sqrt(count(*)))))::INTEGER FROM pts)), 6) AS auto_bandwidth FROM (SELECT * FROM knn WHERE target_id <> source_id)")
def typical_distances(spark, sf_dir):
    return statistics.nearest_distances(neighbors.knn(points(spark, sf_dir), K, XY)).select(r6("typical_nn").alias("typical_nn"), r6("auto_bandwidth").alias("auto_bandwidth"))


@query(f"WITH {PTS}, u AS (SELECT id, radians(cx*360-180) AS a, radians(cy*180-90) AS b FROM pts), v AS (SELECT id, cos(b)*cos(a) AS ux, cos(b)*sin(a) AS uy, sin(b) AS uz FROM u) SELECT t.id, round(2*6371008.8*asin(least(greatest(sqrt(pow(t.ux-s.ux,2)+pow(t.uy-s.uy,2)+pow(t.uz-s.uz,2))/2, -1), 1)), 2) AS metres FROM v t, v s WHERE s.id = 1")
def great_circle(spark, sf_dir):
    p = neighbors.unit_sphere(points(spark, sf_dir).withColumn("lon", F.col("cx") * 360 - 180).withColumn("lat", F.col("cy") * 180 - 90), "lon", "lat")
    one = p.filter("id = 1").select(*[F.col(c).alias(f"o{c}") for c in ("ux", "uy", "uz")])
    chord = F.sqrt((F.col("ux") - F.col("oux")) ** 2 + (F.col("uy") - F.col("ouy")) ** 2 + (F.col("uz") - F.col("ouz")) ** 2)
    return p.join(F.broadcast(one)).select("id", F.round(neighbors.arc_metres(chord), 2).alias("metres"))


# --- local models ---------------------------------------------------------

def _fit(spark, sf_dir, x=("x1", "x2"), penalty="gwr", **o):
    return workflow.fit(points(spark, sf_dir), "y", list(x), XY, K, penalty, **o)


COEF = ("beta0", "beta1", "beta2", "fitted")


def _coef(f) -> DataFrame:
    return f.local.select(F.col("target_id").alias("id"), *[r6(F.element_at("coef", i + 1)).alias(f"beta{i}") for i in range(len(f.x) + 1)], r6("fitted").alias("fitted"))


@query(f"{base_sql()}, {linear_sql()} SELECT target_id AS id, {rr(*COEF)} FROM ff")
def gwr_coefficients(spark, sf_dir):
    return _coef(_fit(spark, sf_dir))


@query(f"{base_sql(kernel='gaussian')}, {linear_sql(0.1)} SELECT target_id AS id, {rr(*COEF)} FROM ff")
def ridge_coefficients(spark, sf_dir):
    return _coef(_fit(spark, sf_dir, penalty="ridge", lam=0.1, kernel="gaussian"))


def one_sql(beta: str) -> str:
    return f"""{base_sql()}, cc AS (SELECT *, {beta} AS b FROM gg)
SELECT target_id AS id, round(my-b*m1-b/d1*c1, 6) + 0.0 AS beta0, round(b/d1, 6) + 0.0 AS beta1, round(my+b*(z1-m1), 6) + 0.0 AS fitted FROM cc JOIN zp ON zp.id = cc.target_id"""


def _one(name: str, beta: str, penalty: str, **o) -> None:
    def run(spark, sf_dir):
        return _coef(_fit(spark, sf_dir, ("x1",), penalty, tolerance=1e-12, **o))

    run.__name__ = name
    query(one_sql(beta))(run)


_one("lasso_coefficients", "sign(s1)*greatest(abs(s1)-0.3, 0)/g11", "lasso", lam=0.3)
_one("elastic_net_coefficients", "sign(s1)*greatest(abs(s1)-0.15, 0)/(g11+0.15)", "elastic_net", lam=0.3, alpha=0.5)
_one("scaled_lasso_coefficients", "sign(s1+0.1*0.6*s1/g11)*greatest(abs(s1+0.1*0.6*s1/g11)-0.1, 0)/(g11+0.1)", "scaled_lasso", lam=0.2, alpha=0.5, d=0.6)
_one("scad_coefficients", "sign(s1)*CASE WHEN abs(s1) <= 0.4 THEN 0 WHEN abs(s1) <= 0.4*(1+g11) THEN (abs(s1)-0.4)/g11 WHEN abs(s1) <= g11*8 THEN (abs(s1)-8/19.0)/(g11-1/19.0) ELSE abs(s1)/g11 END", "scad", lam=0.4, gamma=20.0)
_one("mcp_coefficients", "sign(s1)*CASE WHEN abs(s1) <= 0.4 THEN 0 WHEN abs(s1) <= g11*8 THEN (abs(s1)-0.4)/(g11-1/20.0) ELSE abs(s1)/g11 END", "mcp", lam=0.4, gamma=20.0)


@query()
def lad_coefficients(spark, sf_dir):
    return _coef(_fit(spark, sf_dir, penalty="lad", lam=0.01))


@query()
def nonconvex_two_predictors(spark, sf_dir):
    return _coef(_fit(spark, sf_dir, penalty="mcp", lam=0.05))


@query(f"""WITH {PTS}, knn AS (SELECT * FROM (SELECT t.id AS target_id, s.id AS source_id, {DIST} AS dist, row_number() OVER (PARTITION BY t.id ORDER BY {DIST}, s.id) - 1 AS rank
 FROM pts t, pts s WHERE t.id % 10 = 0 AND s.id % 10 <> 0) WHERE rank < {K}), {weight_sql()},
sd AS (SELECT avg(x1) AS c1, stddev_pop(x1) AS d1, avg(x2) AS c2, stddev_pop(x2) AS d2 FROM pts WHERE id % 10 <> 0), zp AS (SELECT pts.*, (x1-c1)/d1 AS z1, (x2-c2)/d2 AS z2, c1, d1, c2, d2 FROM pts, sd),
{MOM}, {linear_sql()} SELECT target_id AS id, {rr(*COEF)} FROM ff""")
def predict_new_locations(spark, sf_dir):
    p = points(spark, sf_dir)
    f = workflow.fit(p.filter("id % 10 <> 0"), "y", ["x1", "x2"], XY, K)
    got = f.predict(p.filter("id % 10 = 0"))
    return got.select(F.col("target_id").alias("id"), *[r6(F.element_at("coef", i + 1)).alias(f"beta{i}") for i in range(3)], r6("fitted").alias("fitted"))


# --- diagnostics ----------------------------------------------------------

HAT = """uu AS (SELECT *, (g22*(o1-m1)-g12*(o2-m2))/det AS u1, (g11*(o2-m2)-g12*(o1-m1))/det AS u2 FROM ff),
sm AS (SELECT e.target_id, sum(CASE WHEN e.source_id = e.target_id THEN wn*(1+u1*(z1-m1)+u2*(z2-m2)) ELSE 0 END) AS h, sum(pow(wn*(1+u1*(z1-m1)+u2*(z2-m2)), 2)) AS s2,
 1/sum(wn*wn) AS ess FROM ez e JOIN uu USING (target_id) GROUP BY e.target_id)"""


@query(f"{base_sql()}, {linear_sql()}, {HAT} SELECT target_id AS id, round(h, 6) AS leverage, round(s2, 6) AS row_norm2, round(ess, 6) AS effective_sample_size FROM sm")
def leverage(spark, sf_dir):
    f = _fit(spark, sf_dir)
    return f.local.select(F.col("target_id").alias("id"), r6("leverage").alias("leverage"), r6("smoother_row_norm2").alias("row_norm2"), r6("effective_sample_size").alias("effective_sample_size"))


SCALARS = ["n", "rss", "tss", "rmse", "mae", "bias", "r_squared", "adjusted_r_squared", "trS", "trStS", "enp", "edf", "sigma2", "deviance", "logLik", "model_df", "aic", "aicc", "bic", "gcv", "loo_cv"]


@query(f"""{base_sql()}, {linear_sql()}, {HAT}, a AS (SELECT count(*)::DOUBLE AS n, sum(pow(y-fitted, 2)) AS rss, var_pop(y)*count(*) AS tss, avg(abs(y-fitted)) AS mae, avg(y-fitted) AS bias, sum(h) AS trS, sum(s2) AS trStS, sum(pow((y-fitted)/(1-h), 2)) AS loo_cv FROM ff JOIN sm USING (target_id)),
b AS (SELECT *, sqrt(rss/n) AS rmse, 1-rss/tss AS r_squared, 2*trS-trStS AS enp, n-2*trS+trStS AS edf, n*(ln(rss/n)+ln(2*pi())+1) AS deviance, trS+1 AS model_df FROM a)
SELECT round(n,4) AS n, round(rss,4) AS rss, round(tss,4) AS tss, round(rmse,4) AS rmse, round(mae,4) AS mae, round(bias,4)+0.0 AS bias, round(r_squared,4) AS r_squared, round(1-(1-r_squared)*(n-1)/edf,4) AS adjusted_r_squared, round(trS,4) AS trS, round(trStS,4) AS trStS, round(enp,4) AS enp, round(edf,4) AS edf,
 round(rss/edf,4) AS sigma2, round(deviance,4) AS deviance, round(-0.5*deviance,4) AS logLik, round(model_df,4) AS model_df, round(deviance+2*model_df,4) AS aic, round(deviance+2*n*model_df/(n-trS-2),4) AS aicc, round(deviance+ln(n)*model_df,4) AS bic, round(rss/n/pow(1-trS/n,2),4) AS gcv, round(loo_cv,4) AS loo_cv FROM b""")
def gwr_diagnostics(spark, sf_dir):
    return _fit(spark, sf_dir).diagnostics().select(*[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in SCALARS])


@query(f"{base_sql()}, {linear_sql()}, q AS (SELECT e.target_id, wn, e.y, f.fitted, sum(wn*e.y) OVER (PARTITION BY e.target_id) AS m FROM ez e JOIN ff f ON f.target_id = e.source_id) SELECT target_id AS id, round(1-sum(wn*pow(y-fitted,2))/sum(wn*pow(y-m,2)), 6) AS local_r_squared, round(sqrt(sum(wn*pow(y-fitted,2))), 6) AS local_rmse, round(sum(wn*abs(y-fitted)), 6) AS local_mae, count(*) FILTER (WHERE wn > 1e-12)::INTEGER AS positive_weights FROM q GROUP BY target_id")
def local_r_squared(spark, sf_dir):
    f = _fit(spark, sf_dir)
    q = statistics.local_fit_quality(weights.weighted_edges(f.edges, "bisquare"), f.local.select(F.col("target_id").alias("id"), (F.col("fitted") + F.col("residual")).alias("y"), "fitted"))
    return q.select(F.col("target_id").alias("id"), r6("local_r_squared").alias("local_r_squared"), r6("local_rmse").alias("local_rmse"), r6("local_mae").alias("local_mae"), "positive_weights")


@query(f"{base_sql()}, {linear_sql()}, l AS (SELECT '(Intercept)' AS coefficient, beta0 AS v FROM ff UNION ALL SELECT 'x1', beta1 FROM ff UNION ALL SELECT 'x2', beta2 FROM ff) SELECT coefficient, round(avg(v),6)+0.0 AS mean, round(stddev_samp(v),6) AS sd, round(min(v),6)+0.0 AS min, round(quantile_cont(v,0.25),6)+0.0 AS q25, round(quantile_cont(v,0.5),6)+0.0 AS median, round(quantile_cont(v,0.75),6)+0.0 AS q75, round(max(v),6)+0.0 AS max, round(avg(CASE WHEN abs(v) <= 1e-10 THEN 1.0 ELSE 0.0 END),6) AS zero_fraction FROM l GROUP BY coefficient")
def coefficient_summary(spark, sf_dir):
    s = _fit(spark, sf_dir).summary()
    return s.select("coefficient", *[r6(c).alias(c) for c in s.columns[1:]])


@query(f"WITH {PTS}, a AS (SELECT corr(x1,x2) AS r FROM pts) SELECT round(r, 6) + 0.0 AS correlation, round(sqrt((1+abs(r))/(1-abs(r))), 6) AS condition_number, round(1/(1-r*r), 6) AS vif FROM a")
def global_collinearity(spark, sf_dir):
    g = statistics.global_collinearity(points(spark, sf_dir), ["x1", "x2"])
    return spark.range(1).select(r6(F.lit(float(g["correlation"][0, 1]))).alias("correlation"), r6(F.lit(float(g["condition_number"]))).alias("condition_number"), r6(F.lit(float(g["vif"][0]))).alias("vif"))


LOCALR = f"{base_sql()}, rr AS (SELECT target_id, g12/sqrt(g11*g22) AS r FROM gg)"


@query(f"{LOCALR} SELECT target_id AS id, round(r, 6) + 0.0 AS correlation, round(sqrt((1+abs(r))/(1-abs(r))), 6) AS condition_number, round(1/(1-r*r), 6) AS vif FROM rr")
def local_collinearity_pair(spark, sf_dir):
    p = points(spark, sf_dir)
    w = weights.weighted_edges(neighbors.knn(p, K, XY), "bisquare")
    return statistics.pair_condition(w, p, ["x1", "x2"]).select(F.col("location").alias("id"), r6("correlation").alias("correlation"), r6("condition_number").alias("condition_number"), r6("vif").alias("vif"))


@query(f"{LOCALR} SELECT target_id AS id, round(sqrt((1+abs(r))/(1-abs(r))), 6) AS condition_number, round(abs(r), 6) AS max_abs_correlation, (sqrt((1+abs(r))/(1-abs(r))) > 3 OR 1/(1-r*r) > 2) AS flagged FROM rr")
def local_collinearity(spark, sf_dir):
    p = points(spark, sf_dir)
    w = weights.weighted_edges(neighbors.knn(p, K, XY), "bisquare")
    c = statistics.local_collinearity(w, p, ["x1", "x2"], cn_limit=3.0, vif_limit=2.0)
    return c.select(F.col("location").alias("id"), r6("condition_number").alias("condition_number"), r6("max_abs_correlation").alias("max_abs_correlation"), "flagged")


MORAN = f"WITH {PTS}, {knn_sql(9)}, wt AS (SELECT target_id AS i, source_id AS j, 1/8::DOUBLE AS v FROM knn WHERE source_id <> target_id), z AS (SELECT id, y - avg(y) OVER () AS z, y FROM pts)"


def _moran_input(spark, sf_dir):
    p = points(spark, sf_dir)
    return statistics.spatial_weights(neighbors.knn(p, 9, XY)), p.select("id", F.col("y").alias("residual"))


@query(f"{MORAN} SELECT (SELECT count(*) FROM pts) AS n, round((SELECT count(*) FROM pts)/sum(v)*sum(v*a.z*b.z)/(SELECT sum(z*z) FROM z), 6) + 0.0 AS observed, round(-1/((SELECT count(*) FROM pts)-1)::DOUBLE, 6) AS expected FROM wt JOIN z a ON a.id = i JOIN z b ON b.id = j")
def moran(spark, sf_dir):
    return statistics.moran(*_moran_input(spark, sf_dir)).select("n", r6("observed").alias("observed"), r6("expected").alias("expected"))


@query(f"{MORAN}, lg AS (SELECT i, sum(v*z) AS lag FROM wt JOIN z ON z.id = j GROUP BY i) SELECT z.id, round(z.z*lag/(SELECT avg(z*z) FROM z), 6) + 0.0 AS local_i, round(lag, 6) + 0.0 AS spatial_lag FROM z JOIN lg ON lg.i = z.id")
def local_moran(spark, sf_dir):
    m = statistics.local_moran(*_moran_input(spark, sf_dir))
    return m.select(F.col("location").alias("id"), r6("local_I").alias("local_i"), r6("spatial_lag").alias("spatial_lag"))


@query(f"""{MORAN}, perms AS (SELECT unnest(range(0, 50)) AS perm), m2 AS (SELECT avg(z*z) AS m2 FROM z),
sl AS (SELECT perm, id, z, row_number() OVER (PARTITION BY perm ORDER BY md5('1:' || perm || ':' || id), id) AS slot FROM z, perms),
zp AS (SELECT a.perm, b.id AS i, a.z FROM sl a JOIN sl b ON b.perm = 0 AND b.slot = a.slot WHERE a.perm > 0),
lg AS (SELECT zp.perm, wt.i, sum(v*zp.z) AS lag FROM wt JOIN zp ON zp.i = wt.j GROUP BY zp.perm, wt.i),
st AS (SELECT lg.i, zp.z*lag/m2 AS s FROM lg JOIN zp ON zp.perm = lg.perm AND zp.i = lg.i, m2),
mo AS (SELECT i, avg(s) AS m, stddev_samp(s) AS d FROM st GROUP BY i),
ob AS (SELECT a.id, any_value(a.z) AS z, sum(v*b.z) AS lag FROM z a JOIN wt ON wt.i = a.id JOIN z b ON b.id = wt.j GROUP BY a.id),
pv AS (SELECT ob.id, any_value(ob.z) AS z, any_value(lag) AS lag, any_value(ob.z*lag/m2) AS li, any_value(m) AS m, any_value(d) AS d, (count(*) FILTER (WHERE abs(s-m) >= abs(ob.z*lag/m2-m)) + 1) / 50::DOUBLE AS p FROM ob JOIN mo ON mo.i = ob.id JOIN st ON st.i = ob.id, m2 GROUP BY ob.id)
SELECT id, round(li, 6) + 0.0 AS local_i, round((li-m)/d, 4) + 0.0 AS z_score, round(p, 6) AS p_value, CASE WHEN p > 0.05 THEN 'Not Significant' WHEN z > 0 AND lag > 0 THEN 'High-High' WHEN z < 0 AND lag < 0 THEN 'Low-Low' WHEN z > 0 AND lag < 0 THEN 'High-Low' WHEN z < 0 AND lag > 0 THEN 'Low-High' ELSE 'Not Significant' END AS cluster FROM pv""")
def moran_permutations(spark, sf_dir):
    found = statistics.permutation_moran(*_moran_input(spark, sf_dir), permutations=49)[1]
    return found.select(F.col("location").alias("id"), r6("local_I").alias("local_i"), (F.round("z_score", 4) + F.lit(0.0)).alias("z_score"), r6("p_value").alias("p_value"), "cluster")


@query(f"WITH {PTS}, a AS (SELECT id, cx-0.5 AS z, cy-0.5 AS lag, x2/5 AS p FROM pts) SELECT id, CASE WHEN p > 0.05 THEN 'Not Significant' WHEN z > 0 AND lag > 0 THEN 'High-High' WHEN z < 0 AND lag < 0 THEN 'Low-Low' WHEN z > 0 AND lag < 0 THEN 'High-Low' WHEN z < 0 AND lag > 0 THEN 'Low-High' ELSE 'Not Significant' END AS cluster FROM a")
def cluster_labels(spark, sf_dir):
    return points(spark, sf_dir).select("id", statistics.cluster_label(F.col("cx") - 0.5, F.col("cy") - 0.5, F.col("x2") / 5).alias("cluster"))


@query(f"WITH {PTS}, a AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1,y) AS s1, covar_pop(x2,y) AS s2, var_pop(x1) AS g11, covar_pop(x1,x2) AS g12, var_pop(x2) AS g22, var_pop(y) AS v FROM pts), b AS (SELECT *, (g22*s1-g12*s2)/(g11*g22-g12*g12) AS b1, (g11*s2-g12*s1)/(g11*g22-g12*g12) AS b2 FROM a) SELECT round(my-b1*m1-b2*m2, 4) AS beta0, round(b1, 4) AS beta1, round(b2, 4) AS beta2, round((b1*s1+b2*s2)/v, 4) AS r_squared FROM b")
def global_least_squares(spark, sf_dir):
    o = workflow.ols(points(spark, sf_dir), "y", ["x1", "x2"])
    c = o["coefficients"]
    return spark.range(1).select(*[F.round(F.lit(float(v)), 4).alias(n) for n, v in zip(("beta0", "beta1", "beta2", "r_squared"), [*c.values(), o["r_squared"]])])


@query(f"""{base_sql()}, {linear_sql()}, n AS (SELECT count(*)::DOUBLE AS n, corr(z1, z2) AS r, avg(y) AS my, avg(z1*y) AS q1, avg(z2*y) AS q2 FROM zp),
sm AS (SELECT e.target_id AS i, e.source_id AS j, wn*((g22*(z1-f.m1)-g12*(z2-f.m2))/det) AS c1, wn*((g11*(z2-f.m2)-g12*(z1-f.m1))/det) AS c2, wn, f.m1, f.m2, o1, o2 FROM ez e JOIN ff f USING (target_id)),
st AS (SELECT i, j, wn + (o1-m1)*c1 + (o2-m2)*c2 AS s, c1/d1 AS b1, c2/d2 AS b2, wn - (m1+c1_/d1)*c1 - (m2+c2_/d2)*c2 AS b0 FROM sm, (SELECT c1 AS c1_, d1, c2 AS c2_, d2 FROM sd)),
ls AS (SELECT i, j, (CASE WHEN i = j THEN 1 ELSE 0 END) - s AS s FROM st),
en AS (SELECT 'F' AS v, i, j, s AS x FROM ls UNION ALL SELECT '(Intercept)', i, j, b0 FROM st UNION ALL SELECT 'x1', i, j, b1 FROM st UNION ALL SELECT 'x2', i, j, b2 FROM st),
pr AS (SELECT a.v, a.j, b.j AS k, sum(a.x*b.x) AS q FROM en a JOIN en b ON a.v = b.v AND a.i = b.i GROUP BY a.v, a.j, b.j),
sq AS (SELECT v, sum(q*q) AS sq FROM pr GROUP BY v), one AS (SELECT v, sum(x*x) AS one FROM en GROUP BY v),
cs AS (SELECT v, j, sum(x) AS a FROM en GROUP BY v, j), aa AS (SELECT v, sum(a*a) AS aa FROM cs GROUP BY v),
ca AS (SELECT v, sum(x*x) AS ca FROM (SELECT en.v, i, sum(x*a) AS x FROM en JOIN cs ON cs.v = en.v AND cs.j = en.j GROUP BY en.v, i) GROUP BY v),
du AS (SELECT i, sum(s) AS u0, sum(s*z1) AS u1, sum(s*z2) AS u2 FROM ls JOIN zp ON zp.id = j GROUP BY i),
qh AS (SELECT sum(u0*u0/n + (u1*u1 - 2*r*u1*u2 + u2*u2)/(n*(1-r*r))) AS qh FROM du, n),
r1 AS (SELECT sum(pow(y-fitted, 2)) AS rss1, var_pop(beta0) AS v0, var_pop(beta1) AS v1, var_pop(beta2) AS v2 FROM ff),
r0 AS (SELECT sum(pow(y - my - (q1-r*q2)/(1-r*r)*z1 - (q2-r*q1)/(1-r*r)*z2, 2)) AS rss0 FROM zp, n),
g AS (SELECT one AS delta1, sq AS delta2, qh, rss0, rss1, n-3 AS df0, v0, v1, v2, n FROM one JOIN sq USING (v), qh, r0, r1, n WHERE v = 'F'),
f3 AS (SELECT one.v, (one - aa/n)/n AS g1, (sq - 2*ca/n + aa*aa/(n*n))/(n*n) AS g2, CASE one.v WHEN '(Intercept)' THEN v0 WHEN 'x1' THEN v1 ELSE v2 END AS spread, rss1/delta1 AS sigma2, delta1*delta1/delta2 AS d1 FROM one JOIN sq USING (v) JOIN aa USING (v) JOIN ca USING (v), g WHERE one.v <> 'F'),
al AS (SELECT 'F1' AS test, (rss1/delta1)/(rss0/df0) AS statistic, delta1*delta1/delta2 AS df1, df0 AS df2 FROM g UNION ALL SELECT 'F2', ((rss0-rss1)/(df0-delta1))/(rss0/df0), pow(df0-delta1, 2)/(df0-2*(delta1-qh)+delta2), df0 FROM g UNION ALL SELECT 'F3 ' || v, spread/g1/sigma2, g1*g1/g2, d1 FROM f3)
SELECT test, round(statistic, 5) AS statistic, round(df1, 4) AS df1, round(df2, 4) AS df2 FROM al""")
def f_statistics(spark, sf_dir):
    return f_tests(spark, sf_dir).select("test", F.round("statistic", 5).alias("statistic"), F.round("df1", 4).alias("df1"), F.round("df2", 4).alias("df2"))


@query()
def f_tests(spark, sf_dir):
    a, b = advanced.f_tests(_fit(spark, sf_dir))
    rows = [(t["test"], *[float(t[k]) for k in ("statistic", "df1", "df2", "p_value")]) for t in a] + [(f"F3 {t['coefficient']}", *[float(t[k]) for k in ("statistic", "df1", "df2", "p_value")]) for t in b]
    return spark.createDataFrame(rows, "test string, statistic double, df1 double, df2 double, p_value double")


@query(f"""{base_sql()}, {linear_sql()}, {HAT}, vr AS (SELECT sum(pow(y-fitted, 2))/(count(*) - 2*sum(h) + sum(s2)) AS sigma2 FROM ff JOIN sm USING (target_id)),
mp AS (SELECT e.target_id, wn*(g22*(z1-f.m1)-g12*(z2-f.m2))/det AS a1, wn*(g11*(z2-f.m2)-g12*(z1-f.m1))/det AS a2, wn, f.m1, f.m2, beta0, beta1, beta2 FROM ez e JOIN ff f USING (target_id)),
va AS (SELECT target_id, any_value(beta0) AS beta0, any_value(beta1) AS beta1, any_value(beta2) AS beta2, sum(pow(wn - (m1+c1/d1)*a1 - (m2+c2/d2)*a2, 2)) AS v0, sum(a1*a1)/any_value(d1*d1) AS v1, sum(a2*a2)/any_value(d2*d2) AS v2 FROM mp, sd GROUP BY target_id),
al AS (SELECT target_id, '(Intercept)' AS coefficient, beta0 AS b, v0 AS v FROM va UNION ALL SELECT target_id, 'x1', beta1, v1 FROM va UNION ALL SELECT target_id, 'x2', beta2, v2 FROM va)
SELECT target_id AS location, coefficient, round(b, 6) + 0.0 AS estimate, round(sqrt(v*sigma2), 6) AS standard_error, round(b/sqrt(v*sigma2), 4) + 0.0 AS statistic FROM al, vr""")
def local_t_statistics(spark, sf_dir):
    i = _fit(spark, sf_dir, diagnostics="full").inference()
    return i.select("location", "coefficient", r6("estimate").alias("estimate"), r6("standard_error").alias("standard_error"), (F.round("statistic", 4) + F.lit(0.0)).alias("statistic"))


@query()
def local_inference(spark, sf_dir):
    return _fit(spark, sf_dir, diagnostics="full").inference()


@query()
def inference_summary(spark, sf_dir):
    return _fit(spark, sf_dir, penalty="lasso", lam=0.05, diagnostics="full").inference_summary()


# --- paths, tuning, selection ---------------------------------------------

LAMBDAS = [0.6, 0.3, 0.1]


@query(f"{base_sql()} SELECT round(max(abs(s1)), 6) AS lambda_max FROM gg")
def lasso_lambda_max(spark, sf_dir):
    p = points(spark, sf_dir)
    c, s = local.standardisation(p, ["x1"])
    hoods = local.neighbourhoods(neighbors.knn(p, K, XY), local.standardised(p, ["x1"], c, s), "y", ["x1"])
    return spark.range(1).select(r6(F.lit(local.lambda_max(hoods, workflow.spec_of("lasso", 1.0), 1))).alias("lambda_max"))


@query(f"{base_sql()}, la AS (SELECT * FROM (VALUES (0, 0.6::DOUBLE), (1, 0.3::DOUBLE), (2, 0.1::DOUBLE)) v(lambda_idx, lam)), cc AS (SELECT *, sign(s1)*greatest(abs(s1)-lam, 0)/g11 AS b FROM gg, la) SELECT target_id AS id, lambda_idx, round(b/d1, 6) + 0.0 AS beta1, round(my+b*(z1-m1), 6) + 0.0 AS fitted FROM cc JOIN zp ON zp.id = cc.target_id")
def lasso_path(spark, sf_dir):
    got = workflow.path(points(spark, sf_dir), "y", ["x1"], XY, K, "lasso", LAMBDAS, tolerance=1e-12)
    return got.select(F.col("target_id").alias("id"), "lambda_idx", r6(F.element_at("coef", 2)).alias("beta1"), r6("fitted").alias("fitted"))


@query(f"""{base_sql()}, la AS (SELECT * FROM (VALUES (0, 0.6::DOUBLE), (1, 0.4::DOUBLE), (2, 0.2::DOUBLE)) v(lambda_idx, lam)),
cc AS (SELECT *, sign(s1)*CASE WHEN abs(s1) <= lam THEN 0 WHEN abs(s1) <= lam*(1+g11) THEN (abs(s1)-lam)/g11 WHEN abs(s1) <= g11*20*lam THEN (abs(s1)-20*lam/19)/(g11-1/19.0) ELSE abs(s1)/g11 END AS beta FROM gg, la),
hh AS (SELECT cc.*, o.z1 AS o1, o.y AS oy, my+beta*(o.z1-m1) AS f, g11 - CASE WHEN abs(beta) > lam AND abs(beta) < 20*lam THEN 1/19.0 ELSE 0 END AS h FROM cc JOIN zp o ON o.id = cc.target_id),
ro AS (SELECT e.target_id, e.source_id, lambda_idx, beta, oy, f, wn * (1 + CASE WHEN abs(beta) > 1e-10 THEN (o1-m1)*(z1-m1)/h ELSE 0 END) AS s FROM ez e JOIN hh USING (target_id)),
tg AS (SELECT lambda_idx, target_id, any_value(beta) AS beta, any_value(oy) AS y, any_value(f) AS f, sum(CASE WHEN source_id = target_id THEN s ELSE 0 END) AS hat, sum(s*s) AS s2 FROM ro GROUP BY lambda_idx, target_id),
ag AS (SELECT lambda_idx, count(*)::DOUBLE AS n, avg((abs(beta) > 1e-10)::INTEGER) AS mean_nonzero, max((abs(beta) > 1e-10)::INTEGER)::BIGINT AS surface_size, sum(pow(y-f, 2)) AS rss, sum(hat) AS trS, sum(s2) AS trStS FROM tg GROUP BY lambda_idx)
SELECT lambda_idx, surface_size, round(mean_nonzero, 6) AS mean_nonzero, round(rss, 4) AS rss, round(trS, 4) AS trS, round(trStS, 4) AS trStS, round(n*(ln(rss/n)+ln(2*pi())+1) + ln(n)*(trS+1), 4) AS ebic FROM ag""")
def scad_path_criteria(spark, sf_dir):
    got = statistics.path_criteria(workflow.path(points(spark, sf_dir), "y", ["x1"], XY, K, "scad", [0.6, 0.4, 0.2], gamma=20.0, tolerance=1e-12), 1)
    return got.select("lambda_idx", "surface_size", r6("mean_nonzero").alias("mean_nonzero"), *[F.round(c, 4).alias(c) for c in ("rss", "trS", "trStS", "ebic")])


@query()
def path_criteria(spark, sf_dir):
    return statistics.path_criteria(workflow.path(points(spark, sf_dir), "y", ["x1", "x2"], XY, K, "scad", count=8, ratio=0.01), 2)


CV = f"""WITH {PTS}, la AS (SELECT * FROM (VALUES (0, 0.6::DOUBLE), (1, 0.3::DOUBLE), (2, 0.1::DOUBLE)) v(lambda_idx, lam)),
fo AS (SELECT DISTINCT id % 3 AS f FROM pts), sd AS (SELECT f, avg(x1) AS c1, stddev_pop(x1) AS d1 FROM fo JOIN pts ON pts.id % 3 <> f GROUP BY f),
knn AS (SELECT * FROM (SELECT t.id AS target_id, s.id AS source_id, t.id % 3 AS f, {DIST} AS dist, row_number() OVER (PARTITION BY t.id ORDER BY {DIST}, s.id) - 1 AS rank FROM pts t, pts s WHERE s.id % 3 <> t.id % 3) WHERE rank < {K}), {weight_sql()},
ez AS (SELECT we.*, (x1-c1)/d1 AS z1, y FROM we JOIN pts ON pts.id = we.source_id JOIN sd USING (f)),
mm AS (SELECT target_id, f, sum(wn*z1) AS m1, sum(wn*y) AS my FROM ez GROUP BY target_id, f),
gg AS (SELECT target_id, mm.f, any_value(m1) AS m1, any_value(my) AS my, sum(wn*(z1-m1)*(z1-m1)) AS g11, sum(wn*(z1-m1)*(y-my)) AS s1 FROM ez JOIN mm USING (target_id) GROUP BY target_id, mm.f),
er AS (SELECT gg.f, lambda_idx, lam, my + sign(s1)*greatest(abs(s1)-lam, 0)/g11*((x1-c1)/d1-m1) - y AS e FROM gg JOIN pts ON pts.id = target_id JOIN sd ON sd.f = gg.f, la)"""


@query(f"{CV} SELECT lambda_idx, count(*) AS n, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM er GROUP BY lambda_idx")
def cross_validation(spark, sf_dir):
    s, _ = workflow.cross_validate(points(spark, sf_dir).withColumn("fold", F.col("id") % 3), "y", ["x1"], XY, K, "fold", LAMBDAS, "lasso", tolerance=1e-12)
    return s.select("lambda_idx", "n", r6("rmse").alias("rmse"), r6("mae").alias("mae"))


@query(f"{CV}, sc AS (SELECT lambda_idx, any_value(lam) AS lam, sqrt(avg(e*e)) AS rmse FROM er GROUP BY lambda_idx) SELECT lambda_idx, lam AS lambda FROM sc ORDER BY rmse, lambda_idx LIMIT 1")
def best_lambda(spark, sf_dir):
    s, _ = workflow.cross_validate(points(spark, sf_dir).withColumn("fold", F.col("id") % 3), "y", ["x1"], XY, K, "fold", LAMBDAS, "lasso", tolerance=1e-12)
    return ranking.argmin(s, "rmse", "lambda_idx").select("lambda_idx", "lambda")


@query(f"{CV} SELECT f AS fold, lambda_idx, round(sqrt(avg(e*e)), 6) AS rmse FROM er GROUP BY f, lambda_idx")
def fold_results(spark, sf_dir):
    _, s = workflow.cross_validate(points(spark, sf_dir).withColumn("fold", F.col("id") % 3), "y", ["x1"], XY, K, "fold", LAMBDAS, "lasso", tolerance=1e-12)
    return s.select("fold", "lambda_idx", r6("rmse").alias("rmse"))


@query(f"""WITH {PTS}, nn AS (SELECT * FROM (SELECT t.id AS target_id, s.id AS source_id, {DIST} AS dist, row_number() OVER (PARTITION BY t.id ORDER BY {DIST}, s.id) AS r FROM pts t JOIN pts s ON t.id % 3 <> s.id % 3) WHERE r <= 40),
ks AS (SELECT unnest([15, 25, 40])::INTEGER AS k), e AS (SELECT k, target_id, source_id, dist / (max(dist) OVER (PARTITION BY k, target_id) * (1 + 1e-10)) AS u FROM nn JOIN ks ON r <= k),
w AS (SELECT k, target_id, x1, x2, y, CASE WHEN u < 1 THEN pow(1-u*u, 2) ELSE 0 END AS w FROM e JOIN pts ON id = source_id),
m AS (SELECT k, target_id, sum(w) AS tw, sum(w*x1)/sum(w) AS m1, sum(w*x2)/sum(w) AS m2, sum(w*y)/sum(w) AS my FROM w GROUP BY k, target_id),
g AS (SELECT k, target_id, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, sum(w/tw*(x1-m1)*(x1-m1)) AS g11, sum(w/tw*(x1-m1)*(x2-m2)) AS g12, sum(w/tw*(x2-m2)*(x2-m2)) AS g22, sum(w/tw*(x1-m1)*(y-my)) AS s1, sum(w/tw*(x2-m2)*(y-my)) AS s2 FROM w JOIN m USING (k, target_id) GROUP BY k, target_id),
er AS (SELECT k, my + (g22*s1-g12*s2)/(g11*g22-g12*g12)*(x1-m1) + (g11*s2-g12*s1)/(g11*g22-g12*g12)*(x2-m2) - y AS e FROM g JOIN pts ON id = target_id)
SELECT k, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM er GROUP BY k""")
def bandwidth_search(spark, sf_dir):
    found = workflow.bandwidth_search(points(spark, sf_dir).withColumn("fold", F.col("id") % 3), "y", ["x1", "x2"], XY, "fold", [15, 25, 40])
    return found.select("k", r6("rmse").alias("rmse"), r6("mae").alias("mae"))


CANDIDATES = f"""WITH {PTS}, {STD}, {knn_sql(30)}, ks AS (SELECT unnest([20, 30])::INTEGER AS k), kern AS (SELECT unnest(['bisquare', 'gaussian']) AS kernel),
subs AS (SELECT * FROM (VALUES ('x1', 1, 1, 0), ('x2', 1, 0, 1), ('x1+x2', 2, 1, 1)) v(terms, n_terms, u1, u2)),
ed AS (SELECT k, target_id, source_id, dist / (max(dist) OVER (PARTITION BY k, target_id) * (1 + 1e-10)) AS u FROM knn JOIN ks ON rank < k),
wa AS (SELECT k, kernel, target_id, source_id, z1, z2, y, CASE WHEN kernel = 'gaussian' THEN exp(-0.5*u*u) WHEN u < 1 THEN pow(1-u*u, 2) ELSE 0 END AS w FROM ed JOIN zp ON zp.id = source_id, kern),
wn AS (SELECT *, w / sum(w) OVER (PARTITION BY k, kernel, target_id) AS wn FROM wa),
ma AS (SELECT k, kernel, target_id, sum(wn*z1) AS m1, sum(wn*z2) AS m2, sum(wn*y) AS my FROM wn GROUP BY k, kernel, target_id),
ga AS (SELECT k, kernel, target_id, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, sum(wn*(z1-m1)*(z1-m1)) AS g11, sum(wn*(z1-m1)*(z2-m2)) AS g12, sum(wn*(z2-m2)*(z2-m2)) AS g22, sum(wn*(z1-m1)*(y-my)) AS s1, sum(wn*(z2-m2)*(y-my)) AS s2 FROM wn JOIN ma USING (k, kernel, target_id) GROUP BY k, kernel, target_id),
ia AS (SELECT *, CASE WHEN u1+u2 = 2 THEN g22/(g11*g22-g12*g12) WHEN u1 = 1 THEN 1/g11 ELSE 0 END AS i11, CASE WHEN u1+u2 = 2 THEN -g12/(g11*g22-g12*g12) ELSE 0 END AS i12, CASE WHEN u1+u2 = 2 THEN g11/(g11*g22-g12*g12) WHEN u2 = 1 THEN 1/g22 ELSE 0 END AS i22 FROM ga, subs),
ta AS (SELECT k, kernel, terms, n_terms, target_id, m1, m2, my, s1, s2, o.y AS oy, i11*(o.z1-m1)+i12*(o.z2-m2) AS a1, i12*(o.z1-m1)+i22*(o.z2-m2) AS a2 FROM ia JOIN zp o ON o.id = target_id),
ra AS (SELECT ta.k, ta.kernel, terms, n_terms, target_id, any_value(oy) AS y, any_value(my+a1*s1+a2*s2) AS f, sum(pow(wn*(1+a1*(z1-m1)+a2*(z2-m2)), 2)) AS s2, sum(CASE WHEN source_id = target_id THEN wn*(1+a1*(z1-m1)+a2*(z2-m2)) ELSE 0 END) AS h FROM ta JOIN wn USING (k, kernel, target_id) GROUP BY ta.k, ta.kernel, terms, n_terms, target_id),
og AS (SELECT count(*) AS n, avg(z1*z2) AS r, avg(z1*y) AS s1, avg(z2*y) AS s2, avg(y) AS my FROM zp),
ot AS (SELECT * FROM subs UNION ALL SELECT '1', 0, 0, 0),
ob AS (SELECT NULL::INTEGER AS k, NULL::VARCHAR AS kernel, terms, n_terms, id AS target_id, y, my, s1, s2, n, z1, z2, CASE WHEN u1+u2 = 2 THEN (z1-r*z2)/(1-r*r) WHEN u1 = 1 THEN z1 ELSE 0 END AS a1, CASE WHEN u1+u2 = 2 THEN (z2-r*z1)/(1-r*r) WHEN u2 = 1 THEN z2 ELSE 0 END AS a2 FROM zp, og, ot),
al AS (SELECT k, kernel, terms, n_terms, 'gwr' AS family, y, f, s2, h FROM ra UNION ALL SELECT k, kernel, terms, n_terms, 'ols', y, my+a1*s1+a2*s2, (1+a1*z1+a2*z2)/n, (1+a1*z1+a2*z2)/n FROM ob),
cr AS (SELECT k, kernel, terms, n_terms, family, count(*)::DOUBLE AS n, sum(pow(y-f, 2)) AS rss, sum(h) AS trS, sum(s2) AS trStS, sum(pow((y-f)/(1-h), 2)) AS loo_cv, max(h) AS max_leverage FROM al GROUP BY k, kernel, terms, n_terms, family),
ca AS (SELECT *, n*(ln(rss/n)+ln(2*pi())+1) + 2*n*(trS+1)/(n-trS-2) AS aicc FROM cr)"""


@query(f"{CANDIDATES} SELECT terms, family, kernel, k, round(aicc, 4) AS aicc, round(loo_cv, 4) AS loo_cv, round(trS, 4) AS trS, round(trStS, 4) AS trStS, round(max_leverage, 6) AS max_leverage, row_number() OVER (ORDER BY aicc)::INTEGER AS rank, round(aicc - min(aicc) OVER (), 4) + 0.0 AS delta FROM ca")
def model_selection(spark, sf_dir):
    found = workflow.select(points(spark, sf_dir), "y", ["x1", "x2"], XY, ["bisquare", "gaussian"], [20, 30])
    r4 = [(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("aicc", "loo_cv", "trS", "trStS", "delta")]
    return found.select("terms", "family", "kernel", "k", *r4, r6("max_leverage").alias("max_leverage"), "rank")


@query("""SELECT id AS candidate_id, row_number() OVER (ORDER BY crit, n_terms, CASE WHEN family = 'ols' THEN 0 ELSE 1 END, k DESC, kernel, terms, id)::INTEGER AS rank, round(crit - min(crit) OVER (), 6) AS delta FROM
 (SELECT p_partkey AS id, p_size::DOUBLE AS crit, (p_partkey % 3)::INTEGER AS n_terms, CASE WHEN p_partkey % 5 = 0 THEN 'ols' ELSE 'gwr' END AS family, (p_partkey % 11)::INTEGER AS k, p_brand AS kernel, p_type AS terms FROM part)""")
def candidate_ranking(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("candidate_id"), F.col("p_size").cast("double").alias("aicc"), (k % 3).cast("int").alias("n_terms"), F.when(k % 5 == 0, "ols").otherwise("gwr").alias("family"), (k % 11).cast("int").alias("k"), F.col("p_brand").alias("kernel"), F.col("p_type").alias("terms"), F.lit(True).alias("eligible"))
    return workflow.rank_candidates(rows).select("candidate_id", "rank", r6("delta").alias("delta"))


PV = "SELECT p_partkey AS id, p_brand AS g, ((p_partkey*7919) % 1009)/1009::DOUBLE AS p FROM part"


def _adjust(method: str, sql: str) -> None:
    def run(spark, sf_dir):
        k = F.col("p_partkey")
        df = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_brand").alias("g"), (((k * 7919) % 1009) / F.lit(1009.0)).alias("p"))
        return ranking.p_adjust(df, "p", ["g"], method).select("id", r6("p_adjusted").alias("p_adjusted"))

    run.__name__ = f"p_adjust_{method.lower()}"
    query(f"WITH a AS ({PV}), b AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY p) AS i FROM a) SELECT id, round({sql}, 6) AS p_adjusted FROM b")(run)


_adjust("BH", "least(1, min(p*n/i) OVER (PARTITION BY g ORDER BY i DESC))")
_adjust("BY", "least(1, min(p*n/i*list_sum(list_transform(range(1, n+1), lambda v: 1.0/v))) OVER (PARTITION BY g ORDER BY i DESC))")
_adjust("holm", "least(1, max(p*(n-i+1)) OVER (PARTITION BY g ORDER BY i))")
_adjust("bonferroni", "least(1, p*n)")


@query("WITH a AS (SELECT p_partkey AS id, p_brand AS g, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1)/2.0 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT id, least(greatest(ceil(r/n*4), 1), 4)::INTEGER AS bin FROM a")
def rank_bins(spark, sf_dir):
    return ranking.rank_bin(table(spark, sf_dir, "part"), "p_size", 4, ["p_brand"]).select(F.col("p_partkey").alias("id"), "bin")


# --- surfaces and summaries -----------------------------------------------

@query(f"WITH {PTS}, {CROSS}, a AS (SELECT target_id, y, dist, CASE WHEN dist <= 1e-10 THEN 0 ELSE 1/pow(greatest(dist, 2.220446049250313e-16), 2) END AS w, CASE WHEN dist <= 1e-10 THEN 1.0 ELSE 0.0 END AS h FROM cross_ JOIN pts ON pts.id = source_id) SELECT target_id AS id, round(CASE WHEN sum(h) > 0 THEN sum(h*y)/sum(h) ELSE sum(w*y)/sum(w) END, 6) AS y, round(min(dist), 6) AS nearest_observation_distance FROM a GROUP BY target_id")
def inverse_distance_surface(spark, sf_dir):
    p = points(spark, sf_dir)
    s = statistics.interpolate(neighbors.knn(p, 12, XY, targets=grid_points(spark)), p, ["y"], "idw")
    return s.select(F.col("target_id").alias("id"), r6("y").alias("y"), r6("nearest_observation_distance").alias("nearest_observation_distance"))


@query(f"WITH {PTS}, {CROSS}, a AS (SELECT target_id, y, CASE WHEN dist <= 1e-10 THEN 0 ELSE exp(-0.5*pow(dist/0.05, 2)) END AS w, CASE WHEN dist <= 1e-10 THEN 1.0 ELSE 0.0 END AS h FROM cross_ JOIN pts ON pts.id = source_id) SELECT target_id AS id, round(CASE WHEN sum(h) > 0 THEN sum(h*y)/sum(h) WHEN sum(w) > 2.220446049250313e-16 THEN sum(w*y)/sum(w) END, 6) AS y FROM a GROUP BY target_id")
def kernel_surface(spark, sf_dir):
    p = points(spark, sf_dir)
    s = statistics.interpolate(neighbors.knn(p, 12, XY, targets=grid_points(spark)), p, ["y"], "gaussian", 0.05)
    return s.select(F.col("target_id").alias("id"), r6("y").alias("y"))


@query(f"WITH {GRID} SELECT id, cy > 0.1 AND cx > cy/2 AND cx < 1 - cy/2 AS inside FROM g")
def boundary_mask(spark, sf_dir):
    inside = statistics.inside_ring(F.col("cx"), F.col("cy"), [(0.05, 0.1), (0.95, 0.1), (0.5, 1.0)])
    return grid_points(spark).select("id", inside.alias("inside"))


@query("SELECT round(c_acctbal/1000)::INTEGER AS a, c_nationkey AS b, round(avg(c_acctbal), 4) + 0.0 AS c_acctbal, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS ids, count(*) AS n_merged FROM customer GROUP BY 1, 2")
def merged_locations(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.round(F.col("c_acctbal") / 1000).cast("int").alias("a"), F.col("c_nationkey").alias("b"), "c_acctbal", "c_custkey")
    m = statistics.merge_duplicates(df, ["a", "b"], ["c_acctbal"], "c_custkey")
    return m.withColumn("c_acctbal", F.round("c_acctbal", 4) + F.lit(0.0))


PRED = "SELECT o_orderkey AS id, o_orderpriority AS m, o_totalprice/1000 AS observed, o_totalprice/1000 + (o_orderkey % 7) - 3 AS prediction, 100::DOUBLE AS baseline, (o_orderkey % 500)::DOUBLE AS d FROM orders"


def _predictions(spark, sf_dir):
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("m"), (F.col("o_totalprice") / 1000).alias("observed"), (F.col("o_totalprice") / 1000 + (o % 7) - 3).alias("prediction"), F.lit(100.0).alias("baseline"), (o % 500).cast("double").alias("d"))


METRICS = "count(*) AS n, round(sqrt(avg(pow(prediction-observed, 2))), 6) AS rmse, round(avg(abs(prediction-observed)), 6) AS mae, round(avg(prediction-observed), 6) + 0.0 AS bias, round(1-sum(pow(prediction-observed, 2))/sum(pow(observed-baseline, 2)), 6) AS predictive_r_squared"


@query(f"SELECT m, {METRICS} FROM ({PRED}) GROUP BY m")
def prediction_metrics(spark, sf_dir):
    return out(statistics.prediction_metrics(_predictions(spark, sf_dir), ["m"]), "rmse", "mae", "bias", "predictive_r_squared", keys=("m", "n"))


@query(f"SELECT CASE WHEN d < 50 THEN '[0,50)' WHEN d < 100 THEN '[50,100)' WHEN d < 200 THEN '[100,200)' WHEN d < 400 THEN '[200,400)' ELSE '[400,Inf)' END AS band, {METRICS} FROM ({PRED}) GROUP BY 1")
def metrics_by_distance(spark, sf_dir):
    rows = _predictions(spark, sf_dir).withColumn("band", statistics.distance_band(F.col("d")))
    return out(statistics.prediction_metrics(rows, ["band"]), "rmse", "mae", "bias", "predictive_r_squared", keys=("band", "n"))


@query("""WITH a AS (SELECT p_brand AS m, (p_partkey % 3 > 0) AS t, (p_partkey % 4 > 0) AS s FROM part), b AS (SELECT m, count(*) FILTER (WHERE t AND s)::DOUBLE AS tp, count(*) FILTER (WHERE NOT t AND s)::DOUBLE AS fp, count(*) FILTER (WHERE t AND NOT s)::DOUBLE AS fn, count(*) FILTER (WHERE NOT t AND NOT s)::DOUBLE AS tn FROM a GROUP BY m)
SELECT m, tp, fp, fn, tn, round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) END,6) AS tpr, round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) END,6) AS precision, round(CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) END,6) AS f1, round(CASE WHEN tp+fn=0 OR tn+fp=0 THEN NULL WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)=0 THEN 0 ELSE (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) END,6)+0.0 AS mcc, round((tp+tn)/(tp+fp+fn+tn),6) AS accuracy FROM b""")
def support_metrics(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("m"), (k % 3 > 0).cast("double").alias("truth"), (k % 4 > 0).cast("double").alias("estimate"))
    return out(statistics.support_metrics(rows, ["m"]), "tpr", "precision", "f1", "mcc", "accuracy", keys=("m", "tp", "fp", "fn", "tn"))


@query("SELECT l_returnflag AS cell, l_linestatus AS method, count(*) AS n, count(*) AS n_finite, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_samp(l_quantity)/sqrt(count(*)), 6) AS mcse, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.25), 6) AS q25, round(quantile_cont(l_quantity, 0.75), 6) AS q75 FROM lineitem GROUP BY 1, 2")
def monte_carlo_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cell"), F.col("l_linestatus").alias("method"), "l_quantity")
    return out(statistics.monte_carlo(rows, ["cell", "method"], "l_quantity"), "mean", "sd", "mcse", "median", "q25", "q75", keys=("cell", "method", "n", "n_finite"))


# --- graphs, tasks, streams -----------------------------------------------

@query(f"""WITH {PTS}, {knn_sql(9)}, {weight_sql('gaussian')}, a0 AS (SELECT target_id AS i, source_id AS j, w FROM we WHERE target_id <> source_id), a1 AS (SELECT i, j, w FROM a0 UNION ALL SELECT j, i, w FROM a0), a AS (SELECT i, j, sum(w)/2 AS v FROM a1 GROUP BY i, j)
SELECT i, j, round(-v, 6) AS v FROM a UNION ALL SELECT i, i AS j, round(sum(v), 6) AS v FROM a GROUP BY i""")
def graph_laplacian(spark, sf_dir):
    return out(advanced.graph_laplacian(neighbors.knn(points(spark, sf_dir), 9, XY)), "v", keys=("i", "j"))


@query(f"{MORAN} SELECT i, round(sum(v*y), 6) AS v FROM wt JOIN z ON z.id = j GROUP BY i")
def sparse_product(spark, sf_dir):
    w, v = _moran_input(spark, sf_dir)
    return out(neighbors.sparse_product(w, v.select(F.col("id").alias("i"), F.col("residual").alias("v"))), "v", keys=("i",))


@query()
def process_model(spark, sf_dir):
    p = points(spark, sf_dir)
    e = neighbors.knn(p, 15, XY).persist()
    lap = advanced.graph_laplacian(e).persist()
    source = p.select(F.col("id").alias("i"), F.sin(F.col("id") / 4.0).alias("v"))
    m = advanced.process_model(p, "y", ["x1", "x2"], e, lap, source, lap, max_iterations=100_000)
    if not m["converged"]:
        raise ValueError(f"not converged in {m['iterations']} steps")
    return m["local"]


@query("SELECT d.task_id::BIGINT AS task_id, a, b, replicate, (20240101 + d.task_id::BIGINT*104729) % 2147483646 + 1 AS seed FROM (SELECT (ia*2+ib)*3 + replicate AS task_id, a, b, replicate FROM (VALUES (0,'u'),(1,'v')) x(ia,a), (VALUES (0,1.0::DOUBLE),(1,2.0::DOUBLE)) y(ib,b), (SELECT (i+1)::INTEGER AS replicate FROM range(3) r(i))) d")
def task_plan(spark, sf_dir):
    return tables.task_plan(spark, {"a": ["u", "v"], "b": [1.0, 2.0]}, 3, 20240101).select("task_id", "a", "b", "replicate", "seed")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return scoring.windowed(table(spark, sf_dir, "events")).withColumn("mean_value", r6("mean_value"))


@query("SELECT c_custkey AS id, c_acctbal, o.n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def aligned_observations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    nation = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return tables.align([c.join(F.broadcast(nation), "c_nationkey"), n], "c_custkey", ["c_nationkey"]).select(F.col("c_custkey").alias("id"), "c_acctbal", "n")


# --- formulas, graphs, maps, audits ---------------------------------------

@query("WITH a AS (SELECT p_partkey AS id, p_size::DOUBLE AS s, p_retailprice AS r, p_partkey % 3 AS k FROM part) SELECT id, s, (k = 1)::INTEGER::DOUBLE AS k1, (k = 2)::INTEGER::DOUBLE AS k2, (k = 1)::INTEGER * s AS sk1, (k = 2)::INTEGER * s AS sk2 FROM a")
def formula_design(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"), (F.col("p_partkey") % 3).cast("string").alias("k"))
    got, _ = formula.build(df, "r ~ s*k")
    return got.select("id", "s", "k1", "k2", F.col("`s:k1`").alias("sk1"), F.col("`s:k2`").alias("sk2"))


SQUARES = "sq AS (SELECT i AS id, i % 20 AS a, i // 20 AS b FROM range(400) r(i) WHERE i % 7 <> 3 OR i % 20 > 15)"


def _squares(spark) -> DataFrame:
    i = F.col("id")
    s = spark.range(400).filter((i % 7 != 3) | (i % 20 > 15)).select("id", (i % 20).alias("a"), F.floor(i / 20).alias("b"))
    corner = F.explode(F.array(*[F.struct((F.col("a") + x).cast("double").alias("x"), (F.col("b") + y).cast("double").alias("y")) for x in (0, 1) for y in (0, 1)]))
    return s.select("id", corner.alias("c")).select("id", "c.x", "c.y")


@query(f"WITH {SQUARES} SELECT s.id AS i, t.id AS j FROM sq s, sq t WHERE s.id <> t.id AND abs(s.a-t.a) <= 1 AND abs(s.b-t.b) <= 1")
def queen_contiguity(spark, sf_dir):
    return graphs.queen_contiguity(_squares(spark))


@query(f"WITH {SQUARES}, e AS (SELECT s.id AS i, t.id AS j FROM sq s, sq t WHERE s.id <> t.id AND abs(s.a-t.a) <= 1 AND abs(s.b-t.b) <= 1), d AS (SELECT i, count(*) AS d FROM e GROUP BY i) SELECT i, j, round(1/d::DOUBLE, 6) AS v FROM e JOIN d USING (i)")
def contiguity_weights(spark, sf_dir):
    return out(graphs.standardised_weights(graphs.queen_contiguity(_squares(spark))), "v", keys=("i", "j"))


@query("SELECT i AS id, i % 10 AS component FROM range(200) r(i)")
def graph_components(spark, sf_dir):
    pairs = spark.range(190).select(F.col("id").alias("i"), (F.col("id") + 10).alias("j"))
    return graphs.connected(pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))), spark.range(200))


@query("WITH a AS (SELECT p_partkey AS id, p_size AS u, p_retailprice AS v FROM part), b AS (SELECT *, rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1)/2.0 AS ru, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1)/2.0 AS rv, count(*) OVER () AS n FROM a) SELECT id, ((least(greatest(ceil(rv/n*3), 1), 3) - 1)*3 + least(greatest(ceil(ru/n*3), 1), 3))::INTEGER AS class FROM b")
def bivariate_classes(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value_1"), F.col("p_retailprice").alias("value_2"))
    return surfaces.bivariate(df).select("id", F.col("class").cast("int").alias("class"))


@query()
def fitted_surface(spark, sf_dir):
    return surfaces.surface(_fit(spark, sf_dir), ["x1", "beta_2"], 25)


@query(f"{LOCALR}, m AS (SELECT sqrt((1+abs(r))/(1-abs(r))) AS condition_number, abs(r) AS max_abs_correlation FROM rr) SELECT 'condition_number' AS measure, round(quantile_disc(condition_number, 0.5), 6) AS median, round(quantile_disc(condition_number, 0.9), 6) AS q90, round(max(condition_number), 6) AS max FROM m UNION ALL SELECT 'max_abs_correlation' AS measure, round(quantile_disc(max_abs_correlation, 0.5), 6) AS median, round(quantile_disc(max_abs_correlation, 0.9), 6) AS q90, round(max(max_abs_correlation), 6) AS max FROM m")
def collinearity_summary(spark, sf_dir):
    p = points(spark, sf_dir)
    c = statistics.local_collinearity(weights.weighted_edges(neighbors.knn(p, K, XY), "bisquare"), p, ["x1", "x2"])
    return out(statistics.collinearity_summary(c, ["condition_number", "max_abs_correlation"]), "median", "q90", "max", keys=("measure",))


@query("SELECT 'c_acctbal' AS \"column\", round(quantile_cont(c_acctbal, 0), 6) AS q0, round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(quantile_cont(c_acctbal, 0.5), 6) AS q50, round(quantile_cont(c_acctbal, 0.75), 6) AS q75, round(quantile_cont(c_acctbal, 1), 6) AS q100 FROM customer")
def column_quantiles(spark, sf_dir):
    return statistics.column_quantiles(table(spark, sf_dir, "customer"), ["c_acctbal"]).select("column", *[r6(f"q{p}").alias(f"q{p}") for p in (0, 25, 50, 75, 100)])


@query("WITH s AS (SELECT count(*) AS a, count(*) FILTER (WHERE c_acctbal > 0) AS b, count(*) FILTER (WHERE c_acctbal > 0 AND c_nationkey < 12) AS c FROM customer) SELECT 1 AS step, 'positive' AS name, a AS n_before, a-b AS n_removed, b AS n_left FROM s UNION ALL SELECT 2, 'nation', b, b-c, c FROM s")
def sample_flow(spark, sf_dir):
    return statistics.sample_flow(table(spark, sf_dir, "customer"), {"positive": F.col("c_acctbal") > 0, "nation": F.col("c_nationkey") < 12})


@query(f"WITH {PTS} SELECT round(max({DIST}), 6) AS diameter FROM pts t, pts s")
def diameter(spark, sf_dir):
    return spark.range(1).select(r6(F.lit(surfaces.diameter(points(spark, sf_dir), "cx", "cy"))).alias("diameter"))


@query("SELECT 'c_acctbal' AS \"column\", count(*) AS n, 0::BIGINT AS n_null, 0::BIGINT AS n_not_finite, count(*) FILTER (WHERE c_acctbal = 0) AS n_zero, count(*) FILTER (WHERE c_acctbal < 0) AS n_negative FROM customer UNION ALL SELECT 'odd', count(*), count(*) FILTER (WHERE c_custkey % 2 = 0), 0::BIGINT, 0::BIGINT, 0::BIGINT FROM customer")
def missingness(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("odd", F.when(F.col("c_custkey") % 2 > 0, F.col("c_custkey")))
    return statistics.missingness(c, ["c_acctbal", "odd"])


@query(f"WITH {PTS} SELECT id % 5 AS fold, count(*) AS n, count(DISTINCT id % 7) AS n_groups, round(min(cx),6)+0.0 AS min_cx, round(max(cx),6) AS max_cx, round(min(cy),6)+0.0 AS min_cy, round(max(cy),6) AS max_cy FROM pts GROUP BY 1")
def fold_summary(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("fold", F.col("id") % 5).withColumn("g", F.col("id") % 7)
    return out(statistics.fold_summary(p, "fold", XY, "g"), "min_cx", "max_cx", "min_cy", "max_cy", keys=("fold", "n", "n_groups"))


@query(f"""WITH b AS ({PRED}), m AS (SELECT id, 'ols' AS method, observed, baseline AS prediction FROM b UNION ALL SELECT id, 'gwr', observed, prediction FROM b), d AS (SELECT g.method, pow(g.prediction-g.observed, 2) - pow(o.prediction-o.observed, 2) AS d FROM m g JOIN m o ON o.id = g.id AND o.method = 'ols' WHERE g.method <> 'ols')
SELECT method, count(*) AS n, round(avg(d), 4) AS mean_difference, round(stddev_samp(d)/sqrt(count(*)), 4) AS standard_error FROM d GROUP BY method""")
def paired_losses(spark, sf_dir):
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("observed"), (F.col("o_totalprice") / 1000 + (F.col("o_orderkey") % 7) - 3).alias("prediction"))
    both = b.withColumn("method", F.lit("gwr")).unionByName(b.withColumn("prediction", F.lit(100.0)).withColumn("method", F.lit("ols")))
    return statistics.paired_loss(both, [], "method", "id").select("method", "n", F.round("mean_difference", 4).alias("mean_difference"), F.round("standard_error", 4).alias("standard_error"))


@query(f"WITH {PTS}, {STD}, a AS (SELECT var_pop(z1) AS g, covar_pop(z1, y) AS s, any_value(c1) AS c1, any_value(d1) AS d1, avg(y) AS my FROM zp), b AS (SELECT *, sign(s)*greatest(abs(s)-0.2, 0)/g AS b FROM a) SELECT round(my-b/d1*c1, 5) AS beta0, round(b/d1, 5) AS beta1 FROM b")
def global_lasso(spark, sf_dir):
    g = workflow.global_fit(points(spark, sf_dir), "y", ["x1"], "lasso", lam=0.2, tolerance=1e-12)
    return spark.range(1).select(F.round(F.lit(g["(Intercept)"]), 5).alias("beta0"), F.round(F.lit(g["x1"]), 5).alias("beta1"))


@query()
def stepwise_selection(spark, sf_dir):
    return workflow.stepwise(points(spark, sf_dir), "y", ["x1", "x2"], XY, ["bisquare"], [25])


@query()
def nested_cross_validation(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("outer", F.col("id") % 2).withColumn("inner", F.floor(F.col("id") / 2) % 2)
    return workflow.best_lambda_nested(p, "y", ["x1", "x2"], XY, K, "outer", "inner", LAMBDAS)
