"""Ranks over whole tables, p-value adjustment, average-rank bins, first-index argmin.

Nothing here sorts a table, or a group, in one task.  Rows are counted per
distinct value first, so a value that many rows share is one row; distinct
values are then dealt to buckets that follow their order, and running sums
and extremes are taken inside buckets and over the buckets' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets from one power of two to the next, and a number above that of any bucket.
PER_OCTAVE, BEYOND = 256, 300_000


def ordered_bucket(v: Column) -> Column:
    """A number that doesn't fall as ``v`` grows: its power of two and the leading bits behind it."""
    size = F.abs(v)
    octave = F.floor(F.log2(size))
    place = F.lit(BEYOND) + octave * PER_OCTAVE + F.floor((size / F.pow(F.lit(2.0), octave.cast("double")) - 1) * PER_OCTAVE)
    inner = F.when(size == float("inf"), F.lit(4 * BEYOND)).otherwise(place)
    return F.when(v == 0, F.lit(0)).when(v > 0, inner).otherwise(-inner).cast("long")


def _keys(by: list[str]) -> list[Column]:
    return [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]


def distinct_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``_k0 .., _v, _same, _below, _n, _b``: of each distinct value in its group, how many rows have it, how many less, and all.

    Values are compared as doubles; nulls and NaN are left out.
    """
    v = F.col(value).cast("double")
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*_keys(by), v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    each = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_same")).withColumn("_b", ordered_bucket(F.col("_v")))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("_in", F.sum("_same").over(inside) - F.col("_same"))
    # a row per bucket, whose number is bounded whatever the table holds
    total = each.groupBy(*keys, "_b").agg(F.sum("_same").alias("_t"))
    up = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = total.withColumn("_off", F.sum("_t").over(up) - F.col("_t")).withColumn("_n", F.sum("_t").over(Window.partitionBy(*keys))).drop("_t")
    return _met(each, total, [*keys, "_b"]).withColumn("_below", F.col("_off") + F.col("_in")).drop("_off", "_in")


def _met(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name, null meeting null; the right ones are dropped."""
    right = right.withColumnsRenamed({n: f"{n}_r" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}_r"))
    return left.join(right, on, how).drop(*[f"{n}_r" for n in names])


def _running(each: DataFrame, keys: list[str], value: Column, falling: bool) -> DataFrame:
    """``_run``: the least ``value`` from here on (``falling``), or the greatest up to here, over distinct values."""
    pick = F.min if falling else F.max
    turn = (lambda c: F.col(c).desc()) if falling else (lambda c: F.col(c).asc())
    each = each.withColumn("_q", value)
    whole = Window.unboundedPreceding, Window.currentRow
    each = each.withColumn("_run", pick("_q").over(Window.partitionBy(*keys, "_b").orderBy(turn("_v")).rowsBetween(*whole)))
    ends = each.groupBy(*keys, "_b").agg(pick("_q").alias("_e"))
    ends = ends.withColumn("_far", pick("_e").over(Window.partitionBy(*keys).orderBy(turn("_b")).rowsBetween(Window.unboundedPreceding, -1))).drop("_e")
    joined = _met(each, ends, [*keys, "_b"])
    return joined.withColumn("_run", (F.least if falling else F.greatest)("_run", "_far"))


def _back(df: DataFrame, each: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``df`` with what ``each`` says of its group's value."""
    named = each.withColumnRenamed("_v", "_vv")
    on = F.col(value).cast("double") == F.col("_vv")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(named, on, "left").drop("_vv", *[f"_k{i}" for i in range(len(by))])


def p_adjust(df: DataFrame, p: str, by: list[str], method: str = "BH", out: str = "p_adjusted") -> DataFrame:
    """Adjusted p-values within groups; nulls and NaN stay null and don't count.

    Methods: none, bonferroni, holm, BH (alias fdr), BY.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    each, v, n, one = distinct_ranks(df, p, by), F.col("_v"), F.col("_n"), F.lit(1.0)
    # of equal values the last rank counts for BH and the first for holm: running extremes even the others out
    if method == "none":
        each = each.withColumn("_run", v)
    elif method == "bonferroni":
        each = each.withColumn("_run", v * n)
    elif method == "holm":
        each = _running(each, keys, v * (n - F.col("_below")), False)
    elif method in ("BH", "fdr", "BY"):
        scale = harmonic(n) if method == "BY" else one
        each = _running(each, keys, v * scale * n / (F.col("_below") + F.col("_same")), True)
    else:
        raise ValueError(method)
    each = each.select(*keys, "_v", (F.col("_run") if method == "none" else F.least(one, "_run")).alias("_adjusted"))
    return _back(df, each, p, by).withColumn(out, F.col("_adjusted")).drop("_adjusted")


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed up to 1,000 terms, beyond that by its asymptotic series (exact to double precision there)."""
    x = n.cast("double")
    series = F.log(x) + 0.57721566490153286 + 1 / (2 * x) - 1 / (12 * x * x)
    return F.when(n <= 1000, F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(1000)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)).otherwise(series)


def average_rank(df: DataFrame, value: str, by: list[str], out: str = "average_rank") -> DataFrame:
    """Rank from 1 with ties averaged; null for nulls and NaN."""
    each = distinct_ranks(df, value, by)
    each = each.select(*[f"_k{i}" for i in range(len(by))], "_v", (F.col("_below") + (F.col("_same") + 1) / 2).alias("_rank"))
    return _back(df, each, value, by).withColumn(out, F.col("_rank")).drop("_rank")


def rank_bin(df: DataFrame, value: str, bins: int, by: list[str], out: str = "bin") -> DataFrame:
    """``ceil(average rank / n * bins)``, from 1 to ``bins``; null for nulls and NaN."""
    each = distinct_ranks(df, value, by)
    rank = (F.col("_below") + (F.col("_same") + 1) / 2) / F.col("_n") * bins
    each = each.select(*[f"_k{i}" for i in range(len(by))], "_v", F.least(F.greatest(F.ceil(rank), F.lit(1)), F.lit(bins)).cast("int").alias("_bin"))
    return _back(df, each, value, by).withColumn(out, F.col("_bin")).drop("_bin")


def argmin(df: DataFrame, metric: str, index: str, by: list[str] | None = None) -> DataFrame:
    """The row of the least metric, the first index among equals; NaN and null never win."""
    ok = df.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    return ok.groupBy(*(by or [])).agg(F.min_by(F.struct(*df.columns), F.struct(F.col(metric), F.col(index))).alias("_best")).select("_best.*")
