"""Contiguity graphs of polygons and connected components of small graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neighbors


def queen_contiguity(vertices: DataFrame, snap: float = 1.0) -> DataFrame:
    """Directed pairs ``i, j`` of polygons that share a vertex, snapped to a grid of ``snap``.

    ``vertices`` is (id, x, y).  A vertex belongs to few polygons, so the
    self-join on the snapped vertex stays near the number of vertices.
    """
    v = vertices.select("id", F.round(F.col("x") / snap).cast("long").alias("_x"), F.round(F.col("y") / snap).cast("long").alias("_y")).distinct()
    a, b = v.withColumnRenamed("id", "i"), v.withColumnRenamed("id", "j")
    return a.join(b, ["_x", "_y"]).filter("i <> j").select("i", "j").distinct()


def edge_contacts(rings: DataFrame, snap: float = 1.0) -> DataFrame:
    """Directed pairs ``i, j`` of polygons of which one has a vertex within ``snap`` of an edge of the other.

    ``rings`` is (id, seq, x, y), each ring's vertices in order.  Edges and
    vertices meet on grid cells of the mean edge length, so an edge meets the
    vertices around it and not all of them.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("id").orderBy("seq")
    whole = Window.partitionBy("id")
    p = rings.select("id", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    first = lambda c: F.min_by(c, "seq").over(whole)
    e = p.select(F.col("id").alias("i"), "x", "y", F.coalesce(F.lead("x").over(order), first("x")).alias("x2"), F.coalesce(F.lead("y").over(order), first("y")).alias("y2"))
    length = F.sqrt((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2)
    side = max(e.agg(F.avg(length)).first()[0] or 0.0, 4 * snap)
    cells = e
    for a, b, g in (("x", "x2", "gx"), ("y", "y2", "gy")):
        low, high = F.floor((F.least(a, b) - snap) / side), F.floor((F.greatest(a, b) + snap) / side)
        cells = cells.withColumn(g, F.explode(F.sequence(low, high)))
    v = p.select(F.col("id").alias("j"), F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / side).alias("gx"), F.floor(F.col("y") / side).alias("gy")).distinct()
    met = cells.join(v, ["gx", "gy"]).filter("i <> j")
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    norm = dx * dx + dy * dy
    t = F.when(norm > 0, F.least(F.greatest(((F.col("px") - F.col("x")) * dx + (F.col("py") - F.col("y")) * dy) / norm, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    far = F.sqrt((F.col("px") - F.col("x") - t * dx) ** 2 + (F.col("py") - F.col("y") - t * dy) ** 2)
    touching = met.filter(far <= snap).select("i", "j")
    return touching.unionByName(touching.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def repair_isolates(pairs: DataFrame, centres: DataFrame) -> DataFrame:
    """``i, j, repaired``: polygons without neighbours are linked both ways to the nearest that has some.

    ``centres`` is (id, x, y).
    """
    linked = pairs.select(F.col("i").alias("id")).distinct()
    alone, rest = centres.join(linked, "id", "left_anti"), centres.join(linked, "id", "left_semi")
    out = pairs.withColumn("repaired", F.lit(False))
    if alone.isEmpty():
        return out
    e = neighbors.knn(rest, 1, ["x", "y"], targets=alone).select(F.col("target_id").alias("i"), F.col("source_id").alias("j"))
    both = e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    return out.unionByName(both.withColumn("repaired", F.lit(True)))


def connected(pairs: DataFrame, nodes: DataFrame, rounds: int = 1000) -> DataFrame:
    """``id, component`` by spreading the least label over links with pointer jumping; checkpointed each round."""
    label = nodes.select("id", F.col("id").alias("component"))
    spark = nodes.sparkSession
    durable = bool(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    for _ in range(rounds):
        near = pairs.join(label.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(F.min("component").alias("_m"))
        new = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("_m", "component")).alias("component"))
        up = new.select(F.col("id").alias("component"), F.col("component").alias("_up"))
        new = new.join(up, "component").select("id", F.least("component", "_up").alias("component"))
        new = new.checkpoint() if durable else new.persist()
        changed = new.join(label.withColumnRenamed("component", "_old"), "id").filter("component <> _old").limit(1).count()
        label = new
        if not changed:
            return label
    raise RuntimeError("labels still change")


def standardised_weights(pairs: DataFrame) -> DataFrame:
    """``i, j, v`` with equal weights that sum to one in each row."""
    degree = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("_d"))
    return pairs.join(degree, "i").select("i", "j", (1 / F.col("_d")).alias("v"))
