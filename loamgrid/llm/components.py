"""Connected components of a table of links, on DataFrames only.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each
round hooks neighbours to the least node around them, and the links become
stars around the least node of each component in a few rounds.  Minima are
taken by partial aggregates and the joins are plain equi-joins, which adaptive
execution splits where a hub is large.  Each round is written to shared
storage.

Up to ``FEW_LINKS`` links fit one task's memory many times over; they are
counted first, and then one union-find gives the same table without rounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored


#: Links that one task may hold (about 200 bytes each).
FEW_LINKS = 500_000


def union_find(edges: DataFrame) -> DataFrame:
    """Components of a bounded table of links, in one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(u), root(v)
                if x != y:
                    up[max(x, y)] = min(x, y)
        if kind is not None:
            nodes = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "component"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(1).transform(map_arrow, run, f"node {kind}, component {kind}")


def components(links: DataFrame, a: str = "a", b: str = "b", few_links: int = FEW_LINKS) -> DataFrame:
    """``(node, component)`` for every node of a link; the component is its least node.

    Nodes are of any ordered kind.  Links may repeat, point either way or from
    a node to itself; an empty table gives an empty result.  Null ends are
    no nodes.
    """
    edges = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges, before = stored(edges, "links"), None
    if edges.count() <= few_links:
        return stored(union_find(edges), "components")
    edges = edges.distinct()
    loops = edges.filter("u = v").select("u")
    edges = edges.filter("u <> v")
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = stored(both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    joined = stars.unionByName(roots)
    return joined.unionByName(alone.join(joined.select("node"), "node", "left_anti"))
