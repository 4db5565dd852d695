"""Sharding over fixed virtual slots; DataFrame functions only.

Records hash into a fixed number of virtual slots (thousands).  Bytes are
summed per slot, and a versioned slot-to-shard map, a table in shared
storage, says which shard holds which slot.  Rebalancing edits the map: it
moves the fewest slots that even the load out and appends a new version, and
no record is ever hashed anew.

Equal texts hash alike, so a group of copies stays in one slot and one shard.
Only a group that alone is more than a shard's fair load can't be kept whole
with near equal shards; its rows are spread over the slots by their id instead.

Only the table of slots (its size is the constant ``n_slots``) comes to the
driver.  Defined cases: a null text has no bytes, so size is 16; a null id
hashes like any other value; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, stored

ROW_OVERHEAD = 16


def slot_loads(placed: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot; partial sums precede the shuffle."""
    return placed.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def place(docs: DataFrame, n_slots: int = 8192, n_shards: int = 40) -> DataFrame:
    """``doc_id, text_crc32, size, vslot`` of each row; texts are read and hashed once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(F.col("doc_id"), F.crc32(text).alias("text_crc32"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.xxhash64(text).alias("_group")), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    # groups of more than a fair load are fewer than the shards
    hot = rows.groupBy("_group").agg(F.sum("size").alias("_bytes")).filter(F.col("_bytes") * n_shards > total).select("_group", F.lit(True).alias("_hot"))
    key = F.when(F.col("_hot"), F.xxhash64("doc_id", "_group")).otherwise(F.xxhash64("_group"))
    return rows.join(F.broadcast(hot), "_group", "left").select("doc_id", "text_crc32", "size", F.pmod(key, F.lit(n_slots)).cast("int").alias("vslot"))


def build_map(loads: dict[int, int], n_slots: int, n_shards: int) -> list[int]:
    """First map: slots by falling load, each to the lightest shard so far."""
    heap = [(0, s) for s in range(n_shards)]
    out = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda s: (-loads.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), shard))
    return out


def rebalance(old: list[int], loads: dict[int, int], n_shards: int, slack: float = 0.01) -> list[int]:
    """The next version of a map: slots leave only shards above the fair load.

    From the heaviest shard, the largest slot that fits goes to the lightest,
    until no shard is above ``1 + slack`` times the fair load or no slot fits.
    A slot of a shard that no longer exists always moves.
    """
    out, fair = list(old), sum(loads.values()) / n_shards
    held: dict[int, list[int]] = {s: [] for s in range(n_shards)}
    homeless = []
    for slot, shard in enumerate(out):
        (held[shard] if shard < n_shards else homeless).append(slot)
    load = {s: sum(loads.get(x, 0) for x in held[s]) for s in held}
    for slot in sorted(homeless, key=lambda x: -loads.get(x, 0)):
        to = min(load, key=lambda s: (load[s], s))
        out[slot] = to
        load[to] += loads.get(slot, 0)
        held[to].append(slot)
    for shard in sorted(load, key=lambda s: -load[s]):
        for slot in sorted(held[shard], key=lambda x: -loads.get(x, 0)):
            w = loads.get(slot, 0)
            if load[shard] <= fair * (1 + slack):
                break
            to = min(load, key=lambda s: (load[s], s))
            if w and to != shard and load[to] + w <= fair * (1 + slack) and load[shard] - w >= fair * (1 - slack):
                out[slot] = to
                load[shard] -= w
                load[to] += w
    return out


class SlotMap:
    """Versioned map from slots to shards in shared storage; versions are only added."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "slot-map")

    def append(self, version: int, shards: list[int]) -> None:
        frame = self.spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(shards)), "array<int>")).alias("vslot", "shard"))
        frame.select(F.lit(version).alias("version"), "vslot", "shard").coalesce(1).write.mode("append").parquet(self.path)

    def read(self, version: int | None = None) -> DataFrame:
        table = self.spark.read.schema("version int, vslot int, shard int").parquet(self.path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        return table.filter(F.col("version") == version)


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = 8192) -> DataFrame:
    """Each row's shard under the law ``bytes``, and its place there.

    Places are gapless from 0 in each shard: the slots of a shard follow one
    another in the map, and rows are numbered inside their slot, so no window
    ever spans a shard.
    """
    spark = docs.sparkSession
    placed = place(docs, n_slots, n_shards)
    loads = slot_loads(placed).collect()  # at most n_slots rows
    table = SlotMap(spark)
    first = build_map({r["vslot"]: r["bytes"] for r in loads}, n_slots, n_shards)
    table.append(1, first)
    counts, first_place, filled = {r["vslot"]: r["n"] for r in loads}, [0] * n_slots, [0] * n_shards
    for slot in range(n_slots):
        first_place[slot] = filled[first[slot]]
        filled[first[slot]] += counts.get(slot, 0)
    starts = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(first_place)), "array<bigint>")).alias("vslot", "_first"))
    slots = table.read(1).select("vslot", "shard").join(F.broadcast(starts), "vslot")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    out = placed.withColumn("_rank", rank).join(F.broadcast(slots), "vslot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot"))
