"""Near-duplicate classes by min-max hashing, confirmed on full shingle sets.

A document's set holds its distinct 5-word shingles (A-Z lower-cased, words
split at white space); fewer words make one shingle.  Documents with a
Jaccard similarity of at least 0.75 are linked; classes are the connected
components.

1.  One pass over the texts gives each document a 128-bit key of its set and
    a min-max signature: each of ``n_bands * n_rows / 2`` permutations yields
    its minimum *and* its maximum, and bands of ``n_rows`` values are hashed.
    With 45 bands of 4, a pair at 0.75 shares none with probability 4e-8.
2.  Equal sets fold into one node, by a partial aggregate.
3.  Nodes that share a band are hooked to the least node of the band; the
    components of these hooks hold every candidate pair.
4.  Each component's texts meet once.  A union-find over its bands compares
    signatures in blocks, sorts likely pairs first, and confirms on full sets
    only pairs whose ends aren't connected yet.  What leaves the task is one
    confirmed link per union, never all pairs.
5.  Components of the confirmed links are the classes.

A component above ``group_nodes`` nodes isn't sent to one task: its bands
become the groups instead, and a band above that size is dealt as pairs of
blocks, so that every candidate pair still meets in some bounded task.

Defined cases: null, empty and blank texts have an empty set (``n_shingles``
0) and are linked with nothing, being their own class; equal rows are linked
(similarity 1); a null id never names a class unless all its members' ids are
null; an empty table gives an empty result; only key and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels
from .common import blocks, free_name, map_arrow, slim, stored, texts_as_bytes
from .components import components

WIDTH, BANDS, ROWS = 5, 45, 4
#: Pairs whose signatures agree less are never confirmed: over six standard deviations below 0.75.
LEAST_AGREEMENT = 0.52
#: Nodes of the largest group that one task resolves.
GROUP_NODES = 4096
#: A table of candidates is broadcast only up to so many rows (about 60 bytes each).
BROADCAST_ROWS = 300_000


def permutations(n: int) -> np.ndarray:
    """Odd multipliers: x -> a * x is a permutation of the 64-bit words."""
    return np.random.Generator(np.random.Philox(977)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], n_bands: int = BANDS, n_rows: int = ROWS) -> np.ndarray:
    """Min-max signatures of non-empty sets: a row each, ``n_bands * n_rows`` 32-bit values."""
    values = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), n_bands * n_rows), np.uint32)
    for k, a in enumerate(permutations(n_bands * n_rows // 2)):
        v = values * a
        out[:, 2 * k] = np.minimum.reduceat(v, first) >> np.uint64(32)
        out[:, 2 * k + 1] = np.maximum.reduceat(v, first) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray, n_bands: int = BANDS, n_rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band; the band's number goes into it."""
    grid = signature.reshape(len(signature), n_bands, n_rows).astype(np.uint64)
    h = np.arange(1, n_bands + 1, dtype=np.uint64)[None, :] * kernels.SHINGLE_CODES[10]
    h = np.repeat(h, len(signature), axis=0)
    for r in range(n_rows):
        h = kernels.mixed(h + grid[:, :, r] * kernels.SHINGLE_CODES[r])
    return h.view(np.int64)


def set_key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, on sorted distinct values."""
    small = min(len(a), len(b))
    if 100 * small < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def resolve(sets: list[np.ndarray], percent: int = 75, n_bands: int = BANDS, n_rows: int = ROWS) -> list[tuple[int, int]]:
    """Spanning links of the similarity graph of some sets, found through their bands."""
    n = len(sets)
    if n < 2:
        return []
    if n == 2:
        return [(0, 1)] if linked(sets[0], sets[1], percent) else []
    signature = signatures(sets, n_bands, n_rows)
    keys = band_keys(signature, n_bands, n_rows)
    root = np.arange(n)
    links: list[tuple[int, int]] = []
    refuted = np.zeros((n, n), bool)
    seen: set[bytes] = set()
    for band in range(n_bands):
        order = np.argsort(keys[:, band], kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order, band])) + 1
        for members in np.split(order, cuts):
            if len(members) < 2 or (same := members.tobytes()) in seen:
                continue
            seen.add(same)
            done = np.zeros(len(members), bool)
            while True:
                # all outside the largest class against all, a few at a time: pairs inside a class are connected,
                # and classes grow as pairs are confirmed
                roots, own, counts = np.unique(root[members], return_inverse=True, return_counts=True)
                if len(roots) < 2:
                    break
                few = np.flatnonzero(~done & (own.reshape(-1) != counts.argmax()))[:64]
                if not len(few):
                    break
                done[few] = True
                part = members[few]
                agree = np.zeros((len(part), len(members)), np.int32)
                for c in range(signature.shape[1]):
                    agree += signature[part, c][:, None] == signature[members, c][None, :]
                i, j = np.nonzero((agree >= LEAST_AGREEMENT * signature.shape[1]) & (root[part][:, None] != root[members][None, :]))
                order = np.argsort(-agree[i, j], kind="stable")
                left, right = part[i[order]], members[j[order]]
                for lo in range(0, len(left), 256):
                    x, y = left[lo : lo + 256], right[lo : lo + 256]
                    open_ = (root[x] != root[y]) & ~refuted[x, y]
                    for a, b in zip(x[open_].tolist(), y[open_].tolist()):
                        if root[a] == root[b]:
                            continue
                        if linked(sets[a], sets[b], percent):
                            links.append((a, b))
                            root[root == root[b]] = root[a]
                        else:
                            refuted[a, b] = refuted[b, a] = True
    return links


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, text_crc32, n_shingles, node, bands`` of each row; node and bands are null for empty sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            texts = texts_as_bytes(b)
            sets = kernels.document_shingles(texts, WIDTH)
            full = [k for k, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if full:
                for k, row in zip(full, band_keys(signatures([sets[k] for k in full]))):
                    bands[k] = row
            nodes = [set_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(zlib.crc32, texts), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_crc32", "n_shingles", "node", "bands"],
            )

    return docs.transform(map_arrow, run, "doc_id bigint, text_crc32 bigint, n_shingles bigint, node binary, bands array<bigint>")


def groups_of(hooks: DataFrame, members: DataFrame, group_nodes: int = GROUP_NODES) -> DataFrame:
    """``(gid, node)``: bounded groups in which every candidate pair meets."""
    found = stored(components(hooks, "node", "hook"), "candidates")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.filter(F.col("n") > group_nodes).select("component"), "large-components")
    if large.isEmpty():
        return found.select(F.xxhash64("component").alias("gid"), "node")
    small = found.join(large, "component", "left_anti").select(F.xxhash64("component").alias("gid"), "node")
    rest = members.join(found.join(large, "component").select("node"), "node").select("band", "node")
    half = group_nodes // 2
    blocks_ = rest.groupBy("band").agg(F.count(F.lit(1)).alias("n")).select("band", F.ceil(F.col("n") / half).cast("int").alias("k"))
    dealt = rest.join(blocks_, "band").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return small.unionByName(pairs.select(F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")).alias("gid"), "node")).distinct()


def confirmed(docs: DataFrame, groups: DataFrame, percent: int = 75) -> DataFrame:
    """Confirmed links ``(a, b)`` between nodes: a spanning forest of each group.

    ``docs`` has a row per group and node: ``gid, node, key, text``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: dict[int, np.ndarray]) -> pa.RecordBatch:
            names, links = list(held), resolve(list(held.values()), percent)
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in links], pa.int64()), pa.array([names[j] for _, j in links], pa.int64())], names=["a", "b"])

        gid, held = None, {}
        for b in blocks(batches):
            sets = kernels.document_shingles(texts_as_bytes(b), WIDTH)
            for g, node, key, s in zip(*[b.column(k).to_pylist() for k in range(3)], sets):
                if g != gid:
                    if len(held) > 1:
                        yield done(held)
                    gid, held = g, {}
                # rows of an id that repeats with other texts are not this node's
                if set_key(s) == key:
                    held[node] = s
        if len(held) > 1:
            yield done(held)

    together = docs.repartition("gid").sortWithinPartitions("gid", "node")
    return together.select("gid", "node", "key", "text").transform(map_arrow, run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 75, group_nodes: int = GROUP_NODES) -> DataFrame:
    """``doc_id, text_crc32, n_shingles, component_id, kept`` of every row."""
    docs = slim(docs)
    base = stored(sketch(docs), "sketches")
    folded = base.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.any_value("bands").alias("bands"))
    # from here on a node goes by a number, fixed once the table is written
    nodes = stored(folded.withColumn("number", F.monotonically_increasing_id()), "nodes")
    members = nodes.select(F.explode("bands").alias("band"), F.col("number").alias("node"))
    shared = members.groupBy("band").agg(F.min("node").alias("hook"), F.max("node").alias("_top")).filter("hook <> _top").select("band", "hook")
    hooked = stored(members.join(shared, "band"), "hooked")
    groups = stored(groups_of(hooked.filter("node <> hook").select("node", "hook").distinct(), hooked, group_nodes), "groups")
    known = nodes.select(F.col("number").alias("node"), F.col("node").alias("key"), "least")
    wanted = stored(groups.join(known, "node").select("gid", "node", "key", F.col("least").alias("doc_id")), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("gid", "node", "key", "text")
    links = stored(confirmed(texts, percent), "links")
    classes = components(links)
    classes = known.join(classes, "node", "left").select("key", "least", F.coalesce("component", "node").alias("component"))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = classes.join(names, "component").select(F.col("key").alias("node"), "component_id")
    out = base.select("doc_id", "text_crc32", "n_shingles", "node").join(by_node, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_crc32", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the least id; same columns.

    Rows equal in id and text are one row of their class, and one of them stays.
    Rows without words stay.
    """
    doc, crc, copy = (free_name(docs, n) for n in ("_doc", "_crc", "_copy"))
    found = stored(near_duplicates(slim(docs, text, key), percent), "classes").withColumnsRenamed({"doc_id": doc, "text_crc32": crc})
    met = docs[key].eqNullSafe(F.col(doc)) & (F.crc32(F.coalesce(docs[text], F.lit(""))) == F.col(crc))
    lost = found.filter("not kept").select(doc, crc).distinct()
    lost = F.broadcast(lost) if found.filter("not kept").count() <= BROADCAST_ROWS else lost
    out = docs.join(lost, met, "left_anti")
    again = stored(found.filter("kept and n_shingles > 0").groupBy(doc, crc).count().filter("count > 1").select(doc, crc), "repeated")
    if again.isEmpty():
        return out
    rest, twice = out.join(again, met, "left_anti"), out.join(again, met, "left_semi")
    first = F.row_number().over(Window.partitionBy(key, F.xxhash64(text)).orderBy(F.lit(1)))
    return rest.unionByName(twice.withColumn(copy, first).filter(F.col(copy) == 1).drop(copy))
