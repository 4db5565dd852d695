"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the words a text holds, trained from confirmed toxic
examples and unlabelled text with the risk of Kiryo et al. (2017),

    prior * mean_P l(f) + max(0, mean_U l(-f) - prior * mean_P l(-f)),

where ``l`` is the logistic loss and ``prior`` the share of toxic text.  Where
the bracket would go below zero it counts as zero, which keeps a flexible
model from calling every unlabelled text clean; such a step moves along the
bracket's gradient alone, upwards, until it isn't negative any more.

Features are presences of words (A-Z lower-cased, runs of digits, letters and
characters outside ASCII) and of their first bytes, as inflected words share
stems, hashed into ``BUCKETS``.  Only features clearly more frequent in the
positives than in unlabelled text are kept.  The sample is bounded: at most ``POSITIVES`` and
``UNLABELLED`` texts, those with the least hash of the id.  Scores use whole
texts and nothing but the text.

Defined cases: null, empty and blank texts have no words and get the score of
the bias alone; a null label is no label, an id with several labels is toxic
if one of them is; without positives every score is the prior; equal texts get
equal scores; an empty table gives an empty result; an input column named like
a result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import blocks, map_arrow, schema_plus, slim, small_batches, texts_as_bytes

BUCKETS = 1 << 18
POSITIVES, UNLABELLED = 4000, 12_000
#: Sizes in bytes of the word beginnings that are features too.
STEMS = (4, 5, 6)
#: Words in more than this share of unlabelled texts are common.
COMMON = 0.01
#: Features kept: in so many unlike positives and that share of them, and more frequent there than in unlabelled text by so many standard errors and that factor.
LEAST_DOCS, LEAST_SHARE, LEAST_Z, LEAST_LIFT = 3, 0.006, 4.5, 5.0
STEPS, RATE, SHRINK = 300, 0.1, 3e-6


@dataclass(frozen=True)
class Model:
    """Weights of the buckets, bias, and the risk at each step."""

    weights: np.ndarray
    bias: float
    risks: tuple[float, ...] = ()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of each text, one after another, and where each text's begin."""
    buf, starts, ends = kernels.joined(texts)
    at, word_ends, hashes = kernels.words(buf, kernels.ALNUM)
    doc = np.repeat(np.arange(len(texts)), np.searchsorted(at, ends) - np.searchsorted(at, starts))
    mark = np.uint64(BUCKETS - 1)
    keys = [(doc.astype(np.uint64) << np.uint64(32)) | (hashes & mark)]
    for n in STEMS:
        stem = np.flatnonzero(word_ends - at > n)
        keys.append((doc[stem].astype(np.uint64) << np.uint64(32)) | (kernels.prefix_hashes(buf, at[stem], n) & mark))
    key = np.unique(np.concatenate(keys))
    heads = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    return (key & np.uint64(BUCKETS - 1)).astype(np.int64), heads


def margins(weights: np.ndarray, bias: float, buckets: np.ndarray, heads: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(weights[buckets])))
    return bias + sums[heads[1:]] - sums[heads[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _rows(buckets: np.ndarray, heads: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = heads[rows + 1] - heads[rows]
    own = np.concatenate(([0], np.cumsum(size)))
    return buckets[np.repeat(heads[rows] - own[:-1], size) + np.arange(own[-1])], own


def holders(buckets: np.ndarray, heads: np.ndarray, common: np.ndarray) -> np.ndarray:
    """How many unlike texts hold each bucket.

    Near copies count once: they are told by the same minimum of a permutation
    over their rarer words (those that aren't ``common``).
    """
    n, least, buckets = len(heads) - 1, None, buckets.astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(heads))
    rare = np.flatnonzero(~common[buckets])
    for a in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D):
        own = np.arange(n) + (1 << 32)  # a text of common words alone is like no other
        if len(rare):
            first = np.flatnonzero(np.diff(doc[rare], prepend=-1))
            own[doc[rare][first]] = np.minimum.reduceat((buckets[rare] * a) & 0xFFFFFFFF, first)
        pairs = np.unique((buckets << 34) | own[doc])
        count = np.bincount(pairs >> 34, minlength=BUCKETS)
        least = count if least is None else np.minimum(least, count)
    return least


def train(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], prior: float) -> Model:
    """Minimise the non-negative risk over the whole sample by Adam."""
    n_p, n_u = len(positive[1]) - 1, len(unlabelled[1]) - 1
    weights = np.zeros(BUCKETS)
    prior = min(max(prior, 1e-4), 0.9)
    start = float(np.log(prior / (1 - prior)))
    if not n_p or not n_u:
        return Model(weights, start)
    held_u = np.bincount(unlabelled[0], minlength=BUCKETS)
    held_p = holders(*positive, held_u > COMMON * n_u)
    mean = (held_p + held_u) / (n_p + n_u)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / n_p + 1 / n_u))
    kept = np.flatnonzero((held_p >= max(LEAST_DOCS, LEAST_SHARE * n_p)) & (held_p / n_p - held_u / n_u > LEAST_Z * spread) & (held_p / n_p > LEAST_LIFT * held_u / n_u))
    number = np.full(BUCKETS, -1)
    number[kept] = np.arange(len(kept))
    held = number >= 0

    def small(x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        good = held[x[0]]
        sums = np.concatenate(([0], np.cumsum(good, dtype=np.int32)))
        return number[x[0][good]], sums[x[1]]

    p, u = small(positive), small(unlabelled)
    w = np.zeros(len(kept) + 1)
    w[-1] = start
    m, v, risks = np.zeros_like(w), np.zeros_like(w), []
    (xu, hu), (xp, hp) = u, p
    loss = lambda z: np.logaddexp(0, -z)
    for step in range(1, STEPS + 1):
        fu, fp = margins(w, w[-1], xu, hu), margins(w, w[-1], xp, hp)
        rest = loss(-fu).mean() - prior * loss(-fp).mean()
        risks.append(prior * loss(fp).mean() + max(0.0, rest))
        # d loss(f) = -sigmoid(-f), d loss(-f) = sigmoid(f)
        gu, gp = sigmoid(fu) / n_u, -prior * sigmoid(fp) / n_p
        if rest > 0:
            gp -= prior * sigmoid(-fp) / n_p
        else:  # the bracket alone, upwards
            gu, gp = -gu, -gp
        g = (np.bincount(xu, np.repeat(gu, np.diff(hu)), len(w)) + np.bincount(xp, np.repeat(gp, np.diff(hp)), len(w))).astype(float)
        g[-1] = gu.sum() + gp.sum()
        g[:-1] += SHRINK * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = RATE * (1 - step / (STEPS + 1))
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        # every kept feature is one that positives hold more often
        np.maximum(w[:-1], 0, out=w[:-1])
    weights[kept] = w[:-1]
    return Model(weights, float(w[-1]), tuple(risks))


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether an id belongs to the fold whose labels are never read; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(parts)) == part, F.lit(False))


def sampled(docs: DataFrame, n: int, salt: int) -> DataFrame:
    """At most ``n`` ids, those with the least hash."""
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    return ids.withColumn("_h", F.xxhash64("doc_id", F.lit(salt))).orderBy("_h", "doc_id").limit(n).select("doc_id")


def _collect(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts of a bounded table of ids, at the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            buckets, heads = features(texts_as_bytes(b))
            own = pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.array(buckets, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), own], names=["doc_id", "buckets"])

    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text").transform(map_arrow, run, "doc_id bigint, buckets array<int>")
    got = rows.toArrow().sort_by("doc_id").column("buckets").combine_chunks()
    got = pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got
    heads = np.concatenate(([0], np.cumsum(np.asarray(got.value_lengths(), np.int64)))).astype(np.int64)
    return np.asarray(got.flatten(), np.int32), heads


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Train on rows outside the held-out fold: toxic examples, and any text as unlabelled."""
    docs = slim(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    p = _collect(docs, sampled(known.filter("toxic > 0"), positives, 1))
    u = _collect(docs, sampled(docs.filter(~held_out(F.col("doc_id"), parts, part)), unlabelled, 2))
    return train(p, u, prior)


def scores(docs: DataFrame, model: Model, text: str = "text", score: str = "score", below: float | None = None) -> DataFrame:
    """``docs`` with the probability that each whole text is toxic.

    With ``below``, only rows whose score is less, and no score column.
    """
    low = [c.lower() for c in small_batches(docs).columns]
    name = docs.columns[low.index(text.lower())]
    rows = docs if below is not None else docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != score.lower()])
    weights, bias = model.weights.astype(np.float32), model.bias

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = weights.astype(float)
        for b in blocks(batches, name):
            p = sigmoid(margins(own, bias, *features(texts_as_bytes(b, name))))
            if below is not None:
                yield b.filter(pa.array(p < below))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, score])

    schema = rows.schema if below is not None else schema_plus(rows, f"`{score}` double")
    return rows.transform(map_arrow, run, schema)
