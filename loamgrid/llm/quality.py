"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Bytes are embedded, learned filters run over each chunk, each filter's
largest response in the chunk goes through a small dense layer, and the mean
of the chunks' outputs gives one probability.  Every weight is trained by
back-propagation with Adam.

The network is fitted at the driver on a bounded sample: at most ``EXAMPLES``
labelled texts of either label, those with the least hash of the id.  Whole
texts come to the driver, and each epoch draws ``TRAIN_CHUNKS`` of a text's
chunks anew from all over it.  Scores take all chunks and nothing but the text.

Defined cases: a null or empty text is one chunk of padding; null labels are
no labels, an id with several gets the least; without labels of both kinds
every score is the share of good ones (0.5 without any); equal texts get equal
scores; an empty table gives an empty result; an input column named like a
result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_arrow, schema_plus, slim, small_batches, texts_as_bytes
from .toxicity import held_out, sampled, sigmoid

CHUNK, OVERLAP, STRIDE = 512, 8, 4
WIDTH = 2 * STRIDE
EMBED, FILTERS, HIDDEN = 8, 32, 16
EXAMPLES, TRAIN_CHUNKS = 2000, 6
EPOCHS, BATCH, RATE = 6, 48, 0.004
#: Chunks in one pass through the network.
STEP = 384


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``CHUNK`` bytes (zero beyond a text's end), and where each text's rows begin."""
    hop = CHUNK - OVERLAP
    counts = [max(1, -(-max(len(t) - OVERLAP, 1) // hop)) for t in texts]
    heads = np.concatenate(([0], np.cumsum(counts)))
    flat = np.frombuffer(b"".join([t.ljust(n * hop, b"\0") if len(t) <= n * hop else t[: n * hop] for t, n in zip(texts, counts)]) + bytes(OVERLAP), np.uint8)
    rows = np.lib.stride_tricks.as_strided(flat, (int(heads[-1]), CHUNK), (hop, 1)).copy()
    # the last row of a text ends with its own tail, not the next text's start
    rows[heads[1:] - 1, hop:] = 0
    for k, (t, n) in enumerate(zip(texts, counts)):
        if len(t) > n * hop:
            tail = t[n * hop :]
            rows[heads[k + 1] - 1, hop : hop + len(tail)] = np.frombuffer(tail, np.uint8)
    return rows, heads


class Network:
    """Weights, one pass and its gradient."""

    NAMES = ("embed", "left", "right", "bias", "dense", "dense_bias", "out", "out_bias")

    def __init__(self, seed: int = 7):
        rng = np.random.Generator(np.random.Philox(seed))
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.embed = (rng.standard_normal((256, EMBED)) * 0.5).astype(np.float32)
        self.left, self.right = draw(STRIDE * EMBED, FILTERS), draw(STRIDE * EMBED, FILTERS)
        self.bias, self.dense = np.zeros(FILTERS, np.float32), draw(FILTERS, HIDDEN)
        self.dense_bias, self.out = np.zeros(HIDDEN, np.float32), draw(HIDDEN, 1)
        self.out_bias = np.zeros(1, np.float32)

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.embed[rows].reshape(len(rows), CHUNK // STRIDE, STRIDE * EMBED)
        c = x[:, :-1] @ self.left
        c += x[:, 1:] @ self.right
        return x, c, c.max(axis=1) + self.bias

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for lo in range(0, len(rows), STEP):
            p = np.maximum(self.pooled(rows[lo : lo + STEP])[2], 0)
            out.append(np.maximum(p @ self.dense + self.dense_bias, 0) @ self.out[:, 0] + self.out_bias[0])
        return np.concatenate(out)

    def gradient(self, rows: np.ndarray, heads: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        n, sizes = len(rows), np.diff(heads)
        x, c, raw = self.pooled(rows)
        at = c.argmax(axis=1)
        p = np.maximum(raw, 0)
        h = np.maximum(p @ self.dense + self.dense_bias, 0)
        z = np.add.reduceat(h @ self.out[:, 0] + self.out_bias[0], heads[:-1]) / sizes
        prob = sigmoid(z)
        loss = float(np.mean(np.logaddexp(0, np.where(y > 0, -z, z))))
        dz = np.repeat((prob - y) / len(y) / sizes, sizes).astype(np.float32)
        d_out, d_ob = h.T @ dz[:, None], np.array([dz.sum()], np.float32)
        dh = dz[:, None] * self.out[:, 0][None, :] * (h > 0)
        d_dense, d_db = p.T @ dh, dh.sum(0)
        dp = (dh @ self.dense.T) * (p > 0)
        # only each filter's best place has a gradient
        i = np.arange(n)[:, None]
        first, second = x[i, at], x[i, at + 1]
        d_left = np.einsum("nfk,nf->kf", first, dp, optimize=True)
        d_right = np.einsum("nfk,nf->kf", second, dp, optimize=True)
        d_embed = np.zeros_like(self.embed)
        grid = rows.reshape(n, CHUNK // STRIDE, STRIDE)
        for w, place in ((self.left, at), (self.right, at + 1)):
            dx = (dp[:, :, None] * w.T[None, :, :]).reshape(-1, EMBED)
            which = grid[i, place].reshape(-1)
            for e in range(EMBED):
                d_embed[:, e] += np.bincount(which, dx[:, e], 256).astype(np.float32)
        return loss, [d_embed, d_left, d_right, dp.sum(0), d_dense, d_db, d_out, d_ob]


def train(texts: list[bytes], y: np.ndarray, seed: int = 7) -> Network:
    """Fit on labelled texts; each epoch draws chunks of each text anew."""
    net = Network(seed)
    y = np.asarray(y, np.float32)
    good = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < good < 1:
        net.out[:] = 0
        net.out_bias[:] = np.log((good * 0.98 + 0.01) / (1 - good * 0.98 - 0.01))
        return net
    rng = np.random.Generator(np.random.Philox(seed + 1))
    rows, heads = chunks(texts)
    m = [np.zeros_like(getattr(net, a)) for a in net.NAMES]
    v = [np.zeros_like(getattr(net, a)) for a in net.NAMES]
    epochs = max(EPOCHS, min(60, -(-400 * BATCH // len(y))))
    total, step = epochs * -(-len(y) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            own = order[lo : lo + BATCH]
            picks = [np.sort(rng.choice(n, min(n, TRAIN_CHUNKS), replace=False)) + h for n, h in zip(np.diff(heads)[own], heads[own])]
            at = np.concatenate(([0], np.cumsum([len(p) for p in picks])))
            _, g = net.gradient(rows[np.concatenate(picks)], at, y[own])
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for k, name in enumerate(net.NAMES):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                getattr(net, name)[...] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
    return net


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """One probability per whole text."""
    rows, heads = chunks(texts)
    return sigmoid(np.add.reduceat(net.logits(rows), heads[:-1]) / np.diff(heads))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, examples: int = EXAMPLES) -> Network:
    """Train on labelled rows outside the held-out fold."""
    docs = slim(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    known = known.filter(~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = dict(known.groupBy((F.col("quality") > 0).cast("int").alias("q")).count().collect())
    ids = sampled(known.filter("quality > 0"), examples, 3).withColumn("y", F.lit(1.0)).unionByName(sampled(known.filter("quality <= 0"), examples, 4).withColumn("y", F.lit(0.0)))
    rows = docs.join(F.broadcast(ids), "doc_id").select("doc_id", F.col("text").cast("binary").alias("text"), "y").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts, y = [x or b"" for x in rows.column("text").to_pylist()], np.asarray(rows.column("y"))
    net = train(texts, y)
    drawn = {int(v): int((y == v).sum()) for v in (0, 1)}
    if all(drawn.values()) and all(counts.get(v) for v in (0, 1)):
        # the sample is balanced otherwise than the labels; the odds are set right
        net.out_bias += np.float32(np.log(counts[1] / counts[0]) - np.log(drawn[1] / drawn[0]))
    return net


def scores(docs: DataFrame, net: Network, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is good."""
    low = [c.lower() for c in small_batches(docs).columns]
    name = docs.columns[low.index(text.lower())]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != score.lower()])
    weights = {a: getattr(net, a) for a in net.NAMES}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.__dict__.update(weights)
        for b in blocks(batches, name):
            p = probabilities(own, texts_as_bytes(b, name))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.astype(float), pa.float64())], names=[*b.schema.names, score])

    return rows.transform(map_arrow, run, schema_plus(rows, f"`{score}` double"))
