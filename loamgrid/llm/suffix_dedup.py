"""Removal of repeated byte strings by longest-previous-factor arrays.

A start is *repeated* if the ``length`` bytes from it also start elsewhere.
A suffix array sorts starts; for each, the nearest starts before and after it
in that order that lie earlier in the corpus give its longest previous
factor, so a start is a later copy exactly if that factor has ``length``
bytes (Crochemore and Ilie, 2008).

One suffix array over a corpus can't be built, so starts are dealt to small
arrays such that equal strings always meet:

1.  Every ``length``-byte string picks the least of its ``gram``-byte hashes
    (its minimizer).  Neighbouring starts with the same minimizer form a
    *stretch*; equal strings have equal minimizers, so a repeat of a string
    lies in a stretch of the same minimizer.
2.  Stretches are counted by (minimizer, digest of the stretch).  Whole
    copies are found by that alone, and however often a passage occurs, one
    representative goes on.
3.  Representatives whose minimizer has several different stretches meet, in
    blocks of whole minimizers, in one suffix array a block.  A minimizer
    with more bytes than ``group_bytes`` isn't gathered: the digests of its
    strings are counted by an ordinary two-step aggregate instead, which
    gives the same starts.
4.  The starts found become byte ranges per document.

``keep="first"`` leaves the first copy, in order of (doc_id, place), and
removes later ones; ``keep="none"`` removes every copy.

Defined cases: a null text is empty; texts shorter than ``length`` have no
starts; matches never cross documents; rows of one id are ordered by a hash
of the text, and rows equal in id and text stand at the same place, so with
``keep="first"`` both are first; an empty table gives an empty result; other
columns are not read (:func:`ranges`) or passed through (:func:`cut_repeats`).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import blocks, free_name, map_arrow, slim, stored, texts_as_bytes

#: Most bytes of a hashed gram; a third of the length where that is less, as shorter grams mean fewer stretches.
GRAM = 128
#: Bytes of the stretches of one minimizer that one task may gather.
GROUP_BYTES = 1 << 20
#: Bytes of one suffix array.
ARRAY_BYTES = 1 << 18
#: Starts of a long text that are hashed together.
PIECE_BYTES = 1 << 19
STRETCH = "doc_id bigint, tag int, lo int, n int, minimizer bigint, digest binary"


# --- arrays ---------------------------------------------------------------

#: Bytes that one sortable word holds, at nine bits each.
WORD = 7


def rank_levels(data: np.ndarray, length: int, every: bool = True) -> tuple[list[int], list[np.ndarray]]:
    """Ranks of all places by their first 7, 14, 28, ... bytes and last by ``length`` bytes (or to the end).

    Prefix doubling; only places whose rank is shared are sorted again.
    Without ``every`` only the last level is kept.
    """
    n, have = len(data), min(WORD, length)
    kind = np.int32 if n < 1 << 30 else np.int64
    word = np.zeros(n, np.uint64)
    # nine bits a byte keep the end of the data below every byte
    wide = np.concatenate((data, np.zeros(WORD, np.uint8))).astype(np.uint16)
    wide[:n] += 1
    for k in range(have):
        word <<= np.uint64(9)
        word |= wide[k : k + n]
    del wide
    order = np.argsort(word, kind="stable")
    word = word[order]
    heads = np.ones(n, bool)
    np.not_equal(word[1:], word[:-1], out=heads[1:])
    del word
    ranks = np.empty(n, kind)
    ranks[order] = np.maximum.accumulate(np.where(heads, np.arange(n, dtype=kind), kind(0)))
    del order, heads
    sizes, levels = [have], [ranks]
    while have < length:
        step = min(have, length - have)
        old, ranks = levels[-1], levels[-1].copy()
        at = np.flatnonzero(np.bincount(old, minlength=n)[old] > 1).astype(kind)
        if len(at):
            later = np.where(at + step < n, old[np.minimum(at + step, n - 1)] + 1, 0).astype(kind)
            order = np.argsort(old[at].astype(np.int64) * (n + 1) + later, kind="stable")
            a, b, place = old[at][order], later[order], np.arange(len(at), dtype=kind)
            group = np.concatenate(([True], a[1:] != a[:-1]))
            run = group | np.concatenate(([True], b[1:] != b[:-1]))
            ranks[at[order]] = a + np.maximum.accumulate(np.where(run, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        have += step
        if not every:
            sizes, levels = [], []
        sizes.append(have)
        levels.append(ranks)
    return sizes, levels


def suffix_order(levels: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """The starts in suffix order, equal ones by place."""
    return starts[np.lexsort((starts, levels[-1][starts]))]


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the previous and of the next smaller value of each, -1 and n where there is none.

    Pointer jumping: a pointer to a value that isn't smaller follows that
    value's own pointer, all at once, until none moves.
    """
    n = len(values)
    out = []
    for v in (values, values[::-1]):
        at = np.arange(-1, n - 1, dtype=values.dtype)
        open_ = np.flatnonzero(at >= 0).astype(values.dtype)
        while len(open_):
            open_ = open_[v[at[open_]] >= v[open_]]
            at[open_] = at[at[open_]]
            open_ = open_[at[open_] >= 0]
        out.append(at)
    return out[0], n - 1 - out[1][::-1]


def previous_factors(data: bytes) -> np.ndarray:
    """The whole longest-previous-factor array of a byte string: the most bytes from each place that also start earlier."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    sizes, levels = rank_levels(raw, WORD << max(0, (n // WORD).bit_length()))
    order = suffix_order(levels, np.arange(n))
    for near in nearest_smaller(order):
        ok = (near >= 0) & (near < n)
        a, b = order[ok], order[near[ok]]
        done = np.zeros(len(a), np.int64)
        for size, level in [*zip(sizes[::-1], levels[::-1]), *[(1, raw)] * WORD]:
            x, y = a + done, b + done
            same = (x + size <= n) & (y + size <= n)
            same[same] = level[x[same]] == level[y[same]]
            done[same] += size
        out[a] = np.maximum(out[a], done)
    return out


def longest_previous_factor(levels: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start in suffix order: the start, and an earlier start that shares as many bytes as the last level has (or -1).

    The previous and next smaller places in suffix order hold the longest
    previous factor; its length matters here only up to the last level, at
    which equal ranks are equal strings.
    """
    order = suffix_order(levels, starts)
    last = levels[-1][order]
    source = np.full(len(order), -1, order.dtype)
    for near in nearest_smaller(order):
        at = np.flatnonzero((near >= 0) & (near < len(order)) & (source < 0))
        at = at[last[near[at]] == last[at]]
        source[at] = order[near[at]]
    return order, source


def repeated_starts(strings: list[bytes], counts: list[int], length: int, first_only: bool) -> list[np.ndarray]:
    """Which of the first ``counts[k]`` starts of each string are repeated; strings come in corpus order.

    Later copies are the starts whose longest previous factor is long enough;
    unless ``first_only``, the earlier places of those factors count too, and
    the first copy is among them: it is the only smaller place that the second
    one can have.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    heads = np.cumsum([0, *map(len, strings)])[:-1]
    starts = np.concatenate([np.arange(h, h + c, dtype=np.int32 if len(data) < 1 << 30 else np.int64) for h, c in zip(heads, counts)])
    _, levels = rank_levels(data, length, every=False)
    flags = np.zeros(len(data), bool)
    order, source = longest_previous_factor(levels, starts)
    later = source >= 0
    flags[order[later]] = True
    if not first_only:
        flags[source[later]] = True
    return [np.flatnonzero(flags[h : h + c]) for h, c in zip(heads, counts)]


# --- stretches ------------------------------------------------------------

def stretches(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, first start, past-last start (in the document), minimizer hash, and buffer place of each stretch."""
    buf, starts, ends = kernels.joined(texts)
    width = length - gram + 1
    if len(buf) < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    h, have = kernels.BYTE_CODES[buf], 1
    for bit in bin(gram)[3:]:
        h = h[: len(h) - have] * kernels.SHINGLE_CODES[have % 61] + h[have:]
        have *= 2
        if bit == "1":
            h = h[:-1] * kernels.SHINGLE_CODES[7] + kernels.BYTE_CODES[buf[have : have + len(h) - 1]]
            have += 1
    h = kernels.mixed(h)
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    place = (kernels.window_minima(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    long = ends - starts >= length
    s, e = starts[long], ends[long] - length + 1
    cuts = np.unique(np.concatenate((np.flatnonzero(place[1:] != place[:-1]) + 1, s, e)))
    doc = np.searchsorted(s, cuts, "right") - 1
    inside = (doc >= 0) & (cuts < e[doc]) if len(s) else np.zeros(len(cuts), bool)
    lo = cuts[inside]
    hi = cuts[np.flatnonzero(inside) + 1]
    which = np.flatnonzero(long)[doc[inside]]
    return which, lo - starts[which], hi - starts[which], h[place[lo]].view(np.int64), lo


def bounded_stretches(texts: list[bytes], length: int, gram: int, most: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same without the buffer place, a long text in overlapping pieces.

    A start's minimizer depends on its own ``length`` bytes alone, so a piece
    that holds them gives the same one; a stretch may be cut where pieces meet.
    """
    if sum(map(len, texts)) <= 2 * most:
        return stretches(texts, length, gram)[:4]
    parts = []
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), most):
            _, lo, hi, minimizer, _ = stretches([t[at : at + most + length - 1]], length, gram)
            parts.append((np.full(len(lo), k), lo + at, hi + at, minimizer))
    return tuple(np.concatenate(x) for x in zip(*parts))


def find_stretches(docs: DataFrame, length: int, gram: int, first_only: bool) -> DataFrame:
    """Stretches of all documents, each kind once a document; those whose fate is known have no digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            texts, ids = texts_as_bytes(b), b.column(0).to_pylist()
            which, lo, hi, minimizer = bounded_stretches(texts, length, gram)
            seen: dict[tuple[int, bytes], int] = {}
            rows: list[tuple] = []
            known: list[tuple] = []
            digest = xxhash.xxh3_128_digest
            for d, x, y, m in zip(which.tolist(), lo.tolist(), hi.tolist(), minimizer.tolist()):
                key = (d, digest(texts[d][x : y + length - 1]))
                if key in seen:
                    known.append((d, x, y - x))
                    if seen[key] >= 0 and not first_only:
                        k = seen[key]
                        known.append((d, rows[k][1], rows[k][2]))
                        seen[key] = -1
                else:
                    seen[key] = len(rows)
                    rows.append((d, x, y - x, m, key[1]))
            rows += [(*k, None, None) for k in known]
            if rows:
                tags = [zlib.crc32(t) & 0x7FFFFFFF for t in texts]
                d, x, n, m, g = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in d], pa.int64()), pa.array([tags[k] for k in d], pa.int32()), pa.array(x, pa.int32()), pa.array(n, pa.int32()), pa.array(m, pa.int64()), pa.array(g, pa.binary())],
                    names=["doc_id", "tag", "lo", "n", "minimizer", "digest"],
                )

    return docs.transform(map_arrow, run, STRETCH)


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (stretches grouped by document) with each stretch's bytes."""
    kind = "doc_id bigint, tag int, lo int, n int, minimizer bigint, body binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            out = []
            for doc, text, tag, *lists in zip(b.column(0).to_pylist(), texts_as_bytes(b), *[b.column(k).to_pylist() for k in range(2, 6)]):
                if zlib.crc32(text) & 0x7FFFFFFF == tag:
                    out += [(doc, tag, lo, n, m, text[lo : lo + n + length - 1]) for lo, n, m in zip(*lists)]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["doc_id", "tag", "lo", "n", "minimizer", "body"])

    per_doc = stored(wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "n", "minimizer")).alias("s")).select("doc_id", "tag", "s.lo", "s.n", "s.minimizer"), "wanted")
    met = docs.alias("d").join(per_doc.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("d.doc_id", "d.text", "w.tag", "w.lo", "w.n", "w.minimizer")
    return met.transform(map_arrow, run, kind)


def ranges(docs: DataFrame, length: int = 400, keep: str = "first", gram: int | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Repeated starts as ``doc_id, tag, lo array, n array``: runs of ``n`` starts from ``lo``; ``tag`` tells texts of one id apart."""
    if keep not in ("first", "none"):
        raise ValueError(keep)
    gram, first_only = min(gram or GRAM, max(length // 3, 1)), keep == "first"
    docs = slim(docs)
    all_ = stored(find_stretches(docs, length, gram, first_only), "stretches")
    rows = all_.filter("digest is not null")
    at = F.struct(F.col("doc_id").alias("d"), F.col("tag").alias("t"), F.col("lo").alias("l"), F.col("n").alias("n"))
    kinds = rows.groupBy("minimizer", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(at).alias("first"))
    # the digest of a stretch without copies is never asked for again
    kinds = stored(kinds.withColumn("digest", F.when(F.col("copies") > 1, F.col("digest"))), "kinds")
    per = kinds.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n_kinds"), F.sum(F.col("first.n") + F.lit(length - 1)).alias("bytes")).filter("n_kinds > 1")
    several = stored(kinds.join(per, "minimizer").select("minimizer", "bytes", F.col("first.d").alias("doc_id"), F.col("first.t").alias("tag"), F.col("first.l").alias("lo"), F.col("first.n").alias("n")), "several")
    # whole copies: every member, or every member but the first
    again = kinds.filter("copies > 1").select("minimizer", "digest", "first")
    members = rows.join(again, ["minimizer", "digest"])
    if first_only:
        members = members.filter(~(F.col("doc_id").eqNullSafe(F.col("first.d")) & (F.col("tag") == F.col("first.t")) & (F.col("lo") == F.col("first.l"))))
    found = members.select("doc_id", "tag", "lo", "n").unionByName(all_.filter("digest is null").select("doc_id", "tag", "lo", "n"))
    found = found.unionByName(_by_arrays(_fetch(docs, several.filter(F.col("bytes") <= group_bytes), length), length, first_only))
    hot = several.filter(F.col("bytes") > group_bytes)
    if not hot.isEmpty():
        found = found.unionByName(_by_digests(_fetch(docs, hot, length), length, first_only))
    return found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "n")).alias("s")).select("doc_id", "tag", "s.lo", "s.n")


def _by_arrays(bodies: DataFrame, length: int, first_only: bool) -> DataFrame:
    """Repeated starts within each minimizer, by suffix arrays over blocks of whole minimizers."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        flags = repeated_starts([r[5] for r in held], [r[3] for r in held], length, first_only)
        out = []
        for r, f in zip(held, flags):
            if len(f):
                cut = np.flatnonzero(np.diff(f) > 1) + 1
                out += [(r[0], r[1], r[2] + int(p[0]), len(p)) for p in np.split(f, cut)]
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "tag", "lo", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[4] != last and size >= ARRAY_BYTES:
                    yield solve(held)
                    held, size = [], 0
                last = row[4]
                if held and held[-1][:5] == row[:5]:
                    continue  # a row that repeats in id and text stands at the same place
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)

    dealt = bodies.repartition("minimizer").sortWithinPartitions("minimizer", "doc_id", "tag", "lo")
    return dealt.transform(map_arrow, run, "doc_id bigint, tag int, lo int, n int")


def _by_digests(bodies: DataFrame, length: int, first_only: bool) -> DataFrame:
    """The same for minimizers too large to gather: digests of their strings, counted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for doc, tag, lo, n, _, body in zip(*[c.to_pylist() for c in b.columns]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.int64()), pa.array([tag] * n, pa.int32()), pa.array(range(lo, lo + n), pa.int32()), pa.array([digest(body[k : k + length]) for k in range(n)], pa.binary())],
                    names=["doc_id", "tag", "lo", "own"],
                )

    each = stored(bodies.transform(map_arrow, run, "doc_id bigint, tag int, lo int, own binary"), "hot-strings")
    at = F.struct(F.col("doc_id").alias("d"), F.col("tag").alias("t"), F.col("lo").alias("l"))
    again = each.groupBy("own").agg(F.count(F.lit(1)).alias("copies"), F.min(at).alias("first")).filter("copies > 1")
    met = each.join(again, "own")
    if first_only:
        met = met.filter(~(F.col("doc_id").eqNullSafe(F.col("first.d")) & (F.col("tag") == F.col("first.t")) & (F.col("lo") == F.col("first.l"))))
    return met.select("doc_id", "tag", "lo", F.lit(1).alias("n"))


# --- use ------------------------------------------------------------------

def merged(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the repeated strings."""
    out: list[list[int]] = []
    for lo, n in sorted(starts):
        end = lo + n - 1 + length
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return [tuple(x) for x in out]


def _with_ranges(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``docs`` with one more, last column: the ranges of each row's id."""
    found = stored(found, "ranges")
    mine, doc = free_name(docs, "_found"), free_name(docs, "_doc")
    per = found.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("tag", "lo", "n")).alias(mine))
    return docs.join(per, docs[key].eqNullSafe(F.col(doc)), "left").drop(doc)


def _own(text: bytes, found: list[dict] | None, length: int) -> list[tuple[int, int]]:
    if not found:
        return []
    tag = zlib.crc32(text) & 0x7FFFFFFF
    return merged([s for f in found if f["tag"] == tag for s in zip(f["lo"], f["n"])], length)


def digest_repeats(docs: DataFrame, length: int = 400, keep: str = "none") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            out = []
            for doc, text, found in zip(b.column(0).to_pylist(), texts_as_bytes(b), b.column(2).to_pylist()):
                cut, at, sha = _own(text, found, length), 0, hashlib.sha256()
                for x, y in cut:
                    sha.update(text[at:x])
                    at = y
                sha.update(text[at:])
                out.append((doc, len(text), sum(y - x for x, y in cut), len(cut), sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(),) * 4 + (pa.string(),))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = slim(docs)
    met = _with_ranges(docs, ranges(docs, length, keep), "doc_id")
    return met.transform(map_arrow, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def cut_repeats(docs: DataFrame, length: int = 400, keep: str = "first", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, same columns, with repeated bytes cut from the text.

    A cut takes only whole characters: its ends move inwards to the next
    character start.
    """
    at, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text):
            raw, found = texts_as_bytes(b, text), b.column(b.num_columns - 1).to_pylist()
            values = b.column(at).to_pylist()
            for k, (t, f) in enumerate(zip(raw, found)):
                if not (cut := _own(t, f, length)):
                    continue
                parts, done = [], 0
                for x, y in cut:
                    while x < len(t) and t[x] & 0xC0 == 0x80:
                        x += 1
                    while y < len(t) and t[y] & 0xC0 == 0x80:
                        y -= 1
                    parts.append(t[done:x])
                    done = y
                values[k] = b"".join([*parts, t[done:]]).decode()
            cols = [pa.array(values, pa.string()) if k == at else b.column(k) for k in range(len(schema))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return _with_ranges(docs, ranges(slim(docs, text, key), length, keep), key).transform(map_arrow, run, schema)
