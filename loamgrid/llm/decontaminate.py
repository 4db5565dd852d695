"""Benchmark decontamination over a distributed positional inverted index.

The index is dealt by documents: each shard (a bounded run of whole
documents) stores, for every test term that occurs in it, the term's
positions as a compressed posting list, and where each document starts.  Only
terms of the test set are stored; no phrase of the test set needs any other.
Another test set needs another index, unless its terms are among these.

A search reads shard after shard.  Each phrase starts from the shard's
shortest posting list among its terms, shifted by that term's offset, and the
candidates are intersected with the other terms' lists, the shorter ones
first, each shifted by its own offset; an intersection is a binary search in
the sorted lists.  All phrases go through this together, as arrays.  A
proximity search instead takes the spans in which all terms of a phrase lie
within so many words.

A test set goes to every task whole up to ``MAX_TEST_WORDS`` of 8 bytes.  A
larger one is searched in several rounds over the same stored index, which
holds the terms of all rounds; only the vocabulary, 8 bytes a distinct word,
goes to every task whole then.  What the rounds hit in a shard is merged
before words and items are counted.

Words: A-Z lower-cased, then runs of digits, letters and all characters
outside ASCII.  A phrase is each run of ``width`` words of an item; a shorter
item is one phrase.  Defined cases: null and empty texts have no words and no
hits; items without words are never hit; items of one id count once, and those
without an id mark words but aren't counted; equal rows get equal results; an
empty table, or an empty test set, gives no hits; only key and text of either
table are read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import blocks, free_name, map_arrow, slim, stored, texts_as_bytes

WIDTH = 13
#: Words of test items searched in one round; their phrases take about 120 bytes a word.
MAX_TEST_WORDS = 500_000
#: Candidates looked at together, which bounds a task's memory.
STEP = 1 << 20
#: A table of contaminated documents is broadcast only up to so many rows (about 30 bytes each).
BROADCAST_ROWS = 300_000
RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, text_crc32 bigint, spans array<struct<first: bigint, end: bigint>>"
POSTINGS = "shard binary, terms binary, lists binary, firsts binary, words bigint"


@dataclass(frozen=True)
class Phrases:
    """Test phrases as term numbers; ``terms`` is the sorted vocabulary of word hashes."""

    terms: np.ndarray
    grid: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    names: list[str]


def phrases(items: list[tuple[object, bytes]], width: int = WIDTH, terms: np.ndarray | None = None) -> Phrases:
    """Distinct phrases of the items; ``items`` rows are (phrase, item) pairs.  ``terms`` is a vocabulary of more than these items."""
    names = sorted({str(k) for k, _ in items if k is not None})
    number = {n: k for k, n in enumerate(names)}
    runs: dict[bytes, tuple[int, set[int]]] = {}
    if items:
        buf, starts, ends = kernels.joined([t for _, t in items])
        at, _, hashes = kernels.words(buf, kernels.ALNUM)
        first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
        for (k, _), a, b in zip(items, first.tolist(), last.tolist()):
            for p in range(a, max(a + 1, b - width + 1) if b > a else a):
                own = hashes[p : min(b, p + width)]
                runs.setdefault(own.tobytes(), (len(own), set()))[1].add(number.get(str(k), -1) if k is not None else -1)
    if terms is None:
        terms = np.unique(np.concatenate([np.frombuffer(r, np.uint64) for r in runs])) if runs else np.empty(0, np.uint64)
    grid = np.full((len(runs), width), -1, np.int64)
    lengths = np.empty(len(runs), np.int64)
    pairs = []
    for k, (r, (n, own)) in enumerate(runs.items()):
        grid[k, :n] = np.searchsorted(terms, np.frombuffer(r, np.uint64))
        lengths[k] = n
        pairs += [(k, i) for i in own]
    return Phrases(terms, grid, lengths, np.asarray(pairs, np.int64).reshape(-1, 2), names)


class Lookup:
    """Term numbers of word hashes through a direct table on the low bits."""

    def __init__(self, terms: np.ndarray):
        self.terms, bits = terms, max(12, int(len(terms)).bit_length() + 3)
        self.mask = np.uint64((1 << bits) - 1)
        low = (terms & self.mask).astype(np.int64)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[low] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose word is a term, and the term's number."""
        at = np.flatnonzero(self.maybe[(hashes & self.mask).astype(np.int64)])
        k = np.searchsorted(self.terms, hashes[at])
        k[k == len(self.terms)] = 0
        good = self.terms[k] == hashes[at] if len(self.terms) else np.zeros(0, bool)
        return at[good], k[good]


def build_index(docs: DataFrame, terms: np.ndarray, shard_bytes: int = 2 << 20) -> DataFrame:
    """Posting lists of the test terms, a row per shard: the ids and checksums of its documents,
    term numbers with list lengths, the lists as gaps, each document's first position, and the row's own number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(terms)
        for b in blocks(batches, limit=shard_bytes):
            texts = texts_as_bytes(b)
            cells = Shard.of(texts, find).row(b.column(0), texts)
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in cells[:4]], pa.array([cells[4]], pa.int64())], names=["shard", "terms", "lists", "firsts", "words"])

    return stored(docs.transform(map_arrow, run, POSTINGS).withColumn("place", F.monotonically_increasing_id()), "postings")


class Shard:
    """Posting lists of one shard in memory."""

    def __init__(self, firsts: np.ndarray, words: int, places: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_terms: int):
        """``places`` are ordered by term; ``terms`` are the terms that occur, ``counts`` their list lengths."""
        self.firsts, self.words, self.places = firsts, words, places
        self.start = np.zeros(n_terms + 1, np.int64)
        self.start[terms + 1] = counts
        self.start = np.cumsum(self.start)
        # which document a position is in, to keep matches inside it
        self.document = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        # all lists behind one another, as one sorted array
        self.keys = np.repeat(np.asarray(terms, np.int64), counts) * (words + 1) + places

    @classmethod
    def of(cls, texts: list[bytes], find: Lookup) -> Shard:
        """The shard of some texts."""
        buf, starts, ends = kernels.joined(texts)
        at, _, hashes = kernels.words(buf, kernels.ALNUM)
        place, term = find(hashes)
        terms, counts = np.unique(term, return_counts=True)
        return cls(np.append(np.searchsorted(at, starts), len(at)), len(at), place[np.argsort(term, kind="stable")], terms, counts, len(find.terms))

    def row(self, ids: pa.Array, texts: list[bytes]) -> list[bytes | int]:
        """The stored form: lists as gaps, everything compressed."""
        press = zstandard.ZstdCompressor(level=1).compress
        counts = np.diff(self.start)
        terms = np.flatnonzero(counts)
        gaps = np.diff(self.places, prepend=0)
        heads = self.start[terms]
        gaps[heads] = self.places[heads]
        key = np.stack((np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()).astype(np.int64), np.fromiter(map(zlib.crc32, texts), np.int64, len(texts))))
        return [press(key.tobytes()), press(np.stack((terms, counts[terms])).tobytes()), press(gaps.astype(np.int32).tobytes()), press(self.firsts.astype(np.int64).tobytes()), self.words]

    @classmethod
    def read(cls, row: tuple, n_terms: int) -> Shard:
        unzip = zstandard.ZstdDecompressor().decompress
        terms, counts = np.frombuffer(unzip(row[1]), np.int64).reshape(2, -1)
        sums = np.cumsum(np.frombuffer(unzip(row[2]), np.int32).astype(np.int64))
        heads = np.cumsum(counts) - counts
        before = np.where(heads > 0, sums[heads - 1], 0) if len(sums) else heads
        return cls(np.frombuffer(unzip(row[3]), np.int64), row[4], sums - np.repeat(before, counts), terms, counts, n_terms)

    def counts(self) -> np.ndarray:
        return np.diff(self.start)

    def holds(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each place is in its term's list."""
        want = terms * (self.words + 1) + places
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return self.keys[at] == want if len(self.keys) else np.zeros(len(want), bool)

    def term_at(self, lo: int, hi: int) -> np.ndarray:
        """Term numbers of the words from ``lo`` to before ``hi``, -1 for words that aren't terms."""
        if not hasattr(self, "dense"):
            self.dense = np.full(self.words, -1, np.int64)
            self.dense[self.keys % (self.words + 1)] = self.keys // (self.words + 1)
        return self.dense[lo:hi]


def exact_matches(shard: Shard, p: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, start position) of every occurrence, in bounded steps."""
    if not len(p.grid):
        return
    filled = p.grid >= 0
    have = np.where(filled, shard.counts()[np.where(filled, p.grid, 0)], np.iinfo(np.int64).max)
    turns = np.argsort(have, axis=1, kind="stable")
    rare = turns[:, 0]
    size = have[np.arange(len(rare)), rare]
    term = p.grid[np.arange(len(rare)), rare]
    rows = np.flatnonzero(size > 0)
    total = np.cumsum(size[rows])
    at = 0
    while at < len(rows):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + STEP, "right")))
        own = rows[at:end]
        n = size[own]
        which = np.repeat(own, n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = shard.places[np.repeat(shard.start[term[own]], n) + step] - np.repeat(rare[own], n)
        good = (place >= 0) & (place + p.lengths[which] <= shard.words)
        which, place = which[good], place[good]
        for turn in range(1, p.grid.shape[1]):
            k = turns[which, turn]
            want = p.grid[which, k]
            good = (want < 0) | shard.holds(want, place + k)
            which, place = which[good], place[good]
            if not len(which):
                break
        if len(which):
            same = shard.document[place] == shard.document[place + p.lengths[which] - 1]
            yield which[same], place[same]
        at = end


def near_matches(shard: Shard, p: Phrases, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(phrase, first word, last word) of least spans that hold all words of a phrase, in any order,
    within ``slack`` words more than the phrase has.

    From each position of the rarest term, a window on either side is tested for the full count of words.
    """
    for k in range(len(p.grid)):
        need = p.grid[k, : p.lengths[k]]
        counts = shard.counts()[need]
        if not counts.min():
            continue
        rarest = need[counts.argmin()]
        reach = int(p.lengths[k]) + slack
        kinds, least = np.unique(need, return_counts=True)
        found = set()
        for x in shard.places[shard.start[rarest] : shard.start[rarest + 1]].tolist():
            d = shard.document[x]
            lo, hi = max(shard.firsts[d], x - reach + 1), min(shard.firsts[d + 1], x + reach)
            part = shard.term_at(lo, hi)
            places = np.flatnonzero(np.isin(part, kinds))
            for a in places.tolist():
                inside = places[(places >= a) & (places < a + reach)]
                have = np.cumsum(part[inside][:, None] == kinds[None, :], axis=0)
                full = np.flatnonzero((have >= least).all(axis=1))
                if len(full):
                    found.add((int(lo + a), int(lo + inside[full[0]])))
        if found:
            both = np.asarray(sorted(found))
            yield np.full(len(both), k), both[:, 0], both[:, 1]


def owned(p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Items ordered by phrase, and where each phrase's items start."""
    by = np.argsort(p.items[:, 0], kind="stable")
    return p.items[by, 1], np.searchsorted(p.items[by, 0], np.arange(len(p.grid) + 1))


def hits(shard: Shard, p: Phrases, items: np.ndarray, heads: np.ndarray, slack: int | None) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words of a shard are hit, and the items of each document that has any."""
    change = np.zeros(shard.words + 1, np.int64)
    owners: dict[int, set[str]] = {}
    found = near_matches(shard, p, slack) if slack is not None else ((w, x, x + p.lengths[w] - 1) for w, x in exact_matches(shard, p))
    for which, lo, hi in found:
        np.add.at(change, lo, 1)
        np.add.at(change, hi + 1, -1)
        for w, d in np.unique(np.stack((which, shard.document[lo])), axis=1).T.tolist():
            owners.setdefault(d, set()).update(p.names[i] for i in items[heads[w] : heads[w + 1]].tolist() if i >= 0)
    return np.cumsum(change)[:-1] > 0, owners


def results(shard: bytes, firsts: np.ndarray, hit: np.ndarray, owners: dict[int, set[str]]) -> pa.RecordBatch:
    """The rows of a shard's documents; ``shard`` is its cell of ids."""
    ids, null, crc = np.frombuffer(zstandard.ZstdDecompressor().decompress(shard), np.int64).reshape(3, -1)
    sums = np.concatenate(([0], np.cumsum(hit)))
    n_hit = sums[firsts[1:]] - sums[firsts[:-1]]
    spans: list[list[dict]] = [[] for _ in ids]
    for d in np.flatnonzero(n_hit).tolist():
        own = hit[firsts[d] : firsts[d + 1]].astype(np.int8)
        edge = np.flatnonzero(np.diff(own, prepend=0, append=0)).tolist()
        spans[d] = [{"first": x, "end": y} for x, y in zip(edge[::2], edge[1::2])]
    items = [sorted(owners.get(d, ())) for d in range(len(ids))]
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64(), mask=null > 0), pa.array(np.diff(firsts), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(digest), pa.array(crc, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "text_crc32", "spans"],
    )


def search(index: DataFrame, p: Phrases, slack: int | None = None) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, text_crc32, spans``.

    ``spans`` lists the hit runs as word positions (first, end).  ``slack``
    None asks for exact phrases, a number for proximity matches.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, heads = owned(p)
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                shard = Shard.read(row, len(p.terms))
                yield results(row[0], shard.firsts, *hits(shard, p, items, heads, slack))

    return index.transform(map_arrow, run, RESULT)


def search_rounds(index: DataFrame, rounds: Iterable[Phrases], slack: int | None = None) -> DataFrame:
    """The same for test phrases in parts, all numbered by the index's terms.

    Each round stores what it hits, a row per shard with hits; these rows meet
    by the shard's number and are merged.
    """

    def one(p: Phrases) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, heads = owned(p)
            press = zstandard.ZstdCompressor(level=1).compress
            for b in batches:
                for row in zip(*[c.to_pylist() for c in b.columns]):
                    hit, owners = hits(Shard.read(row, len(p.terms)), p, items, heads, slack)
                    if hit.any():
                        names = json.dumps([[d, sorted(x)] for d, x in owners.items()]).encode()
                        yield pa.RecordBatch.from_arrays([pa.array([row[5]], pa.int64()), pa.array([press(np.packbits(hit).tobytes())], pa.binary()), pa.array([press(names)], pa.binary())], names=["place", "hit", "owners"])

        return stored(index.transform(map_arrow, run, "place bigint, hit binary, owners binary"), "hits")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for shard, firsts, words, parts in zip(*[c.to_pylist() for c in b.columns]):
                hit = np.zeros(words, bool)
                owners: dict[int, set[str]] = {}
                for part in parts or ():
                    hit |= np.unpackbits(np.frombuffer(unzip(part["hit"]), np.uint8), count=words).astype(bool)
                    for d, names in json.loads(unzip(part["owners"])):
                        owners.setdefault(d, set()).update(names)
                yield results(shard, np.frombuffer(unzip(firsts), np.int64), hit, owners)

    parts = [one(p) for p in rounds]
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    found = found.groupBy("place").agg(F.collect_list(F.struct("hit", "owners")).alias("parts"))
    return index.select("place", "shard", "firsts", "words").join(found, "place", "left").select("shard", "firsts", "words", "parts").transform(map_arrow, merge, RESULT)


def test_items(benchmark: DataFrame) -> tuple[DataFrame, bool]:
    """Id and text of the test items, and whether one round takes them all."""
    rows = slim(benchmark, key=benchmark.columns[[c.lower() for c in benchmark.columns].index("item_id")])
    return rows, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= MAX_TEST_WORDS * 8


def vocabulary(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of all words of the test items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            _, _, hashes = kernels.words(kernels.joined(texts_as_bytes(b))[0], kernels.ALNUM)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes).view(np.int64))], names=["term"])

    return np.sort(np.asarray(rows.transform(map_arrow, run, "term bigint").distinct().toArrow().column(0)).view(np.uint64))


def test_rounds(rows: DataFrame, width: int, terms: np.ndarray) -> Iterator[Phrases]:
    """Phrases of so many items at a time as one round takes; one item at least."""
    held: list[tuple[object, bytes]] = []
    size = 0
    for r in rows.toLocalIterator():
        text = (r["text"] or "").encode()
        if held and size + len(text) > MAX_TEST_WORDS * 8:
            yield phrases(held, width, terms)
            held, size = [], 0
        held.append((r["doc_id"], text))
        size += len(text)
    yield phrases(held, width, terms)


def found_in(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """Hits of the test items in ``docs`` (``doc_id, text``), in as many rounds as they need."""
    rows, single = test_items(benchmark)
    if single:
        p = phrases([(r["doc_id"], (r["text"] or "").encode()) for r in rows.collect()], width)
        return search(build_index(docs, p.terms), p)
    terms = vocabulary(rows)
    return search_rounds(build_index(docs, terms), test_rounds(rows, width, terms))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = 5) -> DataFrame:
    """Hits of every document; ``contaminated`` if at least ``percent`` of its words are hit."""
    found = found_in(slim(docs), benchmark, width)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = 5) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept.

    The index is stored and searched as in :func:`contamination`; what leaves
    the rows is a join with the contaminated ones by id and checksum of the text.
    """
    doc, crc = free_name(docs, "_doc"), free_name(docs, "_crc")
    bad = contamination(slim(docs, text, key), benchmark, width, percent).filter("contaminated")
    bad = stored(bad.select(F.col("doc_id").alias(doc), F.col("text_crc32").alias(crc)).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    met = docs[key].cast("long").eqNullSafe(F.col(doc)) & (F.crc32(F.coalesce(docs[text].cast("string"), F.lit(""))) == F.col(crc))
    return docs.join(bad, met, "left_anti")
