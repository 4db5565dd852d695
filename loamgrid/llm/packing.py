"""Bounded-space online packing of token sequences.

Each partition is read once and keeps at most ``open_windows`` windows of
``length`` tokens.  Whole windows' worth of a document goes straight out; the
rest goes to the open window that it fits best.  When none has room, the
fullest is topped up with a cut of the rest and emitted without padding, and
the remainder is placed again.  A partition hands over what its open windows
hold at its end.  These leftovers, at most ``open_windows`` windows a
partition, are packed again in groups of ``fan_in`` partitions, again and
again, until one group is left; its last tokens are cut to powers of two, so
that they need no padding either.

Memory is one batch of rows and the open windows.  The pieces are written to
shared storage before leftovers are read, so that a lost executor can't give
the same document two cuts.

Defined cases: a null or empty text is just its end token; rows with repeated
or null ids are packed like any other; an empty table gives an empty result;
only the key and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slim, stored
from .tokens import encoded

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
#: Sequence ids: the round and the task in the high bits, a count in the low.
TASK_BITS, ROUND_BITS = 33, 58
#: A last rest below this many tokens is one padded sequence.
LEAST_POWER = 64


class Packer:
    """Open windows of one partition; ``out`` gets emitted pieces, by column."""

    def __init__(self, length: int, open_windows: int, first_id: int, keep_ids: bool):
        self.length, self.most, self.next_id, self.keep_ids = length, open_windows, first_id, keep_ids
        self.open: list[tuple[int, list[tuple]]] = []
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at, ids if self.keep_ids else None))
            at += n
        self.next_id += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        full = self.length * 4
        while len(ids) >= full:
            self.emit([(doc, start, ids[:full], total)])
            start, ids = start + self.length, ids[full:]
        while ids:
            n = len(ids) // 4
            fits = [k for k, (used, _) in enumerate(self.open) if used + n <= self.length]
            if fits:
                k = max(fits, key=lambda j: self.open[j][0])
                used, pieces = self.open[k]
                pieces.append((doc, start, ids, total))
                if used + n == self.length:
                    self.emit(pieces)
                    del self.open[k]
                else:
                    self.open[k] = (used + n, pieces)
                return
            if len(self.open) < self.most:
                self.open.append((n, [(doc, start, ids, total)]))
                return
            k = max(range(len(self.open)), key=lambda j: self.open[j][0])
            used, pieces = self.open.pop(k)
            room = self.length - used
            self.emit([*pieces, (doc, start, ids[: room * 4], total)])
            start, ids = start + room, ids[room * 4 :]

    def leftovers(self) -> list[tuple]:
        return [p for _, pieces in self.open for p in pieces]

    def finish(self) -> None:
        """Emit what is left: powers of two, the largest first."""
        rest = self.leftovers()
        left = sum(len(p[2]) // 4 for p in rest)
        self.open = []
        while left:
            size = min(1 << (left.bit_length() - 1), self.length)
            if size < LEAST_POWER:
                size = left
            taken, need = [], size * 4
            while need:
                doc, start, ids, total = rest.pop(0)
                taken.append((doc, start, ids[:need], total))
                if len(ids) > need:
                    rest.insert(0, (doc, start + need // 4, ids[need:], total))
                need -= min(need, len(ids))
            self.emit(taken)
            left -= size


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


NAMES = [p.split()[0] for p in PIECE.split(", ")]


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, open_windows: int = 8,
    fan_in: int = 64, keep_ids: bool = True,
) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` holds the piece's little-endian unsigned 32-bit ids (null where
    ``keep_ids`` is false; the checksum is taken from them all the same).  A
    sequence is its pieces by ``offset``; a reader pads it to ``length``
    unless its size is a power of two.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(length, open_windows, part << TASK_BITS, keep_ids)
        for doc, ids in encoded(batches, tokenizer, end):
            packer.add(doc, 0, ids, len(ids) // 4)
            if len(packer.out) >= 20_000:
                yield _table(packer.out, NAMES)
                packer.out = []
        yield _table(packer.out, NAMES)
        packer.keep_ids = True
        rows = [(doc, start, len(ids) // 4, None, total, -1 - part, k, ids) for k, (doc, start, ids, total) in enumerate(packer.leftovers())]
        yield _table(rows, NAMES)

    def again(last: bool, turn: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            packer = Packer(length, open_windows, (turn << ROUND_BITS) + (part << TASK_BITS), keep_ids)
            for batch in batches:
                cols = [batch.column(k).to_pylist() for k in (0, 1, 7, 4)]
                for doc, start, ids, total in zip(*cols):
                    packer.add(doc, start, ids, total)
            if last:
                packer.finish()
            rest = packer.leftovers()
            yield _table(packer.out, NAMES)
            yield _table([(doc, start, len(ids) // 4, None, total, -1 - part, k, ids) for k, (doc, start, ids, total) in enumerate(rest)], NAMES)

        return run

    done = stored(slim(docs).transform(map_arrow, first, PIECE), "packed")
    parts, turn = [done.filter("sequence_id >= 0")], 0
    rest = done.filter("sequence_id < 0")
    while True:
        turn += 1
        groups = rest.select("sequence_id").distinct().count()
        tasks = -(-groups // fan_in)
        if not groups:
            break
        # groups of whole partitions' leftovers: their count is bounded by the partitions, not the rows
        ordered = rest.repartitionByRange(tasks, "sequence_id") if tasks > 1 else rest.coalesce(1)
        done = stored(ordered.sortWithinPartitions("sequence_id", "offset").transform(map_arrow, again(tasks == 1, turn), PIECE), "packed-again")
        parts.append(done.filter("sequence_id >= 0"))
        rest = done.filter("sequence_id < 0")
        if tasks == 1:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
