"""Packing documents into sequences: minimum bin slack by a bitset subset-sum program.

Each task packs its own documents, so nothing is shuffled. Pieces of a full window come off long
documents first; the remainders wait in a pool. A window is filled by its longest remainder and the
multiset of other waiting lengths that comes closest to what is left, found with integers as
bitsets (bit s: sum s can be reached) and read off backwards as counts for each length. Slack that
no multiset fills is closed by cutting one waiting document; the last tokens of a task go into
sequences of powers of two, which need no padding.

Cases: null text counts as empty (its end id remains); every row is a document, repeated or not;
null ids are kept; other columns are ignored; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import store, tokens

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Remainders that wait, at most and after packing: enough lengths to fill windows without slack.
POOL, LOW = 4096, 1024


def best_fill(counts: dict[int, int], present: int, room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest possible up to ``room``.

    counts: available number of each length; present: bit l is set if length l is available.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    lengths = present & mask & ~1
    while lengths and not reach >> room & 1:
        length = lengths.bit_length() - 1
        lengths ^= 1 << length
        left, part = min(counts[length], room // length), 1
        while left and not reach >> room & 1:  # multiples as sums of 1, 2, 4, ... copies
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << take * length & mask
            left, part = left - take, part * 2
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += take
            total -= take * length
    return taken


class SlackPacker:
    """Assigns pieces (document, start, length) to sequences of ``capacity``; emits (piece, sequence, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence, self.waiting, self.tokens = capacity, 0, 0, 0
        self.pool: dict[int, deque] = defaultdict(deque)
        self.counts: dict[int, int] = defaultdict(int)
        self.present, self.out = 0, []

    def add(self, doc, tokens_: int) -> None:
        start = 0
        while tokens_ - start >= self.capacity:
            self._emit([(doc, start, self.capacity)])
            start += self.capacity
        if start < tokens_:
            self._wait((doc, start, tokens_ - start))
        if self.waiting > POOL:
            # Many short pieces may not fill a sequence: they wait for more.
            while self.waiting > LOW and self.tokens >= self.capacity:
                self._fill()

    def close(self) -> None:
        while self.tokens >= self.capacity:
            self._fill()
        rest = [p for n in sorted(self.pool, reverse=True) for p in self.pool[n]]
        left = sum(p[2] for p in rest)
        while left:
            size = 1 << left.bit_length() - 1
            taken, left = [], left - size
            while size:
                doc, start, length = rest[0]
                part = min(size, length)
                taken.append((doc, start, part))
                size -= part
                if part == length:
                    rest.pop(0)
                else:
                    rest[0] = (doc, start + part, length - part)
            self._emit(taken)
        self.pool.clear(), self.counts.clear()
        self.present = self.waiting = self.tokens = 0

    def _wait(self, piece) -> None:
        n = piece[2]
        self.pool[n].append(piece)
        self.counts[n] += 1
        self.present |= 1 << n
        self.waiting += 1
        self.tokens += n

    def _take(self, n: int):
        piece = self.pool[n].popleft()
        self.counts[n] -= 1
        self.waiting -= 1
        self.tokens -= n
        if not self.counts[n]:
            self.present &= ~(1 << n)
            del self.pool[n], self.counts[n]
        return piece

    def _fill(self) -> None:
        taken = [self._take(self.present.bit_length() - 1)]
        room = self.capacity - taken[0][2]
        for n, times in best_fill(self.counts, self.present, room).items():
            taken += [self._take(n) for _ in range(times)]
            room -= n * times
        if room and self.waiting:  # every waiting length is larger than this slack, or it would have been taken
            doc, start, length = self._take(self.present.bit_length() - 1)
            taken.append((doc, start, room))
            self._wait((doc, start + room, length - room))
        self._emit(taken)

    def _emit(self, pieces) -> None:
        offset = 0
        for p in pieces:
            self.out.append((p, self.sequence, offset))
            offset += p[2]
        self.sequence += 1


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of every document, with the checksum of its ids. sequence_id is task * 2**33 + its number there."""

    def run(batches):
        encode, packer, ids_of, number = tokens.encoder(tokenizer), SlackPacker(capacity), {}, 0
        first = TaskContext.get().partitionId() << 33

        def flush():
            rows = []
            for (doc, start, length), sequence, offset in packer.out:
                key_, ids, _ = entry = ids_of[doc]
                rows.append((key_, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), first + sequence, offset))
                entry[2] -= length
                if not entry[2]:
                    del ids_of[doc]
            packer.out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in PIECES.split(", ")])

        for (keys,), texts in tokens.text_slices(batches, [key], text):
            flat, ends = encode.encode(texts)
            small = np.uint16 if len(flat) == 0 or flat.max() < 1 << 16 else np.uint32
            for k, a, b in zip(keys.to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                ids_of[number] = [k, np.append(flat[a:b], np.uint32(end_id)).astype(small), b - a + 1]
                packer.add(number, b - a + 1)
                number += 1
            if packer.out:
                yield flush()
        packer.close()
        if packer.out:
            yield flush()

    return store.small_batches(docs).select(key, text).mapInArrow(run, PIECES)
