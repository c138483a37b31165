"""Tokenising inside tasks: whole texts through the tokenizers library, with a bounded word memo.

Byte-level BPE and word-end BPE never merge across a space, so a text's ids are the ids of its
space-separated chunks in order. Each worker encodes a chunk once and afterwards gathers its ids
with numpy. Texts for which that split could differ (runs of white space around a space, strings of
added tokens) go through the library whole.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept in a worker; when full, the memo starts anew.
MEMO_CHUNKS = 250_000
#: Characters encoded at a time.
SLICE_CHARS = 16_000_000

_SPACE = r"[\t-\r\x1c-\x1f \x{85}\pZ]"
_UNSAFE = rf"{_SPACE} (?:{_SPACE}|$)"
#: A chunk that ends in ASCII punctuation after a Latin letter or digit: merges don't cross that place either.
_TAILED = r"(?s)^(?P<body>.*[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])(?P<tail>[!-/:-@\[-`{-~]+)$"
#: Letters of which a run is one piece for every pre-tokenizer here.
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch
#: The character by which byte-level BPE writes each byte: itself if it prints, else one from U+0100 on.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTS} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, keep_space: bool = True) -> "Encoder":
    """The worker's encoder of a tokenizer file."""
    if (path, keep_space) not in _ENCODERS:
        _ENCODERS[path, keep_space] = Encoder(path, keep_space)
    return _ENCODERS[path, keep_space]


def text_slices(batches, columns: list[str], text: str = "text", size: int = SLICE_CHARS, rows: int = 10_000):
    """Slices of the batches with about ``size`` bytes of text and ``rows`` rows at most each; null texts become empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            base = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, base + size, "right"))))
            yield [batch.column(batch.schema.get_field_index(c)).slice(at, to - at) for c in columns], texts.slice(at, to - at)
            at = to


class Encoder:
    """Ids of texts for one tokenizer file.

    keep_space: whether a chunk owns the space before it (byte-level BPE); otherwise the tokenizer
    drops white space.
    """

    def __init__(self, path: str, keep_space: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep_space = keep_space
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {"": 0}
        self.pool = np.zeros(1 << 18, np.uint32)
        self.cuts = np.zeros(2, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Encode unseen chunks: plain Latin words by the library's merge model, all others through its whole chain."""
        words, others, ids, sizes = [], [], [], []
        for c in chunks:
            (words if _WORD(c, len(c) > 1 and c[0] == " ") else others).append(c)
        merge = self.tokenizer.model.tokenize
        for c in words:
            raw = c if self.keep_space else c.lower()
            found = merge(raw.replace(" ", "\u0120") if raw.isascii() else raw.encode().decode("latin-1").translate(_BYTE_CHARS))
            ids += [t.id for t in found]
            sizes.append(len(found))
        for i in range(0, len(others), 1000):
            for e in self.tokenizer.encode_batch(others[i : i + 1000], add_special_tokens=False):
                ids += e.ids
                sizes.append(len(e))
        new = np.asarray(ids, np.uint32)
        filled, at = int(self.cuts[-1]), len(self.slots)
        while filled + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[filled : filled + len(new)] = new
        self.cuts = np.concatenate([self.cuts, filled + np.cumsum(sizes)])
        self.slots.update(zip(words + others, range(at, at + len(chunks))))

    def _chunk_slots(self, chunks: list[str]) -> np.ndarray:
        found = list(map(self.slots.get, chunks))
        if None in found:
            self._learn(list(dict.fromkeys(c for c, s in zip(chunks, found) if s is None)))
            found = list(map(self.slots.get, chunks))
        return np.asarray(found, np.int64)

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the slots in order, where each slot's ids start and the end)."""
        return _spans(self.pool, self.cuts[slots], self.cuts[slots + 1] - self.cuts[slots])

    def _chunks_of(self, texts: pa.LargeStringArray):
        """(kind of each chunk, where each text's chunks start and the end, slots of each kind's two halves)."""
        if len(self.slots) > MEMO_CHUNKS:
            self._reset()
        lists = pc.split_pattern(texts, " ")
        flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = flat.dictionary_encode()
        kinds, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if self.keep_space:  # a text's first chunk has no space before it
            firsts = flat.take(pa.array(ends[:-1]))
            kinds[ends[:-1]] = len(words) + np.arange(len(firsts))
        halves = pc.extract_regex(words, _TAILED)
        body = pc.if_else(halves.is_valid(), pc.struct_field(halves, "body"), words).dictionary_encode()
        tail = pc.fill_null(pc.struct_field(halves, "tail"), "").dictionary_encode()
        bodies = body.dictionary.to_pylist()
        if self.keep_space:
            bodies = [" " + w for w in bodies]
        pairs = np.stack([self._chunk_slots(bodies)[body.indices.to_numpy()], self._chunk_slots(tail.dictionary.to_pylist())[tail.indices.to_numpy()]], 1) if len(words) else np.zeros((0, 2), np.int64)
        if self.keep_space:
            pairs = np.concatenate([pairs, np.stack([self._chunk_slots(firsts.to_pylist()), np.zeros(len(firsts), np.int64)], 1)])
        return kinds, ends, pairs

    def _unsafe(self, texts: pa.LargeStringArray) -> np.ndarray:
        bad = np.zeros(len(texts), bool)
        if self.keep_space:
            bad |= pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        for token in self.added:
            bad |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return bad

    def _slots_of(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each chunk, first chunk of each text and the end)."""
        if len(self.slots) > MEMO_CHUNKS:
            self._reset()
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        slots = self._chunk_slots([" " + w for w in words] if self.keep_space else words)[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
        if self.keep_space and len(texts):
            firsts = lists.flatten().take(pa.array(ends[:-1])).to_pylist()
            slots[ends[:-1]] = self._chunk_slots(firsts)
        return slots, ends

    def count(self, texts: pa.LargeStringArray) -> np.ndarray:
        """Number of ids of each text."""
        bad = self._unsafe(texts)
        out = np.zeros(len(texts), np.int64)
        good = texts.filter(pa.array(~bad))
        if len(good):
            kinds, ends, pairs = self._chunks_of(good)
            total = np.concatenate([[0], np.cumsum((self.cuts[pairs + 1] - self.cuts[pairs]).sum(1)[kinds])])
            out[~bad] = total[ends[1:]] - total[ends[:-1]]
        if bad.any():
            out[bad] = [len(x) for x in self.whole(texts.filter(pa.array(bad)).to_pylist())]
        return out

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's ids start and the end)."""
        bad = self._unsafe(texts)
        good = texts.filter(pa.array(~bad))
        ids, ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(good):
            kinds, cuts, pairs = self._chunks_of(good)
            pool, at = self._gather(pairs.ravel())
            starts = at[:-1:2]
            ids, total = _spans(pool, starts[kinds], (at[2::2] - starts)[kinds])
            ends = total[cuts]
        if not bad.any():
            return ids, ends
        parts: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        for i, (a, b) in zip(np.flatnonzero(~bad), zip(ends[:-1], ends[1:])):
            parts[i] = ids[a:b]
        for i, x in zip(np.flatnonzero(bad), self.whole(texts.filter(pa.array(bad)).to_pylist())):
            parts[i] = x
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _spans(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the spans of the pool one after another, where each starts and the end)."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat((starts - total[:-1]).astype(np.int32), sizes)
    at += np.arange(total[-1], dtype=np.int32)
    return pool[at], total
