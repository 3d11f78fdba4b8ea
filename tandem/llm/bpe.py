"""Byte-pair encoding over contiguous rank arrays.

A short word is a row of part ids and a row of ranks, one rank for each pair of adjacent
parts. A step scans the ranks for the leftmost minimum, deletes the boundary inside that
pair and refreshes the ranks to its left and right. Words of one length share a matrix:
after t steps every row that still merges has exactly t boundaries less, so the arrays
stay contiguous and no step pads. Long words go through a heap over linked parts, for
which the repeated scan would be quadratic.
"""

from __future__ import annotations

import heapq
import json
import os

import numpy as np

NONE = np.int32(2**31 - 1)
#: Words above this many bytes are merged by heap; others together with words of up to the next of these widths.
SHORT = 64
STEPS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 65)
WIDTHS = [min(w for w in STEPS if w >= n) for n in range(SHORT + 2)]
#: Fills rows of shorter words; no id of a vocabulary.
PAD = np.int32(2**31 - 2)


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_json(name: str) -> dict:
    with open(vocabulary_path(name), encoding="utf-8") as f:
        return json.load(f)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Fixed rule: printable Latin-1 bytes stand for themselves, the others for code points
    from 256 upwards in order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: Packed ids are little-endian unsigned 32-bit integers.
IDS = np.dtype("<u4")


def packed(rows: np.ndarray) -> list[bytes]:
    raw, width = rows.astype(IDS).tobytes(), 4 * rows.shape[1]
    return [raw[i : i + width] for i in range(0, len(raw), width)] if width else [b""] * len(rows)


class PairRanks:
    """(left id, right id) -> rank, and rank -> merged id, for arrays and for single pairs."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        self.one = {}
        for rank, (left, right, _) in enumerate(pairs):
            self.one.setdefault((left << 32) | right, rank)
        self.merged = np.array([m for _, _, m in pairs] or [0], dtype=np.int32)
        bits = max(8, int(len(pairs)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys = np.fromiter(self.one, dtype=np.uint64, count=len(self.one))
        ranks = np.fromiter(self.one.values(), dtype=np.int32, count=len(self.one))
        self.keys = np.full(1 << bits, ~np.uint64(0))
        self.ranks = np.full(1 << bits, NONE, dtype=np.int32)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == ~np.uint64(0)
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            put = np.zeros(len(keys), dtype=bool)
            put[first] = True
            put &= free
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], ranks[put]
            keys, ranks, slots = keys[~put], ranks[~put], (slots[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        flat = keys.ravel()
        slots = self._slot(flat)
        found, out = self.keys[slots], self.ranks[slots]
        miss = np.flatnonzero((found != flat) & (found != ~np.uint64(0)))
        while len(miss):
            slots[miss] = (slots[miss] + 1) & self.mask
            found = self.keys[slots[miss]]
            out[miss] = self.ranks[slots[miss]]
            miss = miss[(found != flat[miss]) & (found != ~np.uint64(0))]
        out[self.keys[slots] != flat] = NONE
        return out.reshape(keys.shape)

    def merge_rows(self, ids: np.ndarray) -> list[bytes]:
        """The merged ids of each row, packed; shorter words end in PAD, which has no rank with anything."""
        out: list[bytes] = [b""] * len(ids)
        rows = np.arange(len(ids))

        def ready(which: np.ndarray, parts: np.ndarray) -> None:
            sizes = (4 * (parts != PAD).sum(axis=1)).tolist()
            for r, word, size in zip(which.tolist(), packed(parts), sizes):
                out[r] = word[:size]

        ranks = self.of(ids[:, :-1], ids[:, 1:])
        while True:
            if ids.shape[1] < 2:
                ready(rows, ids)
                return out
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), at]
            done = low == NONE
            if done.any():
                ready(rows[done], ids[done])
                go = ~done
                rows, ids, ranks, at, low = rows[go], ids[go], ranks[go], at[go], low[go]
                if not len(rows):
                    return out
            line = np.arange(len(rows))
            # the boundary inside the pair goes: what stands right of it moves one to the left
            width = ids.shape[1]
            keep = np.arange(width - 1)[None, :]
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), axis=1)
            ids[line, at] = self.merged[low]
            if width == 2:
                ranks = ranks[:, :0]
                continue
            keep = np.arange(width - 2)[None, :]
            ranks = np.take_along_axis(ranks, keep + (keep >= at[:, None]), axis=1)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.of(ids[some, at[some] - 1], ids[some, at[some]])
            some = np.flatnonzero(at < width - 2)
            ranks[some, at[some]] = self.of(ids[some, at[some]], ids[some, at[some] + 1])

    def merge_long(self, ids: list[int]) -> list[int]:
        """One word by a heap of (rank, place) over linked parts; stale entries are skipped."""
        n = len(ids)
        before, after, gone = [*range(-1, n - 1)], [*range(1, n + 1)], bytearray(n)
        heap = []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (rank := self.one.get((ids[i] << 32) | ids[after[i]])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            push(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if gone[i] or ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], gone[j], after[i] = int(self.merged[rank]), 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [x for x, dead in zip(ids, gone) if not dead]

    def merge(self, words: list[bytes], byte_ids: np.ndarray, last_ids: np.ndarray | None = None) -> list[bytes]:
        """Merged ids of many words, packed. byte_ids: the part id of each byte; last_ids: of a word's last byte, where it differs."""
        out: list = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_width.setdefault(WIDTHS[min(len(word), SHORT + 1)], []).append(k)
        for width, which in by_width.items():
            if width > SHORT:
                for k in which:
                    row = byte_ids[np.frombuffer(words[k], dtype=np.uint8)]
                    if last_ids is not None:
                        row[-1] = last_ids[words[k][-1]]
                    out[k] = np.array(self.merge_long(row.tolist()), dtype=IDS).tobytes()
                continue
            step = max(1, 500_000 // max(width, 1))
            for at in range(0, len(which), step):
                some = which[at : at + step]
                chosen = [words[k] for k in some]
                sizes = np.array([len(w) for w in chosen])
                raw = np.frombuffer(b"".join(chosen), dtype=np.uint8)
                rows = np.full((len(some), width), PAD, dtype=np.int32)
                rows[np.arange(width)[None, :] < sizes[:, None]] = byte_ids[raw]
                if last_ids is not None and width:
                    full = np.flatnonzero(sizes)
                    rows[full, sizes[full] - 1] = last_ids[raw[np.cumsum(sizes)[full] - 1]]
                for k, word in zip(some, self.merge_rows(rows)):
                    out[k] = word
        return out
