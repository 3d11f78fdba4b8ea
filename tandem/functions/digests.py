"""MD5 of many numbered texts at once: what ``hashlib`` gives for each, as columns of 32-bit words in numpy."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Last digits of numbers that are worked on together, all other characters being the same; so many numbers at once that the columns stay in a core's cache.
LOW, RUN = 5, 20_000
#: Numbers below which ``hashlib`` is faster.
FEW = 256
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: As arrays, which numpy takes faster than numbers.
_LEFT, _RIGHT, _FIRST = ([np.array(x, np.uint32) for x in xs] for xs in (_TURNS, [32 - t for t in _TURNS], _START))


@cache
def _digits(at: int, low: int) -> list[np.ndarray]:
    """All numbers of ``low`` digits, zeros leading, as the words they fill from byte ``at`` of the first word on; other bytes are 0."""
    told = np.zeros((10**low, 8), np.uint8)
    for i in range(low):
        told[:, at + i] = np.arange(10**low) // 10 ** (low - 1 - i) % 10 + 48
    return [np.ascontiguousarray(w) for w in told.view("<u4").T if w.any()]


def _md5(words: list[int], varied: dict[int, np.ndarray], room: list[np.ndarray]) -> list[np.ndarray]:
    """The words of the digests of messages of one 64-byte block each, made in the six arrays of ``room``; all share ``words``, to which ``varied`` adds what is their own."""
    a, b, c, d = _START
    first = min(varied)
    for i in range(first):  # the same for all messages
        f = ((d ^ (b & (c ^ d))) + a + _SINES[i] + words[i]) & 0xFFFFFFFF
        a, b, c, d = d, ((f << _TURNS[i] | f >> 32 - _TURNS[i]) + b) & 0xFFFFFFFF, b, c
    for x, start in zip(room, (a, b, c, d)):
        x.fill(start)
    a, b, c, d, f, t = room
    shared = np.array([(s + words[w]) & 0xFFFFFFFF for s, w in zip(_SINES, _WORDS, strict=True)], np.uint32)
    for i in range(first, 64):
        if i < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(f, a, f)
        np.add(f, shared[i, ...], f)
        if _WORDS[i] in varied:
            np.add(f, varied[_WORDS[i]], f)
        np.left_shift(f, _LEFT[i], t)
        np.right_shift(f, _RIGHT[i], f)
        np.bitwise_or(f, t, f)
        np.add(f, b, a)
        a, b, c, d = d, a, b, c
    return [np.add(x, s, x) for x, s in zip((a, b, c, d), _FIRST, strict=True)]


def numbered_words(head: str, numbers: range, tail: str = "") -> Iterator[tuple[int, list[np.ndarray]]]:
    """The MD5 of ``head`` + number + ``tail`` for consecutive numbers from 0 on, by runs: a run's first number, and the four little-endian words of its digests as columns, to be used before the next run is asked for."""
    at, room = numbers.start, [np.empty(RUN, np.uint32) for _ in range(6)]
    while at < numbers.stop:
        digits = len(str(at))
        low = min(LOW, digits)
        rest = at % 10**low
        n = min(numbers.stop - at, 10**low - rest, RUN)
        before, after = f"{head}{str(at)[: digits - low]}".encode(), tail.encode()
        size = len(before) + low + len(after)
        if n < FEW or size > 55:  # 55: more is more than one block
            told = b"".join(hashlib.md5(f"{head}{k}{tail}".encode(), usedforsecurity=False).digest() for k in range(at, at + n))
            yield at, list(np.frombuffer(told, "<u4").reshape(-1, 4).T)
        else:
            block = before + bytes(low) + after + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
            own = enumerate(_digits(len(before) % 4, low), len(before) // 4)
            yield at, _md5(np.frombuffer(block, "<u4").tolist(), {i: w[rest : rest + n] for i, w in own}, [x[:n] for x in room])
        at += n


def numbered_md5(head: str, numbers: range, tail: str = "") -> np.ndarray:
    """The MD5 of ``head`` + number + ``tail`` for consecutive numbers from 0 on: a row of 16 bytes for each."""
    out = np.empty((len(numbers), 4), "<u4")
    for at, words in numbered_words(head, numbers, tail):
        for i, word in enumerate(words):
            out[at - numbers.start : at - numbers.start + len(word), i] = word
    return out.view(np.uint8)
