"""md5 of many short messages at once: every head with every tail, in numpy arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_K = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], dtype=np.uint32)
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes that one block of md5 takes; messages done at once, so that their arrays stay in the cache; fewer are hashed one by one.
BLOCK, CHUNK, FEW = 55, 32_768, 512


def _mixed(words: list[np.ndarray | None], shape: tuple[int, int]) -> np.ndarray:
    """The first word of the digests of one block each; ``words`` are (heads, 1), (1, tails) or (heads, tails), None where all are 0."""
    a, b, c, d = (np.full((1, 1), x, dtype=np.uint32) for x in _START)
    f, t = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
    for i in range(61):  # the last three steps change the other words
        turn, word = _TURN[i // 16][i % 4], words[_WORD[i // 16](i)]
        add = _K[i] if word is None else word + _K[i]
        whole = max(b.size, a.size) == f.size
        o, p = (f, t) if whole else (None, None)
        if i < 16:
            x = np.bitwise_xor(c, d, out=o) if whole else c ^ d
            x = np.bitwise_and(x, b, out=o)
            x = np.bitwise_xor(x, d, out=o)
        elif i < 32:
            x = np.bitwise_xor(b, c, out=o)
            x = np.bitwise_and(x, d, out=o)
            x = np.bitwise_xor(x, c, out=o)
        elif i < 48:
            x = np.bitwise_xor(b, c, out=o)
            x = np.bitwise_xor(x, d, out=o)
        else:
            x = np.bitwise_not(d, out=o) if whole else ~d
            x = np.bitwise_or(x, b, out=o)
            x = np.bitwise_xor(x, c, out=o)
        x = np.add(x, a, out=o)
        x = x + add if not whole else np.add(x, add, out=o)
        y = np.right_shift(x, np.uint32(32 - turn), out=p if x.shape == shape else None)
        x = np.left_shift(x, np.uint32(turn), out=x if x.shape == shape else None)
        x = np.bitwise_or(x, y, out=x if x.shape == shape else None)
        if whole and a.shape == shape:  # its array is free now
            new = np.add(x, b, out=a)
        else:
            new = x + b
        a, b, c, d = d, new, b, c
    return np.broadcast_to(b + np.uint32(_START[0]), shape)


def first_words(heads: list[bytes], tails: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places among the heads, (those, tails) array of the first 32 bits of md5(head + tail) as numbers), until every head is done."""
    if not tails:
        return
    longest, ends = max(map(len, tails)), np.array([len(x) for x in tails])
    by_length: dict[int, list[int]] = {}
    for i, h in enumerate(heads):
        by_length.setdefault(len(h), []).append(i)
    plain = len(heads) * len(tails) < FEW
    matrix = np.array(tails, dtype=f"S{max(longest, 1)}").view(np.uint8).reshape(len(tails), -1)
    for length, places in by_length.items():
        whole, over = divmod(length, 4)
        if plain or length + longest > BLOCK:
            for i in places:
                yield np.array([i]), np.array([[int.from_bytes(hashlib.md5(heads[i] + t).digest()[:4], "big") for t in tails]], dtype=np.uint32)
            continue
        space = np.zeros((len(tails), 4 * (over + longest + 4) // 4 * 4), dtype=np.uint8)
        space[:, over : over + matrix.shape[1]] = matrix
        space[np.arange(len(tails)), over + ends] = 0x80
        own = np.ascontiguousarray(space.view("<u4")[:, : (over + longest) // 4 + 1].T)
        step = max(1, CHUNK // len(tails))
        for k in range(0, len(places), step):
            now = np.array(places[k : k + step])
            head = np.frombuffer(b"".join(heads[i].ljust(4 * (whole + 1), b"\0") for i in now), dtype="<u4").reshape(len(now), -1)
            words: list[np.ndarray | None] = [None] * 16
            words[:whole] = [np.ascontiguousarray(head[:, w, None]) for w in range(whole)]
            words[whole : whole + len(own)] = [w[None, :] for w in own]
            words[whole] = words[whole] + head[:, whole, None]
            words[14] = (8 * (length + ends)).astype(np.uint32)[None, :]
            yield now, _mixed(words, (len(now), len(tails))).byteswap()
