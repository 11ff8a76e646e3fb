"""Words of many texts at once: their places, 64-bit hashes of them, and comparison byte by byte."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
P, A, B, C = (U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
P_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Spans of more bytes are hashed and compared one by one; there are few of them.
LONG = 512
_HEAD = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * C
    h = (h ^ (h >> U(29))) * A
    return h ^ (h >> U(32))


class Bytes:
    """Bytes that can be loaded eight at a time from any place; zeros follow the last one."""

    def __init__(self, data: bytes):
        self.data = data
        raw = np.frombuffer(data + bytes(8), np.uint8)
        self.array = raw[: len(data)]
        self.words = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))

    def load(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n (eight at most) bytes at each place as one number."""
        return self.words[at] & _HEAD[n]


def span_hash(b: Bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes, eight bytes a step; spans of one length up to eight bytes never share one."""
    n = ends - starts
    h = mix(mix(n.astype(U) * B) ^ b.load(starts, np.minimum(n, 8)) * P)
    at, left = 8, np.flatnonzero(n > 8)
    while len(left) and at < LONG:
        h[left] = mix((h[left] + A) ^ b.load(starts[left] + at, np.minimum(n[left] - at, 8)) * P)
        at += 8
        left = left[n[left] > at]
    for k in left.tolist():
        h[k] = xxhash.xxh3_64_intdigest(b.data[starts[k] : ends[k]])
    return h


def same_spans(a: Bytes, i: np.ndarray, b: Bytes, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes of ``a`` at i are those of ``b`` at j, for all of them."""
    head = np.minimum(n, 8)
    same = a.load(i, head) == b.load(j, head)
    at, left = 8, np.flatnonzero(same & (n > 8))
    while len(left) and at < LONG:
        k = np.minimum(n[left] - at, 8)
        good = a.load(i[left] + at, k) == b.load(j[left] + at, k)
        same[left[~good]] = False
        at += 8
        left = left[good & (n[left] > at)]
    for k in left.tolist():
        same[k] = a.data[i[k] : i[k] + n[k]] == b.data[j[k] : j[k] + n[k]]
    return same


def numbered(b: Bytes, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A small number for each span, equal just where the bytes are; keys may be any hash, even a weak one."""
    _, where, back = np.unique(keys, return_index=True, return_inverse=True)
    n, first = ends - starts, where[back]
    other = n != n[first]
    other[~other] = ~same_spans(b, starts[~other], b, starts[first[~other]], n[~other])
    # Spans whose hash belongs to other bytes are told apart one by one.
    more: dict[bytes, int] = {}
    for k in np.flatnonzero(other).tolist():
        back[k] = more.setdefault(b.data[starts[k] : ends[k]], len(where) + len(more))
    return back


def sequence_hash(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each x[start:end], whatever its place: polynomials of prefixes, mixed. It only brings candidates together; equal ones have to be compared."""
    powers = np.full((2, len(x) + 1), [[P], [P_INVERSE]], U)
    powers[:, 0] = 1
    up, down = np.cumprod(powers, axis=1)
    h = np.zeros(len(x) + 1, U)
    np.cumsum((x.astype(U) + U(1)) * up[: len(x)], out=h[1:])
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(U) * B)


def flat(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions first[k] .. first[k] + length[k] - 1, for all k."""
    return np.repeat(first - np.cumsum(length) + length, length) + np.arange(int(length.sum()))


def word_spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    edge = np.diff(np.concatenate([[False], ~SPACE[a], [False]]).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
