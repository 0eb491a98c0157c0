"""Shingle sets and parity sketches of texts (numpy, inside tasks)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash

_K = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


CHUNK = 1 << 20  # bytes hashed at a time
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _K)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]).cumprod(dtype=np.uint64)


_UP = _powers(int(_K), CHUNK)
_DOWN = _powers(pow(int(_K), -1, 1 << 64), CHUNK)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of up to CHUNK bytes, and where they begin: a
    polynomial in the word's bytes, from one running sum over all of them."""
    x = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], _SPACE[x], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[x] * _UP[:len(x)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * _DOWN[start] + (end - start).astype(np.uint64)), start


def _long(data: bytes) -> np.ndarray:
    """Word hashes of a text longer than a chunk: chunks end after white space;
    a word that is longer than a chunk is hashed alone."""
    out, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        cut = end
        if end < len(data):
            while cut > at and not _SPACE[data[cut - 1]]:
                cut -= 1
        if cut > at:
            out.append(word_hashes(data[at:cut])[0])
        else:
            cut = m.start() if (m := _GAP.search(data, end)) else len(data)
            out.append(np.array([xxhash.xxh3_64_intdigest(data[at:cut])], np.uint64))
        at = cut
    return np.concatenate(out)


def words_of(texts: list[bytes | None]) -> list[np.ndarray]:
    """The word hashes of each text, A-Z lower-cased, split at ASCII white space."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    held: list[int] = []

    def hash_held() -> None:
        parts = [texts[k] for k in held]
        ends = np.cumsum([len(p) + 1 for p in parts])
        h, start = word_hashes(b" ".join(parts).lower())
        for k, own in zip(held, np.split(h, np.searchsorted(start, ends[:-1]))):
            out[k] = own
        held.clear()

    size = 0
    for k, text in enumerate(texts):
        if not text:
            continue
        if len(text) >= CHUNK:
            out[k] = _long(text.lower())
            continue
        if held and size + len(text) + 1 > CHUNK:
            hash_held()
            size = 0
        held.append(k)
        size += len(text) + 1
    if held:
        hash_held()
    return out


def shingle_sets(texts: list[bytes | None], size: int = 4) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``size``-word shingles. A text
    with fewer words has its whole sequence as its one shingle; one without words
    has none."""
    out = []
    for w in words_of(texts):
        if not len(w):
            out.append(w)
            continue
        k = min(size, len(w))
        acc = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            acc = acc * _K + w[i:len(w) - k + 1 + i]
        acc = np.sort(mix(acc))
        out.append(acc[np.concatenate([[True], acc[1:] != acc[:-1]])])
    return out


@dataclass(frozen=True)
class Bands:
    """Sizes by powers of two and, in each band, the number of sketch parts.

    For sets A and B with ``percent * |A or B| <= 100 * |A and B|`` the symmetric
    difference is at most ``(100 - percent) * (|A| + |B|) / (100 + percent)``, and
    the larger set has at most ``100 / percent`` times the smaller one's size.
    """

    percent: int = 85

    def differ(self, n: int) -> int:
        """The largest symmetric difference of a set of ``n`` with any partner."""
        return (100 - self.percent) * (n + 100 * n // self.percent) // (100 + self.percent)

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, parts) in which a set of ``n`` takes part: its own band, and the
        one below if a partner may be there. Sets that only link with equal ones
        take part in none."""
        if n < 1 or self.differ(n) < 1:
            return []
        out = [(b := n.bit_length() - 1, 1 << b)]
        if -(-self.percent * n // 100) < 1 << b and b > 0:
            out.append((b - 1, 1 << (b - 1)))
        return out


def part_keys(elements: np.ndarray, band: int, parts: int) -> np.ndarray:
    """One key for each part of the parity sketch, empty parts included.

    The sketch has ``parts`` parts of 2**32 bits. An element flips one bit, so
    the Hamming distance of two sketches, and with it the number of parts that
    differ, is at most the symmetric difference of the sets. A part is held as
    the XOR of a code for each of its flipped bits: equal parts have equal words.
    """
    part = ((elements >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    words = np.zeros(parts, np.uint64)
    if len(elements):
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        words[part[starts].astype(np.int64)] = np.bitwise_xor.reduceat(mix(elements), starts)
    place = mix(np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 40))
    return mix(words ^ place)


def rarest(keys: np.ndarray, counts: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` keys that come first by (count of the key's cell, key). The
    order depends on a key alone, so if two sketches agree in all but d parts,
    the first agreeing part is among the first d + 1 of both."""
    if keep >= len(keys):
        return keys
    seen = counts[(keys & np.uint64(len(counts) - 1)).astype(np.int64)]
    return keys[np.lexsort((keys, seen))[:keep]]


def dense_sketch(elements: np.ndarray, bits: int = 512) -> np.ndarray:
    """A parity sketch of ``bits`` bits (a power of two), packed."""
    at = np.bincount((mix(elements + _K) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8))


def wide_sketch(elements: np.ndarray) -> bytes:
    """A parity sketch of at least four bits an element, so it tells large sets apart
    too: a sixteenth of the set's own size."""
    return dense_sketch(elements, 1 << max(9, (4 * len(elements) - 1).bit_length())).tobytes()


def sketches_apart(x: bytes, y: bytes) -> int:
    """The Hamming distance of two wide sketches, at most the symmetric difference of
    their sets. The wider one is folded onto the other: a bit's place modulo fewer
    bits is its place there."""
    if len(x) > len(y):
        x, y = y, x
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())
