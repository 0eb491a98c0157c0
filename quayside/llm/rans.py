"""Static range asymmetric numeral system with interleaved lanes (numpy).

A block's symbols go round-robin to ``LANES`` coders with a 64-bit state each;
one numpy operation advances all lanes by a symbol. States stay in
[2**31, 2**63) and give off 32-bit words. The frequency table sums to 2**BITS
and is shared by all blocks, so blocks are independent.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20
LANES = 1024
_LOW = np.uint64(1 << 31)
_SHIFT = np.uint64(32)


def normalised(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for every symbol that occurs."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(used):
        return out.astype(np.uint64)
    if len(used) > 1 << (bits - 1):
        raise ValueError("too many symbols for the table")
    exact = counts[used] * ((1 << bits) - len(used)) / counts[used].sum()
    share = np.floor(exact).astype(np.int64)
    short = (1 << bits) - len(used) - int(share.sum())
    order = np.argsort(share - exact, kind="stable")
    share[order[:short]] += 1
    out[used] = share + 1
    return out.astype(np.uint64)


@dataclass(frozen=True)
class Table:
    freq: np.ndarray
    first: np.ndarray
    symbol: np.ndarray
    crc32: int

    @staticmethod
    def of(freq: np.ndarray) -> Table:
        freq = np.asarray(freq, np.uint64)
        first = np.concatenate([np.zeros(1, np.uint64), np.cumsum(freq)[:-1].astype(np.uint64)])
        symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        return Table(freq, first, symbol, zlib.crc32(freq.astype("<u4").tobytes()))


def encode(ids: np.ndarray, table: Table) -> bytes:
    """The block's lane states, then its words in reading order."""
    state = np.full(LANES, _LOW, np.uint64)
    bits, top, words = np.uint64(BITS), np.uint64(63 - BITS), []
    f_all, c_all = table.freq[ids], table.first[ids]
    if len(ids) and not f_all.all():
        raise ValueError("a symbol is not in the frequency table")
    for t in range(-(-len(ids) // LANES) - 1, -1, -1):
        f, c = f_all[t * LANES:(t + 1) * LANES], c_all[t * LANES:(t + 1) * LANES]
        x = state[:len(f)]
        over = x >= f << top
        words.append(x[over].astype("<u4"))
        x = np.where(over, x >> _SHIFT, x)
        q = x // f
        state[:len(f)] = (q << bits) + (x - q * f) + c
    return state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode(data: bytes, n: int, table: Table) -> np.ndarray:
    """The block's ``n`` symbols; raises when the stream does not end as it
    began."""
    state = np.frombuffer(data, "<u8", LANES).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * LANES).astype(np.uint64)
    bits, mask, out, at = np.uint64(BITS), np.uint64((1 << BITS) - 1), np.empty(n, np.uint32), 0
    for t in range(-(-n // LANES)):
        x = state[:min(LANES, n - t * LANES)]
        slot = x & mask
        s = table.symbol[slot]
        out[t * LANES:t * LANES + len(x)] = s
        x = table.freq[s] * (x >> bits) + slot - table.first[s]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << _SHIFT) | words[at:at + len(low)]
        at += len(low)
        state[:len(x)] = x
    if at != len(words) or (state != _LOW).any():
        raise ValueError("damaged block")
    return out
