"""Encoding of whole texts by a public tokenizer, inside tasks.

The tokenizers library encodes pieces of a text, each distinct piece once per
worker while it is remembered, and the ids of a text are those of its pieces in
order. Texts are cut only where every tokenizer of this family cuts by itself
before it merges anything: before white space that follows something else, and
after a run of Latin letters that an ASCII character other than a letter
follows. Texts with a character on which two definitions of white space differ
are encoded uncut. Tests hold the ids against uncut encoding. With ``special``
the strings of special tokens in a text are those tokens, as in a plain call of
the library (no cut splits them: they begin with ``<`` and hold no white space);
without it they are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from itertools import compress, repeat
from operator import is_
from pathlib import Path

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_RUN = rf"[{_LETTERS}]++(?![^\x00-\x7f])"
_WITH_SPACE = re.compile(rf"\s*{_RUN}|\s*\S+|\s+")
_WITHOUT_SPACE = re.compile(rf"{_RUN}|\S+")
_PLAIN = re.compile(rf" ?[{_LETTERS}]+").fullmatch
_UNCUT = re.compile("[\x1c-\x1f᠎]")
CODES = {"<u2": "H", "<u4": "I"}  # array codes of the widths of an id
MOST_PIECES = 600_000  # remembered pieces of a worker, twice: about 250 MB


def id_width(path: str, *ids: int) -> str:
    """The numpy type that holds every id of a tokenizer's file, and ``ids``."""
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(path).get_vocab_size() - 1, *ids)
    return "<u2" if most < 1 << 16 else "<u4"


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer's file, read once and sent to every executor (its size is
    that of the file, 1.6 MB here, whatever the input)."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


class Remembered(dict):
    """Values by piece for the last MOST_PIECES to twice as many pieces: when the
    younger half is full it becomes the older one, and a piece of the older half
    that is met again moves to the younger."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def missing(self, pieces: Iterable[str]) -> list[str]:
        """The pieces that must be learned; all others are in the dict then."""
        every = set(pieces)
        new = [p for p in every if p not in self]
        if len(self) + len(new) > MOST_PIECES:
            self.old = dict(self)
            self.clear()
            new = every
        unknown = []
        for p in new:
            if (x := self.old.get(p)) is None:
                unknown.append(p)
            else:
                self[p] = x
        return unknown


class Encoder:
    """Ids (little-endian unsigned) of whole texts.

    ``spaces``: the tokenizer keeps white space (byte-level) or drops it."""

    def __init__(self, file_text: str, spaces: bool, dtype: str = "<u4", special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file_text)
        self.tokenizer.encode_special_tokens = not special
        self.tokenizer.no_truncation()
        if self.tokenizer.get_vocab_size() > 1 << 8 * np.dtype(dtype).itemsize:
            raise ValueError("the ids do not fit")
        self.keeps_all = spaces  # pieces cover the text, so their lengths give places
        self.cut = (_WITH_SPACE if spaces else _WITHOUT_SPACE).findall
        self.code, self.known = CODES[dtype], Remembered()
        # no token of letters and a leading space holds a line end or a mark
        self.separator = "\n" if spaces else " ! "
        self.separator_id = self.tokenizer.encode(self.separator.strip(" "), add_special_tokens=False).ids[0]

    def ids(self, text: str | None) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of several texts; the pieces that are new among them are learned
        together."""
        pieces = [None if _UNCUT.search(t := text or "") else self.cut(t) for text in texts]
        found = [None if p is None else list(map(self.known.get, p)) for p in pieces]
        gaps = [[] if f is None or None not in f else list(compress(range(len(f)), map(is_, f, repeat(None)))) for f in found]
        self.learn({p[k] for p, g in zip(pieces, gaps) for k in g})
        out = []
        for text, p, f, g in zip(texts, pieces, found, gaps):
            for k in g:
                f[k] = self.known[p[k]]
            out.append(self._own(text) if f is None else b"".join(f))
        return out

    def _own(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces. Plain words go to the library joined by a
        separator that stays a token of its own, and the ids are cut at it."""
        new = self.known.missing(pieces)
        words = [p for p in new if _PLAIN(p)]
        for i in range(0, len(words), 4096):
            some = words[i:i + 4096]
            ids = array(self.code, self.tokenizer.encode_batch_fast([self.separator.join(some)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(np.frombuffer(ids, f"<u{ids.itemsize}") == self.separator_id)
            if len(ends) != len(some) - 1:
                new += some  # not cut as expected: one by one
                continue
            data, at = ids.tobytes(), 0
            for p, end in zip(some, [*(ends * ids.itemsize).tolist(), len(data)]):
                self.known[p] = data[at:end]
                at = end + ids.itemsize
        rest = [p for p in new if p not in self.known]
        for i in range(0, len(rest), 4096):
            for p, e in zip(some := rest[i:i + 4096], self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[p] = array(self.code, e.ids).tobytes()


_ENCODERS: dict[tuple, object] = {}


def encoder(kind: type, *args):
    """One encoder per Python worker, kept between tasks with what it remembers."""
    if (kind, *args) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[kind, *args] = kind(*args)
    return _ENCODERS[kind, *args]


class SpanEncoder:
    """Character spans of a text's tokens, by the same pieces."""

    def __init__(self, file_text: str, spaces: bool, special: bool = False):
        self.encoder = Encoder(file_text, spaces, special=special)
        self.known = Remembered()

    def _encode(self, texts: list[str]):
        for e in self.encoder.tokenizer.encode_batch(texts, add_special_tokens=False):
            yield np.array(e.offsets, np.int32).reshape(-1, 2)

    def spans(self, text: str | None) -> np.ndarray:
        """A (start, end) row for each token, in order."""
        text = text or ""
        if _UNCUT.search(text) or not self.encoder.keeps_all:
            return next(self._encode([text])).astype(np.int64)
        pieces = self.encoder.cut(text)
        new = self.known.missing(pieces)
        for i in range(0, len(new), 4096):
            for p, x in zip(some := new[i:i + 4096], self._encode(some)):
                self.known[p] = x.tobytes()
        parts = [self.known[p] for p in pieces]
        spans = np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2).astype(np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.fromiter(map(len, parts), np.int64, len(parts)) // 8
        return spans + np.repeat(np.cumsum(lengths) - lengths, counts)[:, None]
