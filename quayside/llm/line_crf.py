"""Quality classifier: a linear-chain conditional random field over a text's lines.

Every line that holds more than white space is good or bad. Its score is linear in
the features of the line and of the lines before and after it (``LINE_FEATURES``,
standardised, with their squares); neighbouring labels have weights of their own.
``fit`` takes the label of a document as that of each of its lines and maximises
the likelihood of the label sequences, each document counting once however long it
is. ``predict`` runs forward and backward over a text's lines; the document's score
is the mean of the marginals of ``good``, weighted by line length.

The fit is on a bounded sample: at most ``MAX_DOCS`` labelled documents, chosen by a
seeded hash of the id (and again by one of id and text, so repeated ids do not
break the bound), of at most ``MAX_LINES`` lines each, reduced to their line
features. Prediction covers every line of every text; a text's lines are described
in blocks, so memory follows the number of lines, not the features.

Defined cases. Null, empty and white-space texts have no line; their score is 0.
Labels that are null, or lack a document, are not learned from; of labels repeated
for an id the largest counts. With no labels, or labels of one kind, every text
with a line gets that kind (0 without). Null ids and repeated rows are scored like
others. Only the named columns are read, so other names cannot clash; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DOCS = 4000
MAX_LINES = 200
BLOCK = 1 << 20  # characters described at a time, or one longer line
LINE_FEATURES = 24
SYMBOLS, STOPS, MARKS = "#$%&*|<>~^=+@/\\_{}[]", ".!?…", ",;:'\"()-–—«»“”‘’¿¡"
_LOWER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _BANG, _STOP, _MARK, _OTHER = range(9)


def _classes() -> np.ndarray:
    """The class of each code point below 2**16; those above count as others."""
    out = np.full(1 << 16, _OTHER, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        if c.islower():
            out[k] = _LOWER
        elif c.isupper():
            out[k] = _UPPER
        elif c.isdigit():
            out[k] = _DIGIT
        elif c.isspace():
            out[k] = _SPACE
    for kind, chars in ((_SYMBOL, SYMBOLS), (_STOP, STOPS), (_MARK, MARKS), (_BANG, "!")):
        out[[ord(c) for c in chars]] = kind
    return out


_CLASS = _classes()


def lines_of(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x and not x.isspace()]


def _described(lines: list[str]) -> np.ndarray:
    """Features that a line has by itself, one row per line."""
    codes = np.frombuffer("".join(x + "\n" for x in lines).encode("utf-32-le"), "<u4")
    size = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    start = np.cumsum(size) - size
    kind = np.where(codes < 1 << 16, _CLASS[np.minimum(codes, 0xFFFF)], _OTHER)
    total = lambda mask: np.add.reduceat(mask.astype(np.int64), start)
    solid = kind != _SPACE
    first = solid & np.concatenate([[True], ~solid[:-1]])  # words begin, and their ends
    last = solid & np.concatenate([~solid[1:], [True]])
    begins, ends = np.flatnonzero(first), np.flatnonzero(last)
    length = np.zeros(len(codes), np.int64)
    length[begins] = ends - begins + 1
    n_words, n_solid = np.maximum(total(first), 1), np.maximum(total(solid), 1)
    of = lambda *kinds: total(np.isin(kind, kinds)) / n_solid
    words = [x.split() for x in lines]
    lead = kind[np.minimum(begins[np.searchsorted(begins, start)], len(kind) - 1)]
    tail = kind[ends[np.searchsorted(ends, start + size) - 1]]
    return np.column_stack([
        np.log1p(size - 1), np.log1p(n_words), n_solid / n_words / 10, np.log1p(np.maximum.reduceat(length, start)),
        of(_LOWER), of(_UPPER), of(_DIGIT), of(_SYMBOL), of(_BANG), of(_MARK), of(_STOP), of(_OTHER),
        total(first & (kind == _UPPER)) / n_words, total((length > 0) & (length <= 3)) / n_words,
        total(last & np.isin(kind, (_SYMBOL, _BANG))) / n_words, total(last & (kind == _STOP)) / n_words,
        np.array([len(set(w)) for w in words]) / n_words,
        np.array([sum(a == b for a, b in zip(w, w[1:])) for w in words]) / n_words,
        np.isin(tail, (_STOP, _BANG)), lead == _UPPER, total(codes > 127) / n_solid])


def line_features(lines: list[str]) -> Iterator[np.ndarray]:
    """Blocks of rows of LINE_FEATURES numbers for the lines of one text."""
    seen: set[str] = set()
    many, before, at = np.log1p(len(lines)), None, 0
    while at < len(lines):
        end, chars = at, 0
        while end < len(lines) and (end == at or chars + len(lines[end]) <= BLOCK):
            chars += len(lines[end])
            end += 1
        some = lines[at:end]
        old = np.zeros((len(some), 2))
        for k, x in enumerate(some):
            old[k] = x in seen, x == before
            seen.add(x)
            before = x
        yield np.column_stack([_described(some), old, np.full(len(some), many)]).astype(np.float32)
        at = end


@dataclass
class Field:
    """Weights of the field: of the standardised features of a line and its two
    neighbours, a constant, weights at a text's edges, and the gain of equal
    neighbouring labels (bad, good)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # 3 x (2 * LINE_FEATURES)
    other: np.ndarray  # constant, first line, last line
    stay: np.ndarray  # bad after bad, good after good
    only: int | None = None  # the only label seen

    def expanded(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([z, z * z / 5])

    def gains(self, lines: list[str]) -> np.ndarray:
        """The score of ``good`` over ``bad`` per line, without its neighbours'
        labels."""
        parts = np.vstack([self.expanded(x) @ self.weights.T for x in line_features(lines)])
        return _with_neighbours(parts, self.other)


def _with_neighbours(parts: np.ndarray, other: np.ndarray) -> np.ndarray:
    out = parts[:, 1] + other[0]
    out[1:] += parts[:-1, 0]
    out[:-1] += parts[1:, 2]
    out[0] += other[1]
    out[-1] += other[2]
    return out


def marginals(gains: list[np.ndarray], stay: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Forward-backward over several sequences at once: per sequence the
    probability of ``good`` of each line; per sequence the expected number of
    (bad, bad) and (good, good) neighbours; and the log of the partition sum."""
    order = sorted(range(len(gains)), key=lambda k: -len(gains[k]))
    size = np.array([len(gains[k]) for k in order])
    if not len(size):
        return [], np.zeros((0, 2)), np.zeros(0)
    # time-major and without padding: position t holds the sequences longer than t
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    at = np.concatenate([[0], np.cumsum(alive)])
    flat = np.empty(at[-1])
    for row, k in enumerate(order):
        flat[at[:len(gains[k])] + row] = gains[k]
    forward = np.empty((at[-1], 2))
    backward = np.zeros((at[-1], 2))
    for t in range(len(alive)):
        here = flat[at[t]:at[t + 1]]
        if t == 0:
            forward[:at[1], 0], forward[:at[1], 1] = 0.0, here
            continue
        old = forward[at[t - 1]:at[t - 1] + alive[t]]
        forward[at[t]:at[t + 1], 0] = np.logaddexp(old[:, 0] + stay[0], old[:, 1])
        forward[at[t]:at[t + 1], 1] = np.logaddexp(old[:, 0], old[:, 1] + stay[1]) + here
    for t in range(len(alive) - 2, -1, -1):
        n = alive[t + 1]
        new = backward[at[t + 1]:at[t + 2]] + np.column_stack([np.zeros(n), flat[at[t + 1]:at[t + 2]]])
        backward[at[t]:at[t] + n, 0] = np.logaddexp(new[:, 0] + stay[0], new[:, 1])
        backward[at[t]:at[t] + n, 1] = np.logaddexp(new[:, 0], new[:, 1] + stay[1])
    log_sum = np.logaddexp(backward[:at[1], 0], backward[:at[1], 1] + flat[:at[1]])
    row = np.arange(at[-1]) - np.repeat(at[:-1], alive)
    good = np.exp(forward[:, 1] + backward[:, 1] - log_sum[row])
    pairs = np.zeros((len(size), 2))
    if len(alive) > 1:  # neighbours (t, t + 1): rows from at[1] on, and theirs one position before
        r, t = row[at[1]:], np.repeat(np.arange(len(alive)), alive)[at[1]:]
        back = at[t - 1] + r
        new = backward[at[1]:] + np.column_stack([np.zeros(len(r)), flat[at[1]:]])
        for s in (0, 1):
            pairs[:, s] = np.bincount(r, np.exp(forward[back, s] + stay[s] + new[:, s] - log_sum[r]), len(size))
    out, p, z = [np.empty(0)] * len(gains), np.empty((len(gains), 2)), np.empty(len(gains))
    for i, k in enumerate(order):
        out[k], p[k], z[k] = good[at[:size[i]] + i], pairs[i], log_sum[i]
    return out, p, z


def train(documents: list[np.ndarray], labels: np.ndarray, rounds: int = 150, rate: float = 0.05, penalty: float = 1e-3) -> Field:
    """The field of the largest penalised likelihood, by full-batch Adam.
    ``documents`` hold the rows of ``line_features``."""
    if not len(labels) or labels.min() == labels.max():
        blank = np.zeros(LINE_FEATURES)
        return Field(blank, blank + 1, np.zeros((3, 2 * LINE_FEATURES)), np.zeros(3), np.zeros(2), int(labels[0]) if len(labels) else 0)
    rows = np.concatenate(documents).astype(np.float64)
    field = Field(rows.mean(0), rows.std(0) + 1e-6, np.zeros((3, 2 * LINE_FEATURES)), np.array([np.log(labels.mean() / (1 - labels.mean())), 0, 0]), np.zeros(2))
    x, size = field.expanded(rows), np.array([len(d) for d in documents])
    start = np.cumsum(size) - size
    cuts, last = start[1:], start + size - 1
    y, share = np.repeat(labels, size).astype(np.float64), np.repeat(1 / size, size) / len(size)
    head, tail = np.zeros(len(x), bool), np.zeros(len(x), bool)
    head[start], tail[last] = True, True
    stays = np.column_stack([(1 - labels) * (size - 1), labels * (size - 1)])
    w = np.concatenate([field.weights.ravel(), field.other, field.stay])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        weights, other, stay = w[:-5].reshape(3, -1), w[-5:-2], w[-2:]
        parts = x @ weights.T
        gain = parts[:, 1] + other[0] + head * other[1] + tail * other[2]
        gain[1:] += np.where(head[1:], 0, parts[:-1, 0])
        gain[:-1] += np.where(tail[:-1], 0, parts[1:, 2])
        good, pairs, _ = marginals(np.split(gain, cuts), stay)
        error = (np.concatenate(good) - y) * share
        before, after = np.append(np.where(head[1:], 0, error[1:]), 0), np.append(0, np.where(tail[:-1], 0, error[:-1]))
        slope = np.concatenate([before @ x, error @ x, after @ x, [error.sum(), error @ head, error @ tail],
                                ((pairs - stays) / size[:, None]).mean(0)])
        slope += penalty * np.concatenate([w[:-5], [0, 0, 0], w[-2:]])
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Field(field.mean, field.scale, w[:-5].reshape(3, -1), w[-5:-2], w[-2:])


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text, mod ``folds``, is ``fold``; a null id counts as
    empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES, seed: int = 0) -> Field:
    """Learn from the documents that ``labels`` (id, label 0 or 1) names."""
    known = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).dropna()
             .groupBy("__id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(max_docs))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for text in b.column(2).to_pylist():
                lines = lines_of(text)
                data.append(np.vstack(list(line_features(lines))).tobytes() if 0 < len(lines) <= max_lines else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["key", "y", "f"])

    rows = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
            .join(F.broadcast(known), "__id")  # at most max_docs rows
            .select(F.xxhash64(F.lit(seed), "__id", "text").alias("key"), "y", "text")
            .mapInArrow(described, "key long, y int, f binary").where("f IS NOT NULL")
            .orderBy("key", "f").limit(max_docs).collect())  # at most max_docs rows of max_lines lines
    return train([np.frombuffer(r["f"], np.float32).reshape(-1, LINE_FEATURES) for r in rows], np.array([r["y"] for r in rows], np.int64))


def scores(texts: list[str | None], field: Field) -> np.ndarray:
    """The length-weighted mean marginal of each text."""
    lines = [lines_of(t) for t in texts]
    own = [k for k, x in enumerate(lines) if x]
    out = np.zeros(len(texts))
    if field.only is not None:
        out[own] = field.only
        return out
    good, _, _ = marginals([field.gains(lines[k]) for k in own], field.stay)
    for k, p in zip(own, good):
        out[k] = min(1.0, np.average(p, weights=np.fromiter(map(len, lines[k]), np.float64, len(p))))
    return out


def predict(docs: DataFrame, field: Field, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``score`` and ``predicted`` (1 from ``threshold`` on) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s = scores(part.column(1).to_pylist(), field)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col))
