"""Language identification: multinomial naive Bayes over hashed character
n-grams.

``learn`` counts the n-grams (one to three characters, lower-cased, hashed to
2**17 features) of every learning row, per language, in a fixed table per task;
tables are added up in a stream per language. ``predict`` broadcasts the
log-probability matrix (half a megabyte per language) and scores a batch of
texts at a time: its characters as one array, each n-gram looks up its row of the
matrix, and one segmented sum gives every text's scores. N-grams never span two
texts, and a text is read whole, in bounded blocks.

Defined cases. Null texts and texts without a letter are ``und`` with score 0, and
so is everything if there is nothing to learn from. Rows with a null text or
language are not learned from. The score is the posterior probability of the
predicted language; of equal scores the first language in order is taken. Null
ids and repeated rows are predicted like others. Only the named columns are read,
so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import summed_tables

FEATURES = 1 << 17
ORDERS = 3
BLOCK = 1 << 20  # characters looked up at a time
MAX_LANGS = 512


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased characters of all texts, two zeros after each, and the
    texts' starts."""
    low = [t.lower() for t in texts]
    starts = np.cumsum([0, *(len(t) + ORDERS - 1 for t in low)])[:-1]
    codes = np.frombuffer("".join(t + "\0\0" for t in low).encode("utf-32-le"), "<u4")
    return codes, starts


def features(codes: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each block of positions its start and, per order, the hashed n-grams
    that begin there; those that reach past a text's end hold zeros."""
    for at in range(0, len(codes), BLOCK):
        part = codes[at:at + BLOCK + ORDERS - 1].astype(np.uint64)
        n = min(BLOCK, len(codes) - at)
        part = np.concatenate([part, np.zeros(n + ORDERS - 1 - len(part), np.uint64)])
        h, out = np.zeros(n, np.uint64), []
        for k in range(ORDERS):
            h = (h ^ part[k:k + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
            out.append((h >> np.uint64(47)).astype(np.int64))
        yield at, out


def batches_of(texts: list[str], most: int = 1 << 22) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of at most ``most`` characters, or a longer one alone."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > most:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probabilities (features x languages); the
    last row holds the log-priors."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                if len(counts) >= MAX_LANGS and lang not in counts:
                    raise ValueError(f"more than {MAX_LANGS} languages")
                c = counts.setdefault(lang, np.zeros(FEATURES + 1, np.int64))
                own = [t for x, t in zip(langs, texts) if x == lang]
                c[-1] += len(own)
                for _, some in batches_of(own):
                    codes, _ = codes_of(some)
                    for _, ids in features(codes):
                        for x in ids:
                            c[:-1] += np.bincount(x, minlength=FEATURES)
        yield _packed(counts)

    got = sorted(summed_tables(rows.mapInArrow(count, "key string, counts binary")).items())
    if len(got) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not got:
        return [], np.zeros((FEATURES + 1, 0), np.float32)
    counts = np.array([x for _, x in got], np.float64).T
    grams = np.log((counts[:-1] + 0.5) / (counts[:-1].sum(0) + 0.5 * FEATURES))
    return [x for x, _ in got], np.vstack([grams, np.log(counts[-1:] / counts[-1].sum())]).astype(np.float32)


def _packed(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": pa.array(list(counts), pa.string()),
                                       "counts": pa.array([c.tobytes() for c in counts.values()], pa.binary())})


def posteriors(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Texts x languages."""
    out = np.tile(matrix[-1].astype(np.float64), (len(texts), 1))
    for first, some in batches_of(texts):
        codes, starts = codes_of(some)
        for at, ids in features(codes):
            score = matrix[ids[0]]
            for x in ids[1:]:
                score += matrix[x]
            lo, hi = np.searchsorted(starts, [at, at + len(score)])
            cuts = np.unique(np.concatenate([[0], starts[lo:hi] - at])).astype(np.int64)
            sums = np.add.reduceat(score, cuts, axis=0, dtype=np.float64)
            owner = np.searchsorted(starts, cuts + at, "right") - 1
            out[first + owner] += sums
    out = np.exp(out - out.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``lang_pred`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if has_letter(t) else None for t in b.column(1).to_pylist()]
            at = [k for k, t in enumerate(texts) if t is not None] if langs else []
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if at:
                p = posteriors([texts[k] for k in at], shared.value)
                best = p.argmax(1)
                pred[at] = np.array(langs, object)[best]
                score[at] = p[np.arange(len(at)), best]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """crc32 of the id as text, mod ``folds``, is ``fold``; a null id counts as
    empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold
