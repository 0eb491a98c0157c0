"""Toxicity by a classifier chain of linear models.

Categories are 0/1 columns of a label table. ``fit`` trains one logistic model
per category, in order; each later model also sees the probabilities of the
earlier categories. While training, those are out-of-fold: a row's probability
comes from models that were fitted without its fold, so later models learn from
inputs as noisy as they will meet. Afterwards each model is fitted on all rows.

Features are words (lower-cased, without marks around them) and their first four
and five letters, hashed to 2**18, present or not. How many rows have a feature is
counted over all labelled documents, in fixed tables added up in a stream; the
features that separate a category best (``FEATURES``) enter the models. The models
are fitted on at most about ``max_rows`` labelled rows (documented bound,
hash-chosen), reduced to those features. ``predict`` broadcasts the weights (1 MB
per category) and reads every text whole.

Defined cases. Null and empty texts have no feature, so they get the models'
constants. Labels that are null or lack a document are not used; of labels
repeated for an id the largest counts. Without labels, or with labels of one kind,
a category gets probability 0 or 1 as seen (0 without). Null ids and repeated
rows are predicted like others. Only the named columns are read, so other names
cannot clash; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import hash_sample, summed_tables, written

SPACE = 1 << 18
FEATURES = 8192
FOLDS = 5
MAX_ROWS = 10_000
BROADCAST_LABELS = 500_000
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789«»¡¿…–—“”‘’"


class WordFeatures(dict):
    """Features of words, remembered up to a bound."""

    def __missing__(self, raw: str) -> bytes:
        if len(self) >= 500_000:
            self.clear()
        word = raw.strip(MARKS)
        parts = [f"w{word}"] + [f"{n}{word[:n]}" for n in (4, 5) if len(word) >= n] if word else []
        ids = np.array([xxhash.xxh3_64_intdigest(x) % SPACE for x in parts], np.int32)
        out = self[raw] = ids.tobytes()
        return out


def features(text: str | None, words: WordFeatures) -> np.ndarray:
    """The distinct features of a text."""
    return np.unique(np.frombuffer(b"".join(map(words.__getitem__, set((text or "").lower().split()))), np.int32))


@dataclass
class Model:
    constant: float
    weights: np.ndarray  # of the features
    earlier: np.ndarray  # of the earlier categories' probabilities

    def odds(self, row_of: np.ndarray, ids: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        return self.constant + np.bincount(row_of, self.weights[ids], n) + earlier @ self.earlier


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(row_of: np.ndarray, ids: np.ndarray, n_features: int, earlier: np.ndarray, y: np.ndarray,
             rounds: int = 200, rate: float = 0.1, penalty: float = 1e-4) -> Model:
    """Logistic regression with a quadratic penalty, by full-batch Adam."""
    if not len(y) or y.min() == y.max():
        return Model(40.0 if len(y) and y[0] else -40.0, np.zeros(n_features), np.zeros(earlier.shape[1]))
    k = earlier.shape[1]
    w = np.zeros(1 + n_features + k)
    w[0] = np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        odds = w[0] + np.bincount(row_of, w[1:1 + n_features][ids], len(y)) + earlier @ w[1 + n_features:]
        error = (_sigmoid(odds) - y) / len(y)
        slope = np.concatenate([[error.sum()], np.bincount(ids, error[row_of], n_features), earlier.T @ error]) + penalty * np.r_[0, w[1:]]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Model(w[0], w[1:1 + n_features], w[1 + n_features:])


@dataclass
class Chain:
    categories: list[str]
    features: np.ndarray  # their hashed numbers, ascending
    models: list[Model]


def chain(categories: list[str], chosen: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> Chain:
    """Fit the models one after another; ``sets`` hold positions in ``chosen``."""
    n = np.array([len(s) for s in sets], np.int64)
    row_of, ids = np.repeat(np.arange(len(sets)), n), np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64)
    earlier, models = np.zeros((len(sets), 0)), []
    for k in range(len(categories)):
        y = labels[:, k].astype(np.float64)
        models.append(logistic(row_of, ids, len(chosen), earlier, y))
        if k + 1 < len(categories):
            out = np.zeros(len(sets))
            for f in range(FOLDS):
                own, other = fold == f, fold != f
                at = np.cumsum(other) - 1
                use = other[row_of]
                fitted = logistic(at[row_of[use]], ids[use], len(chosen), earlier[other], y[other])
                out[own] = _sigmoid(fitted.odds(row_of, ids, len(sets), earlier))[own]
            earlier = np.column_stack([earlier, out])
    return Chain(categories, chosen, models)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Chain:
    """Train the chain; ``labels`` holds ``id_col`` and the category columns."""
    known = labels.select(F.col(id_col).alias("__id"), *(F.col(c).cast("int").alias(f"y{k}") for k, c in enumerate(categories)))
    known = known.dropna().groupBy("__id").agg(*(F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))))
    known = written(known, "labels")
    wanted = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known  # 16 bytes a row; else a shuffled join
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    ys = [f"y{k}" for k in range(len(categories))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tables = WordFeatures(), {x: np.zeros(SPACE + 1, np.int64) for x in ["all", *ys]}
        for b in batches:
            marks = [("all", [1] * b.num_rows), *((y, b.column(1 + k).to_pylist()) for k, y in enumerate(ys))]
            for i, text in enumerate(b.column(0).to_pylist()):
                f = features(text, words)
                for name, on in marks:
                    if on[i]:
                        tables[name][f] += 1
                        tables[name][-1] += 1
        yield pa.RecordBatch.from_pydict({"key": list(tables), "counts": pa.array([t.tobytes() for t in tables.values()], pa.binary())})

    sums = summed_tables(rows.join(wanted, "__id").select("text", *ys).mapInArrow(count, "key string, counts binary"))
    if "all" not in sums or not sums["all"][-1]:
        return Chain(categories, np.empty(0, np.int64), [Model(-40.0, np.zeros(0), np.zeros(k)) for k in range(len(categories))])
    every, n, best = sums["all"][:-1], sums["all"][-1], set()
    for y in ys:
        with_it, n_with = sums[y][:-1], sums[y][-1]
        if not 0 < n_with < n:
            continue
        share = every / n
        apart = with_it / n_with - (every - with_it) / (n - n_with)
        z = np.abs(apart) / np.sqrt(share * (1 - share) * (1 / n_with + 1 / (n - n_with)) + 1e-12)
        z[every < 3] = 0
        best |= set(np.argsort(-z, kind="stable")[:FEATURES // len(categories)].tolist())
    chosen = np.array(sorted(best), np.int64)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordFeatures()
        for b in batches:
            sets = [np.searchsorted(chosen, np.intersect1d(features(t, words), chosen, assume_unique=True)).astype("<i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(sets, pa.binary())], names=["fold", *ys, "f"])

    some = F.broadcast(hash_sample(known, "__id", max_rows))  # bounded by max_rows
    fold = F.pmod(F.xxhash64(F.lit(7), "__id"), F.lit(FOLDS)).cast("int")
    got = (rows.join(some, "__id").select(fold.alias("fold"), "text", *ys)
           .mapInArrow(reduced, ", ".join(["fold int", *(f"{y} int" for y in ys), "f binary"])).toPandas())
    got = got.sort_values(list(got.columns), ignore_index=True)  # the same order in every run
    return chain(categories, chosen, [np.frombuffer(x, "<i4") for x in got["f"]], got[ys].to_numpy(), got["fold"].to_numpy())


def predict(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, and per category ``<category>_score`` (probability) and ``<category>``
    (score of at least one half)."""
    weights = np.zeros((SPACE, len(model.categories)), np.float32)
    for k, m in enumerate(model.models):
        weights[model.features, k] = m.weights
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    constants, earlier = [m.constant for m in model.models], [m.earlier for m in model.models]
    names = [x for c in model.categories for x in (f"{c}_score", c)]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = WordFeatures(), shared.value
        for b in batches:
            sums = np.array([table[features(t, words)].sum(0, dtype=np.float64) for t in b.column(1).to_pylist()]).reshape(b.num_rows, len(constants))
            p = np.zeros((b.num_rows, 0))
            for k, c in enumerate(constants):
                p = np.column_stack([p, _sigmoid(c + sums[:, k] + p @ earlier[k])])
            cols = [x for k in range(len(constants)) for x in (pa.array(p[:, k]), pa.array(p[:, k] >= 0.5))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", *names])

    schema = ", ".join([f"id {kind}", *(f"`{c}_score` double, `{c}` boolean" for c in model.categories)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
