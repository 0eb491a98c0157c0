"""Quality rules as a short-circuit cascade.

A rule is a feature of the text plus a test that rejects on it. ``plan`` runs
every rule on a bounded, hash-chosen sample, measures seconds and rejections per
rule and sorts the rules by rejections per second. ``cascade`` then runs the
rules in that order and stops at the first that rejects; a feature is computed
at most once per text and only when a rule that still runs asks for it. Which
rule comes first changes the time, never the verdict: a text is kept when no
rule rejects it.

Defined cases. Null and empty texts have no words and every feature 0; the
word-count rule rejects them. Texts are read whole, whatever their length; one
text is in memory at a time beside its Arrow batch. Repeated rows are judged one
by one, an empty table gives an empty result, and a null id is carried along.
Only the id and text columns are read, so other names cannot clash.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import WORD, hash_sample

SYMBOLS = "#*$%&|<>"  # fixed values
_WORD = re.compile(WORD)
_DROP_SYMBOLS = str.maketrans("", "", SYMBOLS)


class Features:
    """Features of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        value = getattr(Features, f"_{name}")(self)
        setattr(self, name, value)
        return value

    def _words(self) -> list[str]:
        return _WORD.findall(self.text)

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return sum(map(len, self.words))

    def _n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(_DROP_SYMBOLS))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _WORD.search(x)]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        """Words inside 3-word windows that occur twice or more, the first
        occurrence included; a word in several such windows counts once."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        covered, n = -1, 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                n += i + 2 - max(covered, i - 1)
                covered = i + 2
        return n

    def _n_marks(self) -> int:
        return self.text.count("!")

    def _n_upper_words(self) -> int:
        return sum(x.isupper() for x in self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


# Base rules, then the cascade's own.
BASE_RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
RULES = BASE_RULES + (
    Rule("symbols", lambda f: 100 * f.n_symbols > 20 * f.n_words),
    Rule("exclamation", lambda f: 100 * f.n_marks > 50 * f.n_words),
    Rule("shouting", lambda f: 100 * f.n_upper_words > 60 * f.n_words),
    Rule("duplicate_lines", lambda f: f.n_dup_lines >= 4 and 100 * f.n_dup_lines > 50 * len(f.lines)),
)


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
         text_col: str = "text", sample_rows: int = 2000, seed: int = 0) -> list[tuple[Rule, float, float]]:
    """The rules by falling rejections per second, with each rule's mean seconds
    and rejected share on at most about ``sample_rows`` rows. Every rule runs on
    a fresh text there, so a cost includes the features the rule needs. Rules
    that reject nothing come last, the cheapest first; ties keep their order."""
    sample = hash_sample(docs, id_col, sample_rows, seed).select(F.col(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hit, n = [0.0] * len(rules), [0] * len(rules), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                for k, r in enumerate(rules):
                    f, t = Features(text), time.perf_counter()
                    hit[k] += r.rejects(f)
                    cost[k] += time.perf_counter() - t
        yield pa.RecordBatch.from_pydict({"k": list(range(len(rules))), "s": cost, "hit": hit, "n": [n] * len(rules)})

    sums = (sample.mapInArrow(measure, "k long, s double, hit long, n long")
            .groupBy("k").agg(F.sum("s"), F.sum("hit"), F.sum("n")).collect())  # a row per rule
    got = {k: (s / max(n, 1), hit / max(n, 1)) for k, s, hit, n in sums}
    rated = [(r, *got.get(k, (0.0, 0.0))) for k, r in enumerate(rules)]
    return sorted(rated, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1]))


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
            report: tuple[str, ...] = (), order: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """One row per input row: id, ``kept``, ``rejected_by`` (the first rule of
    the chosen order that rejects, else null) and the features in ``report``,
    which are computed for every text."""
    order = order or [r for r, _, _ in plan(docs, rules, id_col, text_col, sample_rows)]
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by, told = [], [[] for _ in report]
            for text in b.column(1).to_pylist():
                f = Features(text)
                by.append(next((r.name for r in order if r.rejects(f)), None))
                for out, name in zip(told, report):
                    out.append(getattr(f, name))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x is None for x in by], pa.bool_()), pa.array(by, pa.string()),
                 *(pa.array(x, pa.int64()) for x in told)],
                names=["id", "kept", "rejected_by", *report])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(judge, ", ".join([f"id {kind}", "kept boolean", "rejected_by string", *(f"{x} long" for x in report)]))
            .withColumnRenamed("id", id_col))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
              sample_rows: int = 2000) -> DataFrame:
    """The rows no rule rejects, with all their columns, in one pass without a
    shuffle."""
    order = [r for r, _, _ in plan(docs, rules, id_col, text_col, sample_rows)]
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [not any(r.rejects(f) for r in order) for f in map(Features, b.column(at).to_pylist())]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)
