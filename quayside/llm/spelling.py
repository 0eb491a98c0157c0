"""Spelling variants: words that differ by one letter, found in a trie of letter
counts.

A word's vector holds how many of its letters fall in each letter group. One
inserted, deleted or replaced letter changes the vector by at most one surplus and
one deficit, so the words near a word lie where a walk through a trie of vectors
may spend a surplus and a deficit of one each.

1. ``word_counts`` counts the words of all texts in a bounded table per task, then
   by a partially aggregated sum.
2. The trie's top levels are the counts of ``PAGES`` coarse groups. Words with the
   same top counts make a page; every word is stored in its own page and looked up
   in the pages that the budget reaches (``_targets``). Of a pair of pages only one
   looks up in the other, so each pair of words is met once. Pages are keys of a
   shuffle; one with more than ``PAGE_WORDS`` words is dealt out in blocks.
3. Inside a task, pages hang below one root. The levels under them are counts of
   ``LEVELS`` fine groups. A depth-first search takes all looked-up words down
   together, each with what is left of its budget, and enters only children that
   the budget allows. At a leaf the words are compared letter by letter.
4. Pairs do not leave the task: a word's near words are added up per task, then per
   word. ``roots`` follows each word's form by pointer doubling.

Defined cases. Null and empty texts have no words; a null id is an empty string
where the id is hashed. Repeated rows count one by one. Runs of any length are
taken whole (long ones are compared one by one, not in a table). Ties between near
words go to the smaller word in code-point order. An empty table gives an empty
result. Only the id and text columns are read, so other names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import written

_RUNS = re.compile("[a-zÀ-ÿ]+")
HELD = 400_000  # words counted in a task before they are handed on
PAGES = 5  # coarse groups: the code point modulo this
LEVELS = 21  # fine groups: the code point modulo this
LEAF = 6  # words below which a node is not divided any more
PAGE_WORDS = 50_000
BATCH = 20_000  # rows of whole pages that are searched together, at least
WIDE = 32  # longest word compared in a table


def runs_of(text: str) -> list[str]:
    """Maximal runs of letters, A-Z lower-cased."""
    return _RUNS.findall(text.encode().lower().decode())


def damaged(run: str, seed: int) -> str:
    """The run, or without one code point if its crc32 after ``seed`` (that of the
    id and a colon) is a multiple of 97."""
    h = zlib.crc32(run.encode(), seed)
    return run if h % 97 else run[:(k := h % len(run))] + run[k + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words with ``shortest`` code points and ``least``
    occurrences or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                for r, n in Counter(runs_of(text or "")).items():
                    if len(r) >= shortest and len(r := damaged(r, seed)) >= shortest:
                        held[r] += n
                if len(held) >= HELD:
                    yield table(held)
                    held.clear()
        yield table(held)

    def table(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    return (docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def _vectors(words: list[bytes], groups: int) -> np.ndarray:
    """Letters per group, a row per word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64) % groups
    at = np.repeat(np.arange(len(words)) * groups, sizes) + letters
    return np.bincount(at, minlength=len(words) * groups).reshape(len(words), groups).astype(np.int32)


def _targets(top: np.ndarray) -> list[np.ndarray]:
    """Changes of the top counts after which a near word is looked up: none, one
    surplus, or a surplus in a group and a deficit in a later one. The opposite
    changes are those by which the near word finds this one."""
    unit = np.eye(PAGES, dtype=np.int32)
    return [top, *(top + unit[i] for i in range(PAGES)),
            *(top + unit[i] - unit[j] for i in range(PAGES) for j in range(i + 1, PAGES))]


def _paged(words: DataFrame) -> DataFrame:
    """(page, looked_up, word, n): every word stored in its page and looked up in
    others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                top = _vectors([w.encode("latin-1") for w in part.column(0).to_pylist()], PAGES)
                for k, x in enumerate([top, *_targets(top)]):
                    use = (x >= 0).all(1)
                    pages = pa.array([".".join(map(str, row)) for row in x[use].tolist()], pa.string())
                    own = part.filter(pa.array(use))
                    yield pa.RecordBatch.from_arrays([pages, pa.array(np.full(len(pages), k > 0)), *own.columns], names=["page", "looked_up", "word", "n"])

    return words.mapInArrow(run, "page string, looked_up boolean, word string, n long")


def _dealt(paged: DataFrame, page_words: int) -> DataFrame:
    """Rows with the blocks they go to. A page of n words has b = ceil(n /
    page_words) blocks of stored words and as many of looked-up ones; each block
    of the one meets each of the other. Lookups in pages that hold no word go."""
    sizes = written(paged.where("NOT looked_up").groupBy("page").agg(F.ceil(F.count(F.lit(1)) / page_words).cast("int").alias("b")), "pages")
    own = F.pmod(F.xxhash64("word"), F.col("b")).cast("int")
    every = F.sequence(F.lit(0), F.col("b") - 1)
    stored = F.transform(every, lambda x: F.struct(own.alias("s"), x.alias("q")))
    asked = F.transform(every, lambda x: F.struct(x.alias("s"), own.alias("q")))
    return (paged.join(sizes, "page").withColumn("at", F.explode(F.when(F.col("looked_up"), asked).otherwise(stored)))
            .select("page", "at", "looked_up", "word", "n"))


class Trie:
    """Stored vectors in order, so that a node is a range of rows; the first
    column is the page, which no budget changes."""

    def __init__(self, pages: np.ndarray, vectors: np.ndarray):
        self.order = np.lexsort([*vectors.T[::-1], pages])
        self.rows = np.column_stack([pages, vectors])[self.order]

    def search(self, pages: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position asked, position stored) that may be near, leaf by leaf."""
        asked, depth = np.column_stack([pages, vectors]), self.rows.shape[1]
        stack = [(0, len(self.rows), 0, np.arange(len(asked)), np.ones(len(asked), np.int8), np.ones(len(asked), np.int8))]
        while stack:
            lo, hi, level, who, surplus, deficit = stack.pop()
            if not len(who) or lo == hi:
                continue
            if level == depth or level and hi - lo <= LEAF:
                apart = self.rows[None, lo:hi, level:] - asked[who][:, None, level:]
                good = (np.maximum(apart, 0).sum(2) <= surplus[:, None]) & (np.maximum(-apart, 0).sum(2) <= deficit[:, None])
                q, s = np.nonzero(good)
                yield who[q], self.order[lo + s]
                continue
            column = self.rows[lo:hi, level]
            cuts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            ends, wanted = np.append(cuts[1:], hi - lo), asked[who, level]
            if level == 0:  # the page itself: each asks in one
                order = np.argsort(wanted, kind="stable")
                first, last = np.searchsorted(wanted[order], column[cuts], "left"), np.searchsorted(wanted[order], column[cuts], "right")
                for a, z, f, t in zip(cuts, ends, first, last):
                    own = order[f:t]
                    stack.append((lo + a, lo + z, 1, who[own], surplus[own], deficit[own]))
                continue
            for a, z in zip(cuts, ends):
                more = column[a] - wanted
                go = np.flatnonzero((more == 0) | ((more == 1) & (surplus > 0)) | ((more == -1) & (deficit > 0)))
                stack.append((lo + a, lo + z, level + 1, who[go], surplus[go] - (more[go] == 1), deficit[go] - (more[go] == -1)))


def _one_apart(x: bytes, y: bytes) -> bool:
    """Exactly one letter inserted, deleted or replaced."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    k = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return x[k + (len(x) == len(y)):] == y[k + 1:]


class Words:
    """Words as rows of letters, compared many pairs at a time."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        short = [w if len(w) <= WIDE else b"" for w in words]
        self.table = np.frombuffer(b"".join(w.ljust(WIDE + 1, b"\0") for w in short), np.uint8).reshape(-1, WIDE + 1)

    def one_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        x, y = self.table[a], self.table[b]
        differ = x != y
        by = self.size[b] - self.size[a]
        first = differ.argmax(1)
        shifted = (x[:, :-1] == y[:, 1:]) | (np.arange(WIDE) < first[:, None])
        good = np.where(by == 0, differ.sum(1) == 1, (by == 1) & shifted.all(1))
        for k in np.flatnonzero(self.size[b] > WIDE):
            good[k] = _one_apart(self.words[a[k]], self.words[b[k]])
        return good


def _searched(pages: list[str], looked_up: np.ndarray, words: list[str], n: np.ndarray) -> pa.RecordBatch:
    """Per word met here: its number of near words and the best of them."""
    raw = [w.encode("latin-1") for w in words]
    names, who = np.unique(np.array(raw, object), return_inverse=True)  # numbers in code-point order
    many = np.zeros(len(names), np.int64)
    many[who] = n
    page = np.unique(np.array(pages, object), return_inverse=True)[1]
    stored, asked = np.flatnonzero(~looked_up), np.flatnonzero(looked_up)
    table, top, vectors = Words(list(names)), _vectors(list(names), PAGES), _vectors(list(names), LEVELS)
    out: list[np.ndarray] = [np.empty((0, 2), np.int64)]

    def verify(q: np.ndarray, s: np.ndarray) -> None:
        a, b = who[asked[q]], who[stored[s]]
        use = (a < b) | (top[a] != top[b]).any(1)  # within a page each pair is met twice
        a, b = a[use], b[use]
        good = table.one_apart(a, b)
        out.append(np.column_stack([a[good], b[good]]))

    trie = Trie(page[stored], vectors[who[stored]])
    some, size = [], 0
    for pair in trie.search(page[asked], vectors[who[asked]]):
        some.append(pair)
        size += len(pair[0])
        if size >= 1 << 17:
            verify(*map(np.concatenate, zip(*some)))
            some, size = [], 0
    if some:
        verify(*map(np.concatenate, zip(*some)))
    pairs = np.concatenate(out)
    pairs = np.concatenate([pairs, pairs[:, ::-1]])
    order = np.lexsort([pairs[:, 1], -many[pairs[:, 1]], pairs[:, 0]])
    pairs = pairs[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])) if len(pairs) else np.empty(0, np.int64)
    text = lambda k: pa.array([names[i].decode("latin-1") for i in k], pa.string())
    return pa.RecordBatch.from_arrays([
        text(pairs[first, 0]), pa.array(np.diff(np.append(first, len(pairs)))),
        text(pairs[first, 1]), pa.array(many[pairs[first, 1]])], names=["word", "n_near", "best", "best_n"])


def near_words(words: DataFrame, page_words: int = PAGE_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have near words: how many,
    and the one with the largest n."""
    dealt = _dealt(written(_paged(words), "paged"), page_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            # whole pages only: a batch is searched up to its last change of page
            held.append(b)
            size += b.num_rows
            if size < BATCH:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            page = t.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
            cut = int(np.flatnonzero(np.append(True, page[1:] != page[:-1]))[-1])
            if cut:
                yield search(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = t.num_rows - cut
        if size:
            yield search(pa.Table.from_batches(held))

    def search(t: pa.Table) -> pa.RecordBatch:
        return _searched(t.column(0).to_pylist(), t.column(1).to_numpy(), t.column(2).to_pylist(), t.column(3).to_numpy())

    key = F.concat_ws("/", "page", "at.s", "at.q").alias("key")
    found = (dealt.select(key, "looked_up", "word", "n").repartition("key").sortWithinPartitions("key")
             .mapInArrow(run, "word string, n_near long, best string, best_n long"))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n")))


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling: each round follows as far again, so there
    are as many rounds as the logarithm of the longest chain (whose n doubles at
    every step)."""
    now = forms
    while True:
        step = now.alias("x").join(now.alias("y"), F.col("x.root") == F.col("y.word"), "left").select(
            F.col("x.word").alias("word"), F.coalesce("y.root", "x.root").alias("root"), F.col("y.root").isNotNull().alias("moved"))
        step = written(step, "roots")
        now = step.select("word", "root")
        if not step.agg(F.max("moved")).first()[0]:  # one row
            return now


def variants(words: DataFrame, times: int = 2, page_words: int = PAGE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of all ``words`` (word, n). A word's
    form is its best near word if that occurs at least ``times`` as often."""
    words = written(words, "words")
    near = near_words(words, page_words)
    is_form: Column = F.col("best_n") >= times * F.col("n")
    rows = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    roots = _followed(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
