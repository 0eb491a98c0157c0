"""Filter audit, line field and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import filter_audit, line_crf, spelling

from .conftest import odd_rows, words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------ filter audit
def brute_audit(rows, labels):
    """Each order applied to the documents one after another."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = [(r[0], r[1] or "", r[2] or "") for r in rows]
    known = [(i, t) for i, t, _ in docs if i is not None]

    def fails(i, t):
        w = SPLIT.findall(t)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(t == u and j < i for j, u in known)}

    judged = [(i, p, fails(i, t)) for i, t, p in docs]
    out, shapley = {}, Counter()
    for part, order in product({p for _, p, _ in judged}, map("".join, permutations("ABCDE"))):
        left = [(i, f) for i, p, f in judged if p == part]
        every = list(left)
        for step, c in enumerate(order, 1):
            gone = [(i, f) for i, f in left if f[c]]
            again = sum(f[c] for _, f in every) - len(gone)
            left = [(i, f) for i, f in left if not f[c]]
            shapley[part, c] += len(gone)
            out[part, order, step] = (len(left), len(gone), again, sum(f[c] and sum(f.values()) == 1 for _, f in every),
                                      sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


LABELS = [(0, 1, 0), (1, 0, 1), (5, 1, 1), (5, 0, 0), (7, 1, None), (9, None, 1), (14, 1, 0), (None, 1, 1), (99, 1, 1)]


def test_audit_equals_filters_applied_in_every_order(odd, empty):
    labels = odd.sparkSession.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rng = random.Random(2)
    more = [(k, words(rng, rng.choice([150, 220]), rng.choice([40, 400])) + rng.choice(["", " A|B", "UPPER CASE " * 9]), "en", "s", 1) for k in range(100, 130)]
    more += [(k + 50, t, *x) for k, t, *x in more[::4]]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        odd.sparkSession.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    got = filter_audit.audit(filter_audit.cells(filter_audit.failures(docs, labels)))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.MEASURES, "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit([*odd_rows(), *more], LABELS)
    assert filter_audit.audit(filter_audit.cells(filter_audit.failures(empty, labels))).count() == 0
    # clashing names beside the documents
    assert filter_audit.failures(odd.withColumn("mask", F.lit(1)).withColumn("quality", F.lit("x")), labels).count() == odd.count()


def test_audit_of_fewer_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 4, 0), ("p", 1, 2, 1, 1), ("p", 3, 7, 0, 2)], "part string, mask int, n long, n_good long, n_toxic long")
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(cells, "AB").collect()}
    assert got == {("AB", 1): (5, 9, 0, 2, 1, 3, 11), ("AB", 2): (5, 0, 7, 0, 0, 0, 7), ("BA", 1): (7, 7, 0, 0, 0, 2, 7), ("BA", 2): (5, 2, 7, 2, 1, 1, 11)}
    with pytest.raises(ValueError):
        filter_audit.audit(cells, "AA")


# ------------------------------------------------------------ line field
def test_marginals_equal_sums_over_all_labellings():
    rng = np.random.default_rng(0)
    gains, stay = [rng.normal(size=n) for n in (1, 4, 2, 6, 4)], np.array([0.7, -0.4])
    good, pairs, log_sum = line_crf.marginals(gains, stay)
    for g, p, own, z in zip(gains, good, pairs, log_sum):
        weight, total, ones, same = 0.0, 0.0, np.zeros(len(g)), np.zeros(2)
        for y in product((0, 1), repeat=len(g)):
            steps = [y[t] for t in range(1, len(g)) if y[t] == y[t - 1]]
            weight = np.exp(g @ y + sum(stay[s] for s in steps))
            total += weight
            ones += weight * np.array(y)
            same += weight * np.array([steps.count(0), steps.count(1)])
        assert np.allclose(p, ones / total) and np.allclose(own, same / total) and np.isclose(z, np.log(total))


def test_training_follows_the_slope_of_the_likelihood():
    """At the fitted weights no small change raises the penalised likelihood."""
    rng = np.random.default_rng(1)
    docs = [rng.normal(size=(n, line_crf.LINE_FEATURES)) + (k % 2) * 0.3 for k, n in enumerate(rng.integers(1, 7, 60))]
    y = np.array([k % 2 for k in range(60)])
    field = line_crf.train(docs, y, rounds=1500, rate=0.02, penalty=0.05)

    def loss(f):
        out = 0.0
        for x, label in zip(docs, y):
            g = line_crf._with_neighbours(f.expanded(x) @ f.weights.T, f.other)
            _, _, z = line_crf.marginals([g], f.stay)
            out += (z[0] - label * g.sum() - f.stay[label] * (len(g) - 1)) / len(g) / len(docs)
        return out + 0.025 * ((f.weights ** 2).sum() + (f.stay ** 2).sum())

    best = loss(field)
    for name, scale in (("weights", 0.02), ("other", 0.05), ("stay", 0.05)):
        for _ in range(10):
            old = getattr(field, name)
            setattr(field, name, old + scale * rng.normal(size=old.shape))
            assert loss(field) > best - 1e-5
            setattr(field, name, old)


def test_line_features_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(4)
    lines = line_crf.lines_of("\n".join(words(rng, rng.randint(1, 30)) + rng.choice(["", ".", "!", " ###"]) for _ in range(80)) + "\n\n \nsame\nsame\n一二 三\U0001f600")
    whole = np.vstack(list(line_crf.line_features(lines)))
    monkeypatch.setattr(line_crf, "BLOCK", 100)
    assert np.array_equal(whole, np.vstack(list(line_crf.line_features(lines)))) and whole.shape == (83, line_crf.LINE_FEATURES)


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = line_crf.predict(docs, line_crf.fit(docs, labels.where(~line_crf.held_out()))).withColumn("held_out", line_crf.held_out())
    rows = got.join(labels, "doc_id").collect()
    assert {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in own]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(3, 0), (4, 0), (5, 1), (9, 1), (9, 0), (14, 1), (None, 1), (15, None)], "doc_id long, quality int")
    field = line_crf.fit(odd, labels)
    got = line_crf.predict(odd, field)
    assert got.count() == len(odd_rows()) and line_crf.predict(empty, field).count() == 0
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].score == by[1].score == by[2].score == 0 and all(0 <= r.score <= 1 for r in by.values())
    # the score of a text does not depend on what is scored beside it
    texts = [r[1] for r in odd_rows()]
    assert np.allclose(line_crf.scores(texts, field), [line_crf.scores([t], field)[0] for t in texts])
    blank = line_crf.fit(empty, labels)
    assert [r.score for r in line_crf.predict(odd, blank).where("doc_id = 5").collect()] == [0, 0]
    only = line_crf.fit(odd, labels.where("doc_id = 5"))
    assert {r.doc_id: r.score for r in line_crf.predict(odd, only).collect()}[3] == 1


def test_the_fit_is_bounded(spark):
    """Two ids on very many rows do not break the bound on rows."""
    docs = spark.range(4000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text of row "), "id").alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    seen = []
    train = line_crf.train
    line_crf.train = lambda d, y: seen.append((len(d), len(y))) or train(d, y, rounds=2)
    try:
        line_crf.fit(docs, labels, max_docs=100)
    finally:
        line_crf.train = train
    assert seen == [(100, 100)]


# ------------------------------------------------------------ spelling
def brute_words(rows):
    n = Counter()
    for r in rows:
        for run in re.findall("[a-zÀ-ÿ]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")):
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_letter(x, y):
    x, y = sorted((x, y), key=len)
    k = next((i for i in range(len(x)) if x[i] != y[i]), len(x))
    return x[k + (len(x) == len(y)):] == y[k + 1:]


def brute_variants(n):
    alphabet = sorted({c for w in n for c in w})

    def near(w):
        if len(w) > 200:
            return [x for x in n if x != w and abs(len(x) - len(w)) <= 1 and one_letter(w, x)]
        out = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in alphabet}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        return [x for x in out if x in n and x != w]

    near_of = {w: near(w) for w in n}
    form = {}
    for w, some in near_of.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near_of[w]), n.get(form[w])) for w in n)


def misspelt(rng, rows):
    base = ["".join(rng.choice("abcdeorsté") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["q" * 40, "ab" * 30]
    out = []
    for k in range(rows):
        text = []
        for _ in range(60):
            w = rng.choice(base[:rng.randint(1, len(base))])
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("aeéz") + w[i:], w[:i] + rng.choice("aeéz") + w[i + 1:]]) or w
            text.append(w if rng.random() < 0.9 else w.upper())
        out.append((k, " ".join(text)))
    return out


@pytest.mark.parametrize("page_words", [spelling.PAGE_WORDS, 3])
def test_variants_equal_brute_force(spark, page_words):
    rows = misspelt(random.Random(8), 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counted = spelling.word_counts(docs)
    assert dict(map(tuple, counted.collect())) == brute_words(rows)
    got = spelling.variants(counted, page_words=page_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute_variants(brute_words(rows))


def test_variants_of_odd_rows(odd, empty):
    rows = odd_rows() * 3
    docs = odd.unionByName(odd).unionByName(odd)
    assert sorted(map(tuple, spelling.variants(spelling.word_counts(docs)).collect())) == brute_variants(brute_words(rows))
    assert spelling.variants(spelling.word_counts(empty)).count() == 0


def test_tables_that_are_handed_on_give_the_same_counts(odd, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 10)
    assert dict(map(tuple, spelling.word_counts(odd, least=1, shortest=2).collect())) == {
        w: n for w, n in all_words(odd_rows()).items()}


def all_words(rows):
    n = Counter()
    for r in rows:
        seed = zlib.crc32(f"{'' if r[0] is None else r[0]}:".encode())
        n.update(spelling.damaged(x, seed) for x in spelling.runs_of(r[1] or ""))
    return {w: k for w, k in n.items() if len(w) >= 2}


def test_chains_are_followed_to_their_end(spark):
    """Counts that double along a chain of words, each near the next."""
    chain = ["a" * k + "b" * (20 - k) for k in range(20)]
    n = {w: 3 * 3 ** k for k, w in enumerate(chain)}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect())) == brute_variants(n)
    assert {r.root for r in got.collect()} == {chain[-1]}


def test_one_apart():
    rng = random.Random(6)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(80)] + ["a" * k for k in (31, 32, 33, 34)] + ["a" * 31 + "b"]
    raw = sorted({w.encode("latin-1") for w in base})
    table, pairs = spelling.Words(raw), [(a, b) for a in range(len(raw)) for b in range(len(raw))]

    def distance_one(x, y):
        return x != y and (y in {x[:i] + x[i + 1:] for i in range(len(x))} or x in {y[:i] + y[i + 1:] for i in range(len(y))}
                           or len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1)

    a, b = map(np.array, zip(*pairs))
    want = [distance_one(raw[i], raw[j]) for i, j in pairs]
    assert table.one_apart(a, b).tolist() == want == [spelling._one_apart(raw[i], raw[j]) for i, j in pairs]
