"""Exact dedup, quality cascade and similarity join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quayside.llm import exact_dedup, quality, sketch_join, sketches
from quayside.llm.components import components

from .conftest import VOCABULARY, odd_rows, words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(odd, keep):
    got = sorted(map(tuple, exact_dedup.exact_groups(odd, keep=keep).collect()), key=str)
    groups = defaultdict(list)
    for r in odd_rows():
        groups[lowered(r[1])].append(r[0])
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        k = (min if keep == "smallest" else max)(known, default=None)
        want += [(i, k, len(ids), i == k, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert got == sorted(want, key=str)


def test_exact_hash_collisions_are_told_apart(odd):
    """With a hash that is the same for all texts, bytes still decide."""
    by = exact_dedup.exact_groups(odd, hashed=lambda c: F.unhex(F.lit("00"))).collect()
    assert sorted(map(tuple, by), key=str) == sorted(map(tuple, exact_dedup.exact_groups(odd).collect()), key=str)


def test_exact_empty_and_columns(odd, empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    texts = {lowered(r.text) for r in kept.collect()}
    assert texts == {lowered(r[1]) for r in odd_rows()}
    # one text under one id twice, and two texts under one id
    df = odd.sparkSession.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.drop_copies(df).collect())) == [(1, "a"), (2, "b")]


def brute_features(text):
    text = text or ""
    w = SPLIT.findall(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPLIT.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_features_and_order(odd, empty):
    rng = random.Random(5)
    texts = [words(rng, n, 3) + "\n" + "#| x" * (n % 4) + "\na\na" for n in range(0, 60, 3)]
    for t in texts:
        f = quality.Features(t)
        assert tuple(getattr(f, x) for x in quality.REPORTED) == brute_features(t)
    got = quality.cascade(odd, report=quality.REPORTED)
    assert sorted((tuple(r)[0], *tuple(r)[3:]) for r in got.where("doc_id IS NOT NULL").collect()) == sorted(
        (r[0], *brute_features(r[1])) for r in odd_rows() if r[0] is not None)
    assert got.count() == len(odd_rows()) and quality.cascade(empty).count() == 0
    # any order of the rules gives the same verdict
    back = quality.cascade(odd, order=list(quality.RULES)[::-1]).select("doc_id", "kept")
    assert sorted(map(str, back.collect())) == sorted(map(str, got.select("doc_id", "kept").collect()))


def test_quality_keeps_and_ranks(odd, spark):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    verdict = quality.cascade(odd).where("kept").count()
    assert kept.count() == verdict
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, words(rng, 100 if i % 10 else 3)) for i in range(200)], "doc_id long, text string")
    ranked = quality.plan(docs, sample_rows=100)
    assert {r.name for r, _, _ in ranked} == {r.name for r in quality.RULES}
    rate = [hit / max(cost, 1e-9) for _, cost, hit in ranked]
    assert rate == sorted(rate, reverse=True) and ranked[0][2] > 0


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = SPLIT.findall(lowered(t))
        out.setdefault(i, set()).update({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    return out


def brute_components(rows, size, percent):
    sets = sets_of([r for r in rows if r[0] is not None], size)
    ids, parent = list(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (1, 60)])
def test_similar_groups_against_brute_force(spark, size, percent):
    """Chains of near copies at every distance around the threshold, on long and
    short texts."""
    rng, rows = random.Random(size), []
    for group in range(14):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([1, 3, 6, 8, 20, 60, 130, 300]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            if rng.random() < 0.3:
                copy = copy[: rng.randint(max(1, int(0.8 * len(copy))), len(copy))]
            if rng.random() < 0.4:
                base = copy
            rows.append((len(rows) * 7 % 113 + 1000, " ".join(copy)))
    got = sketch_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute_components(rows, size, percent)


def test_similar_groups_odd_rows(odd, empty):
    got = sketch_join.similar_groups(odd, size=4, percent=85).collect()
    rows = [(r[0], r[1]) for r in odd_rows()]
    want = brute_components(rows, 4, 85)
    assert len(got) == len(rows)
    assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == want
    assert sorted((r[1], r[2]) for r in got if r[0] is None) == [(0, None), (117, None)]
    assert sketch_join.similar_groups(empty).count() == 0
    kept = sketch_join.one_of_each(odd, size=4, percent=85)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()} | {None}


def test_long_words_and_chunks():
    texts = [b"ab cd " * 400_000, b"q" * 2_500_000 + b" tail", b"x y z", None, b"  "]
    for t, w in zip(texts, sketches.words_of(texts)):
        assert len(w) == len((t or b"").split())
    assert set(sketches.words_of([texts[0]])[0].tolist()) == set(sketches.words_of([b"AB cd"])[0].tolist())


def test_parts_bound_the_symmetric_difference():
    import numpy as np
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, rng.integers(0, 30), dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        ka, kb = (sketches.part_keys(np.sort(x), 7, 128) for x in (a, b))
        assert (ka != kb).sum() <= apart
        x, y = (np.unpackbits(sketches.dense_sketch(v)) for v in (a, b))
        assert (x != y).sum() <= apart
        counts = rng.integers(0, 9, 1 << 10).astype(np.uint32)
        if apart < 128:
            assert set(sketches.rarest(ka, counts, apart + 1).tolist()) & set(sketches.rarest(kb, counts, apart + 1).tolist())


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(7, 7), (300, 500), (500, 400)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    alone = {x for x in parent if all(a == b for a, b in links if x in (a, b))}
    assert got == {x: find(x) for x in parent if x not in alone}


def test_wide_sketches_bound_the_symmetric_difference():
    import numpy as np
    rng = np.random.default_rng(9)
    for n in (1, 100, 129, 1000, 5000):
        for other in (n, int(n * 1.17) + 1):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate([x[rng.random(n) < 0.9], rng.integers(0, 1 << 63, max(0, other - n) + n // 10, dtype=np.uint64)])
            x, y = np.unique(x), np.unique(y)
            apart = len(np.setxor1d(x, y))
            got = sketches.sketches_apart(sketches.wide_sketch(x), sketches.wide_sketch(y))
            assert got <= apart and got % 2 == apart % 2 and got == sketches.sketches_apart(sketches.wide_sketch(y), sketches.wide_sketch(x))
            assert len(sketches.wide_sketch(x)) >= len(x) / 2 and sketches.sketches_apart(sketches.wide_sketch(x), sketches.wide_sketch(x)) == 0
    # large unrelated sets are far apart, which 512 bits could not tell
    a, b = (np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) for _ in "ab")
    assert sketches.sketches_apart(sketches.wide_sketch(a), sketches.wide_sketch(b)) > 3000
