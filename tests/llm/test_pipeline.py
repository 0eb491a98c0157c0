"""The pipeline, stage by stage, against plain loops on the smallest documents."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from quayside.llm import mixing, quality, tokens
from quayside.llm.common import written

from .test_dedup_quality import brute_components, lowered

BASE = "/root/testdata/sf0.001"


def test_stages_against_plain_loops(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns, kept, names = docs.columns, {}, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, BASE), f"test-{name}")
        names.append(name)
        kept[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert names == ["quality_rules", "exact_dedup", "sketch_join", "source_mix", "best_fit_packing"]
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()]
    rows = [r for r in rows if not any(x.rejects(quality.Features(r[1])) for x in quality.RULES)]
    assert sorted(r.doc_id for r in kept["quality_rules"]) == sorted(r[0] for r in rows)
    first = {}
    for r in sorted(rows):
        first.setdefault(lowered(r[1]), r)
    rows = list(first.values())
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(r[0] for r in rows)
    groups = brute_components([r[:2] for r in rows], 5, 80)
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    assert sorted(r.doc_id for r in kept["sketch_join"]) == sorted(r[0] for r in rows)
    taken = Counter(r.doc_id for r in kept["source_mix"])
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    size = {s: sum(len(quality.Features(t).words) for _, t, x in rows if x == s) for s in sources}
    goal = mixing.targets([size[s] for s in sources], [mixing.WEIGHTS[k % 3] for k in range(len(sources))], 1.5 * sum(size.values()))
    assert max(taken.values()) <= 2 and set(taken) <= {r[0] for r in rows}
    for s, want in zip(sources, goal):
        own = {i: len(quality.Features(t).words) for i, t, x in rows if x == s}
        got = sum(taken[i] * n for i, n in own.items())
        assert abs(got - want) <= max(own.values())  # a source of few documents has few sums
    encoder = tokens.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), False)
    want = Counter()
    for i, t, _ in rows:
        ids = encoder.ids(t) + np.array([1], "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 16384)):
            want[(i, k, at // 4, len(ids[at:at + 16384]) // 4, zlib.crc32(ids[at:at + 16384]))] += taken[i]
    got = kept["best_fit_packing"]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


def test_registered_with_the_rest():
    import __spark_entry__ as E

    names = list(E.queries())
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert set(E.oracle_sql()) <= set(names)


def test_mixed_takes_every_row_as_planned(spark, odd):
    """Null ids, repeated rows and two texts under one id: each row has the
    copies planned for it, and every source meets its target."""
    rng = np.random.default_rng(5)
    rows = [(None if k % 3 == 0 else k // 2 if k % 3 == 1 else 7, " ".join(["w"] * int(rng.integers(1, 60))) + f" t{k}", f"s{k % 3}")
            for k in range(600)]
    rows += rows[:30]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mixed(docs).collect()
    had, got = Counter(rows), Counter(map(tuple, out))
    assert set(got) <= set(had) and all(got[r] <= 2 * n for r, n in had.items())
    plan = mixing.mix(docs).collect()
    assert len(plan) == len(rows) and len(out) == sum(r.copies for r in plan)
    words_of = Counter()
    for (_, t, s), n in got.items():
        words_of[s] += n * len(t.split())
    names = sorted({r[2] for r in rows})
    size = [sum(len(t.split()) for _, t, s in rows if s == name) for name in names]
    for name, want in zip(names, mixing.targets(size, mixing.WEIGHTS, 1.5 * sum(size))):
        assert abs(words_of[name] - want) <= 2
    again = mixing.mixed(odd).collect()
    assert len(again) == sum(r.copies for r in mixing.mix(odd).collect() if r.taken)
    assert any(r.doc_id is None for r in again)


def test_pipeline_keeps_rows_without_an_id(spark, tmp_path):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    null = docs.doc_id % 3 == 0
    (docs.withColumn("doc_id", F.when(~null, docs.doc_id)).unionByName(docs.where("doc_id < 20"))
     .write.parquet(str(tmp_path / "documents.parquet")))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()
    assert any(r.doc_id is None for r in got) and any(r.doc_id is not None for r in got)
