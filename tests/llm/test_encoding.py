"""Encoders, token files, packing, mixing, attribution, archives, classifiers and
the pipeline against uncut encoding, round trips and plain loops."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quayside.llm import attribution, langid, mixing, packing, rans, token_files, tokens, toxicity, warc

from .conftest import odd_rows, words

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXT = st.text(st.sampled_from(list("abZéß'’ \t\n\r\x0b\x1c\x85\xa0 ᠎　.,!?#0123½ªґжא漢́🙂<|>_-sdlmtrev")), max_size=60)


def encoders(path, spaces):
    text = open(path, encoding="utf-8").read()
    return tokens.Encoder(text, spaces), tokens.SpanEncoder(text, spaces)


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_pieces_encode_like_whole_texts(path, spaces):
    own, spans = encoders(path, spaces)

    @settings(max_examples=1500, deadline=None)
    @given(TEXT)
    def check(text):
        whole = own.tokenizer.encode(text, add_special_tokens=False)
        assert np.frombuffer(own.ids(text), "<u4").tolist() == whole.ids
        assert [tuple(x) for x in spans.spans(text).tolist()] == whole.offsets

    check()
    for r in odd_rows()[:9]:
        assert np.frombuffer(own.ids(r[1]), "<u4").tolist() == own.tokenizer.encode(r[1] or "", add_special_tokens=False).ids
    assert own.ids("<|endoftext|>") == own.ids("<|endo") + own.ids("ftext|>") or len(own.ids("<|endoftext|>")) > 4


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_special_tokens_as_a_fresh_tokenizer_has_them(path, spaces, spark):
    from tokenizers import Tokenizer

    fresh, file_text = Tokenizer.from_file(path), open(path, encoding="utf-8").read()
    own, spans = tokens.Encoder(file_text, spaces, special=True), tokens.SpanEncoder(file_text, spaces, True)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", "see", "é", "ß漢", " ", "  ", "\n", "'s", "1", "!", "<|", "-", "\u0301", "\x1c"]

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(st.sampled_from(parts), max_size=12).map("".join))
    def check(text):
        whole = fresh.encode(text, add_special_tokens=False)
        assert np.frombuffer(own.ids(text), "<u4").tolist() == whole.ids
        assert [tuple(x) for x in spans.spans(text).tolist()] == whole.offsets

    check()
    texts = ["see <|endoftext|> here", "plain", "a<|startoftext|>b<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {k: len(fresh.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert {r.doc_id: r.length - 1 for r in packing.packed_documents(docs, path, spaces=spaces).collect()} == want
    counts = Counter()
    for r in attribution.attribute(docs, path, spaces=spaces).collect():
        counts[r.doc_id] += r.n_tokens
    assert counts == want
    if spaces:
        files = token_files.read(spark, token_files.write(docs, path)).collect()
        assert {r.doc_id: r.n_tokens for r in files} in (want, {k: n + 1 for k, n in want.items()})


def test_attribution_of_more_rows_than_a_slice(spark):
    docs = spark.range(300).coalesce(1).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    got = attribution.attribute(docs, BYTE).collect()
    assert {r.doc_id for r in got} == set(range(300))


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_pieces_learned_together_encode_like_pieces_alone(path, spaces):
    own, _ = encoders(path, spaces)
    rng = random.Random(7)
    texts = [r[1] for r in odd_rows()[:14] if len(r[1] or "") < 5000] + [words(rng, 50, 2000).title() for _ in range(30)] + ["a\x1cb", "ſ ſtop", "!", "\n"]
    got = own.ids_of(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    odd_one, _ = encoders(path, spaces)
    odd_one.separator_id = 3  # a separator that is not found: pieces go one by one
    assert odd_one.ids_of(texts) == got


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 50)
    own, _ = encoders(BYTE, True)
    rng = random.Random(0)
    for _ in range(60):
        text = words(rng, 40, 2000)
        assert np.frombuffer(own.ids(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(own.known) <= 90 and len(own.known.old) <= 90


def test_rans_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 1025, 70_000):
        ids = np.minimum(rng.zipf(1.2, n), 50_000).astype(np.uint32)
        table = rans.Table.of(rans.normalised(np.bincount(ids, minlength=3)))
        data = rans.encode(ids, table)
        assert (rans.decode(data, n, table) == ids).all()
        if n > 2000:
            broken = bytearray(data)
            broken[8 * rans.LANES + 100] ^= 1
            assert not np.array_equal(_or_none(lambda: rans.decode(bytes(broken), n, table)), ids)
    assert rans.normalised(np.array([5, 0, 1])).sum() == 1 << rans.BITS


def _or_none(f):
    try:
        return f()
    except (ValueError, IndexError):
        return None


def test_token_files(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 5000)  # the long text spans many blocks
    own, _ = encoders(BYTE, True)
    folder = token_files.write(odd, BYTE, files=3)
    got = [tuple(r) for r in token_files.read(spark, folder, with_ids=True).collect()]
    want = Counter()
    for r in odd_rows():
        ids = own.ids(r[1]) + np.array([2], "<u4").tobytes()
        want[(r[0], len(ids) // 4, zlib.crc32(ids), ids)] += 1
    assert Counter((d, n, crc, bytes(x)) for d, _, n, crc, x in got) == want
    at = 0
    for d, start, n, _, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    assert token_files.read(spark, token_files.write(empty, BYTE)).count() == 0


def test_token_files_of_one_id_on_many_rows(spark, monkeypatch):
    """400 texts under one id: one order whatever the partitioning, several files,
    and index bytes that are read once per document."""
    monkeypatch.setattr(token_files, "BLOCK", 300)
    rng = random.Random(4)
    rows = [(7, words(rng, rng.choice([0, 1, 30, 900]))) for _ in range(400)] + [(None, "a b"), (3, None)]
    found = []
    for n in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        folder = token_files.write(docs, BYTE, files=4)
        assert sum(r["docs"] > 20 for r in spark.read.parquet(f"{folder}/manifest").collect()) >= 3
        found.append(sorted(map(tuple, token_files.read(spark, folder, with_ids=True).collect()), key=lambda r: r[1]))
    assert found[0] == found[1] and len(found[0]) == 402
    asked = []
    for k in range(4):
        for docs_at, first, last, own, points in token_files._units(f"{folder}/part-{k:06d}.tok".removeprefix("file:")):
            asked += [(k, d) for d in range(first, last)]
            assert len(points) // token_files._POINT.itemsize >= own
    assert len(asked) == len(set(asked)) == 402


def test_damaged_token_files_are_noticed(spark, tmp_path):
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    folder = str(tmp_path / "files")
    token_files.write(docs, BYTE, folder, files=1)
    name = tmp_path / "files" / "part-000000.tok"
    whole = name.read_bytes()
    points, n_docs, docs_at = token_files._points(*token_files.opened(str(name)))
    for at in (docs_at + 5, docs_at + n_docs * token_files._DOC.itemsize + 3, 40):
        broken = bytearray(whole)
        broken[at] ^= 1
        name.write_bytes(bytes(broken))
        with pytest.raises(Exception):
            token_files.read(spark, folder).collect()
    name.write_bytes(whole)
    assert token_files.read(spark, folder).count() == 50


def test_ids_wider_than_16_bits(spark, monkeypatch):
    monkeypatch.setattr(token_files, "id_width", lambda path, *ids: "<u4")
    docs = spark.range(30).selectExpr("id AS doc_id", "concat('words ', id) AS text")
    got = token_files.read(spark, token_files.write(docs, BYTE, end_id=70_000), with_ids=True).collect()
    own, _ = encoders(BYTE, True)
    assert {r.doc_id: bytes(r.ids) for r in got} == {k: own.ids(f"words {k}") + np.array([70_000], "<u4").tobytes() for k in range(30)}
    assert tokens.id_width(BYTE, 2) == "<u2" and tokens.id_width(BYTE, 70_000) == "<u4"


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_and_gapless(lengths):
    counts = Counter(lengths)
    runs = packing.plan(counts, 40)
    seqs, ranks = {}, {n: [] for n in counts}
    for n, lo, hi, first, offset in runs:
        ranks[n] += range(lo, hi)
        for k in range(hi - lo):
            seqs.setdefault(first + k, []).append((offset, n))
    assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items())
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 40
    assert len(seqs) == brute_best_fit(lengths, 40)


def test_packing(spark, odd, empty):
    own, _ = encoders(WORD, False)
    pieces = packing.written(packing.cut_pieces(odd, WORD, capacity=64), "test-pieces")
    packed = packing.pack(pieces, 64)
    want = Counter()
    for r in odd_rows():
        ids = own.ids(r[1]) + np.array([1], "<u4").tobytes()
        want.update((r[0], k, s // 4, ids[s:s + 256]) for k, s in enumerate(range(0, len(ids), 256)))
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == want
    seqs = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert seqs[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    assert sum(map(len, seqs.values())) == sum(len(r.ids) for r in rows) and max(map(len, seqs.values())) <= 256
    assert packing.packed_documents(empty, WORD).count() == 0


def test_mixing_targets_and_fit():
    assert mixing.targets([100, 100], [5, 1], 150) == [125, 25]
    assert mixing.targets([10, 100, 100], [5, 2, 1], 300) == [20, 280 * 2 / 3, 280 / 3]
    assert mixing.targets([0, 0], [1, 1], 0) == [0, 0]
    rng = np.random.default_rng(1)
    for _ in range(100):
        sizes = np.unique(rng.integers(1, 400, rng.integers(1, 60)))
        counts = rng.integers(1, 30, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        take = mixing.fit(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        if len(sizes) > 10:
            assert abs(int((take * sizes).sum()) - budget) <= sizes[0]


def test_mixing_takes_lengths_by_share():
    """Mostly distinct lengths: the lengths taken follow those of the source,
    also near the end, and the sum still meets the budget."""
    rng = np.random.default_rng(2)
    for k in range(40):
        sizes, counts = np.unique(np.ceil(rng.lognormal(5.5, 1, 600)).astype(np.int64), return_counts=True)
        total = int((sizes * counts).sum())
        ratio = float(rng.uniform(0.3, 0.9))
        take = mixing.fit(sizes, counts, int(total * ratio), seed=k)
        assert int((take * sizes).sum()) == int(total * ratio) and (take <= counts).all()
        share = take.sum() / counts.sum()
        assert abs(share - ratio) < 0.1
        assert np.abs(np.cumsum(take) - share * np.cumsum(counts)).max() < 0.08 * take.sum()
    # a document that the smaller ones cannot make up for is taken
    sizes, counts = np.array([1, 2, 3, 60_000]), np.array([3000, 3000, 3000, 1])
    for k in range(10):
        assert int((mixing.fit(sizes, counts, 70_000, seed=k) * sizes).sum()) == 70_000


def test_mixing(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows()) and mixing.mix(empty).count() == 0
    size = {i: len([w for w in (t or "").replace("\x0b", " ").split(" ") if w]) for i, t, *_ in odd_rows()}
    assert all(r["size"] >= 0 and r.taken in (0, r["size"], 2 * r["size"]) for r in rows) and size
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
    for (source, target), own in by.items():
        assert target <= 2 * source and sum(r["size"] for r in own) % max(source, 1) == 0
    again = mixing.mix(odd).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_attribution(odd, empty):
    own = encoders(BYTE, True)[1]
    text = "one two\n\n\nthree  four\n é"
    for rule in attribution.RULES:
        total, crossing = attribution.allocate(own.spans(text), attribution.lines(text), rule)
        assert abs(total.sum() - len(own.spans(text))) < 1e-9 and total[-1] == 0
    spans, sections = np.array([[0, 3], [3, 9], [9, 12]]), np.array([[0, 5], [5, 5], [5, 10]])
    assert attribution.allocate(spans, sections, "first")[0].tolist() == [2, 0, 1, 0]
    assert attribution.allocate(spans, sections, "most")[0].tolist() == [1, 0, 1, 1]
    split, crossing = attribution.allocate(spans, sections, "split")
    assert np.allclose(split, [1 + 2 / 6, 0, 4 / 6 + 1 / 3, 2 / 3]) and crossing.tolist() == [1, 0, 2, 1]
    got = attribution.attribute(odd, BYTE, "most")
    want = Counter()
    for r in odd_rows():
        want[r[0]] += len(own.spans(r[1]))
    have = Counter()
    for r in got.collect():
        have[r.doc_id] += r.n_tokens
    assert +have == +want and attribution.attribute(empty, BYTE).count() == 0


def test_warc(spark):
    big = "é<p>" * 5000
    pages = [(1, "http://a", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99),
             (7, "u", "y" * 100), (None, "u", "y" * 100), (9, "a\r\nb", "y" * 100), (1, "http://a", big), (10, "u", "0\r\n\r\n" * 60)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, record_type string")
    folder = warc.write(df, segment_bytes=700, chunk_bytes=64, file_bytes=3000)
    got = warc.read(spark, folder, with_payload=True).collect()
    want = Counter()
    for i, _, t in pages:
        b = (t or "").encode()
        same = [j for j, _, u in pages if u == t and j is not None] if len(b) >= 100 else []
        other = min(same) if same and min(same) != i else None
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "response" if other is None else "revisit", other, b if other is None else None)] += 1
    assert Counter((*r[:5], None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert warc.read(spark, warc.write(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_language(spark, odd, empty):
    rng = random.Random(1)
    letters = {"aa": "abcde", "bb": "éßüöä", "cc": "xyzwv"}
    docs = [(i, " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(12)), lang)
            for i, (lang, a) in enumerate(sorted(letters.items()) * 60)]
    df = spark.createDataFrame(docs + [(999, None, "aa"), (998, "1 2 ..", "aa"), (997, "abcd", None)], "doc_id long, text string, lang string")
    langs, matrix = langid.learn(df.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict(df, langs, matrix).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in docs)
    assert got[999].lang_pred == got[998].lang_pred == "und" and got[999].score == 0
    # a text's scores do not depend on its neighbours or on blocks
    texts = ["abc abc", "é" * (langid.BLOCK + 5), "xyz"]
    alone = np.vstack([langid.posteriors([t], matrix) for t in texts])
    assert np.allclose(langid.posteriors(texts, matrix), alone)
    assert langid.predict(odd, langs, matrix).count() == len(odd_rows())
    nothing = langid.learn(empty)
    assert {r.lang_pred for r in langid.predict(odd, *nothing).collect()} == {"und"}


def test_toxicity(spark, odd, empty):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(300):
        toxic, junk = i % 5 == 0, i % 7 == 0
        text = words(rng, 40) + (" vilest, " if toxic else "") + (" $$spam " if junk else "")
        docs.append((i, text))
        labels.append((i, int(toxic), int(junk)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, a int, b int")
    model = toxicity.fit(docs, labels, ["a", "b"])
    got = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    assert all(got[r.doc_id].a == bool(r.a) and got[r.doc_id].b == bool(r.b) for r in labels.collect())
    assert [len(m.earlier) for m in model.models] == [0, 1]
    assert toxicity.predict(odd, model).count() == len(odd_rows())
    none = toxicity.fit(empty.select("doc_id", "text"), labels.limit(0), ["a", "b"])
    assert all(not r.a and not r.b for r in toxicity.predict(odd, none).collect())
