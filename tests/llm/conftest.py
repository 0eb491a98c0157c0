import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, rank string, "
          "key long, ids string, label int, component long, sequence_id string, start string, text_sha256 string, n int")


def words(rng, n, vocabulary=400):
    return " ".join(rng.choice(VOCABULARY[:vocabulary]) for _ in range(n))


_r = random.Random(3)
VOCABULARY = ["".join(_r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(_r.randint(1, 9))) for _ in range(2000)]


def odd_rows():
    """Nulls in any column, empty and white-space texts, a very long text, ties,
    copies and repeated rows."""
    rng = random.Random(1)
    base, long_ = words(rng, 120, 2000), words(rng, 60_000, 2000)
    near = base.split()
    near[5] = "changed"
    texts = [None, "", " \n\t ", "one", "two words", base, base.upper() + "", base, " ".join(near), long_, long_ + " end",
             "x" * 70_000, "É é a b", "a\x1cb c", words(rng, 80), words(rng, 80), "line\nline\nother\n\nline", "1 2 3 ..."]
    langs, sources = [None, "en", "fr"], [None, "s1", "s2", "s10"]
    rows = [(k, t, langs[k % 3], sources[k % 4], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(None, base, "en", "s1", 1), (None, None, None, None, None), rows[5], rows[1], rows[14]]
    extra = (True, 7, "r", 1, "i", 2, 3, "q", "s", "t", 4)
    none = (None,) * len(extra)
    return [r + (extra if i % 2 else none) for i, r in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
