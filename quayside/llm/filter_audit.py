"""Filter interaction audit: what every order of a set of filters would remove.

Each document has a mask, one bit per filter that it fails. Documents are counted
per part and mask (``cells``), and the audit works on those counts alone: a cell
folds across the array of all orders with SQL higher-order functions (``transform``
over the orders, ``aggregate`` over an order's steps) into one struct per order and
step, weighted with the cell's counts; the cells of a part are then merged by
elementwise sums. With five filters that is 120 orders of five steps, 600 structs
a cell, whatever the input; a part has at most 32 cells.

``failures`` counts words and characters in one pass over the texts and keeps a
narrow row per document. Whether a text occurred before is decided by a 256-bit
digest: one partially aggregated minimum of ids per digest, of which only those of
two or more rows are joined back.

Defined cases. Null and empty texts have no words; they fail ``few_words`` alone
and are copies of one another. A row with a null id is no copy and makes none;
rows repeated with one id are not copies of each other. Of labels repeated for an
id the largest counts; a null label, or none, counts as 0. A null part is the
empty string. An empty table gives an empty result. Only the named columns are
read, so other names cannot clash.
"""

from __future__ import annotations

from itertools import permutations
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import SPACE_CLASS, written

LETTERS = "ABCDE"
MOST_FILTERS = 7  # 5,040 orders; the number of structs of a cell grows as n * n!
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> list[Column]:
    """The four filters that a text decides alone, in the order of LETTERS."""
    words = F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, ascii_uppercase, ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * upper > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per document: part, mask (bit k: fails filter k of LETTERS), good, toxic."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((fails.cast("int") * (1 << k) for k, fails in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = written(rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-masks")

    first = (rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    first = written(first, "first-copies")  # a bare exchange on both sides below, so a hot digest can be split
    known = labels.select(F.col(id_col).alias("id"), "quality", "toxic").where(F.col("id").isNotNull())
    known = written(known.groupBy("id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "labels")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int") * (1 << LETTERS.index("E"))
    one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).alias(c)
    return (rows.join(first, "digest", "left").select("id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))
            .join(known, "id", "left").select("part", "mask", one("quality").alias("good"), one("toxic")))


def cells(failed: DataFrame) -> DataFrame:
    """Counts of documents (all, good, toxic) per part and mask."""
    return failed.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))


def _folded(orders: Column, letters: str) -> Column:
    """A cell's structs, order by order and step by step."""
    bit_of = F.create_map(*[x for k, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << k))])
    zero = F.lit(0).cast("long")

    def of_order(order: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            bit = F.element_at(bit_of, F.substr(order, k, F.lit(1)))
            fails, here = F.col("mask").bitwiseAND(bit) != 0, state["standing"]
            out = F.struct(
                F.when(here & ~fails, F.col("n")).otherwise(zero).alias("kept"),
                F.when(here & fails, F.col("n")).otherwise(zero).alias("removed"),
                F.when(~here & fails, F.col("n")).otherwise(zero).alias("redundant"),
                F.when(F.col("mask") == bit, F.col("n")).otherwise(zero).alias("unique_fails"),
                F.when(here & fails, F.col("n_good")).otherwise(zero).alias("good_lost"),
                F.when(here & fails, F.col("n_toxic")).otherwise(zero).alias("toxic_lost"))
            return F.struct((here & ~fails).alias("standing"), F.concat(state["out"], F.array(out)).alias("out"))

        kind = "array<struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">>"
        start = F.struct(F.lit(True).alias("standing"), F.array().cast(kind).alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(letters))), start, step, lambda s: s["out"])

    return F.flatten(F.transform(orders, of_order))


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, ``filter_order`` and ``step`` from ``cells``. ``shapley``
    is what the step's filter removes, summed over all orders."""
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters, each with a letter of its own")
    names = ["".join(p) for p in permutations(letters)]
    orders = F.array(*map(F.lit, names))
    folded = counted.select("part", _folded(orders, letters).alias("folded"))
    added = lambda x, y: F.struct(*((x[m] + y[m]).alias(m) for m in MEASURES))
    # a part has at most 2 ** filters cells, so its list is bounded
    of_part = folded.groupBy("part").agg(F.collect_list("folded").alias("cells"))
    total = F.aggregate(F.slice("cells", 2, 1 << len(letters)), F.element_at("cells", 1), lambda a, c: F.zip_with(a, c, added))
    of_part = of_part.select("part", total.alias("total"))
    at = lambda k: F.element_at(orders, (F.floor(k / len(letters)) + 1).cast("int"))
    rows = of_part.select("part", F.posexplode("total").alias("k", "v")).select(
        "part", at(F.col("k")).alias("filter_order"), (F.col("k") % len(letters) + 1).cast("int").alias("step"), "v.*")
    rows = rows.withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))
    shares = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "filter"]).select("part", "filter_order", "step", *MEASURES, "shapley")
