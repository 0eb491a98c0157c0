"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups.

DataFrame functions only. Texts are equal when they are identical after
lower-casing A-Z (``normalise``).

Plan. One aggregation is keyed by (md5, text): its map side folds the copies of
a task into one row before the shuffle, so a text that holds a third of all rows
moves at most once per task, and because the text itself is part of the key the
grouping compares bytes, so two texts that share a hash stay apart. Only groups
of two or more rows are written (hash, keeper, size; no text). A second, narrow
scan joins each row's digests to them; singletons find no partner and keep
themselves. The written side is a bare exchange, so adaptive execution
broadcasts it when it is small and splits a hot hash when it is not.

Defined cases. Null text counts as empty. A null id never becomes the keeper
unless all ids of the group are null; rows repeated with one id count one by one
in ``group_size`` and are all marked ``kept`` if that id is the keeper. An empty
table gives an empty result. Other columns are never read, so their names cannot
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import lower_ascii, written


def normalise(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "smallest", hashed=content_hash) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256`` (hex, of the normalised text). ``keep`` names which id of a
    group stays, ``smallest`` or ``largest``."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    pick = F.min if keep == "smallest" else F.max
    text = normalise(F.col(text_col))
    groups = (docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
              .select("__id", "__text", hashed(F.col("__text")).alias("__h"))
              .groupBy("__h", "__text")
              .agg(pick("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .where(F.col("group_size") > 1)
              .select("__h", F.unhex(F.sha2("__text", 256)).alias("__sha"), "keep_id", "group_size"))
    groups = written(groups, "exact-groups")
    rows = (docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
            .select("__id", hashed(F.col("__text")).alias("__h"),
                    F.unhex(F.sha2("__text", 256)).alias("__sha")))
    joined = rows.join(groups, ["__h", "__sha"], "left")
    single = F.col("group_size").isNull()
    keep_id = F.when(single, F.col("__id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest") -> DataFrame:
    """The rows that stay, with all their columns. Rows go by id and digest, so
    two texts under one id are judged apart; rows with a null id stay."""
    gone = (exact_groups(docs, id_col, text_col, keep).where(~F.col("kept"))
            .select(F.col(id_col).alias("__gone"), F.col("text_sha256").alias("__sha")))
    digest = F.sha2(normalise(docs[text_col]), 256)
    return docs.join(gone, (docs[id_col] == gone["__gone"]) & (digest == gone["__sha"]), "left_anti")
