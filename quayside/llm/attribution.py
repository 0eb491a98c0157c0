"""Token counts of a document's sections by offset-mapped attribution.

A document is encoded once, as a whole, so counts add up to what a model is fed;
encoding sections one by one would cut tokens at their borders. Each token's
character span is then joined to the sections it overlaps (an interval join by
binary search on the section starts, inside the document), and a token that
crosses a border is allocated by ``rule``:

``first``  to the section of its first character;
``most``   to the section with most of its characters, of equal ones the first;
``split``  to all of them, in proportion to the characters.

Characters outside every section count for section -1. Sections are lines
(``lines``), concatenated fields (``fields``), or any array of (start, end) in a
column.

Defined cases. Null and empty texts have no token; a text without sections gives a
row for -1 if it has tokens, else none. Sections must be disjoint and ascending;
empty ones get 0. A token with an empty span counts where it stands. Null ids and
repeated rows are treated like others. Texts are read whole. Only the id, text and
section columns are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.tokens import SpanEncoder, encoder, vocabulary

RULES = ("first", "most", "split")


def lines(text: str) -> np.ndarray:
    """The text's lines with their line ends: they cover it without gaps."""
    if not text:
        return np.empty((0, 2), np.int64)
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.column_stack([[0, *ends[:-1]], ends]).astype(np.int64)


def fields(columns: list[str], between: str = "\n") -> tuple[Column, Column]:
    """The text of several columns joined by ``between`` (null: empty) and their
    places in it, as an array of (start, end)."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    places, start = [], F.lit(0)
    for p in parts:
        end = start + F.char_length(p)
        places.append(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        start = end + F.lit(len(between))
    return F.concat_ws(between, *parts), F.array(*places)


def allocate(spans: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section (the last entry: outside of all) and, likewise, how many
    tokens that cross a border the section takes part in."""
    n, k = len(spans), len(sections)
    total, crossing = np.zeros(k + 1), np.zeros(k + 1, np.int64)
    if not n:
        return total, crossing
    # Segments: each section and the gaps around them, so that all is covered.
    edges = np.unique(np.concatenate([[0], sections.ravel(), [spans.max() + 1]]))
    owner = np.full(len(edges), k)
    filled = np.flatnonzero(sections[:, 1] > sections[:, 0])
    owner[np.searchsorted(edges, sections[filled, 0])] = filled
    start, end = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    lo = np.searchsorted(edges, start, "right") - 1
    hi = np.searchsorted(edges, end, "left")
    many = hi - lo
    token = np.repeat(np.arange(n), many)
    segment = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(len(token))
    after = np.append(edges[1:], edges[-1])
    chars = np.minimum(end[token], after[segment]) - np.maximum(start[token], edges[segment])
    across = many[token] > 1
    np.add.at(crossing, owner[segment[across]], 1)
    if rule == "split":
        share = chars / (end - start)[token]
        np.add.at(total, owner[segment], share)
    elif rule == "first":
        np.add.at(total, owner[lo], 1)
    else:
        order = np.lexsort((segment, -chars, token))
        best = order[np.unique(token[order], return_index=True)[1]]
        np.add.at(total, owner[segment[best]], 1)
    return total, crossing


def attribute(docs: DataFrame, tokenizer: str, rule: str = "first", sections: str | None = None, spaces: bool = True,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: id, ``section`` (from 0; -1: outside), ``start`` and
    ``end`` (characters), ``n_tokens`` and ``n_crossing`` (tokens that cross one of
    its borders). ``sections`` names a column with an array of (start, end);
    without it, sections are lines."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    file_text = vocabulary(docs.sparkSession, tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SpanEncoder, file_text.value, spaces, True)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                given = part.column(2).to_pylist() if sections else [None] * part.num_rows
                rows, owners = [], []
                for i, (text, places) in enumerate(zip(part.column(1).to_pylist(), given)):
                    if sections:
                        where = np.array([(x["start"], x["end"]) for x in places or []], np.int64).reshape(-1, 2)
                    else:
                        where = lines(text or "")
                    total, crossing = allocate(own.spans(text), where, rule)
                    keep = len(where) + bool(total[-1] or crossing[-1])
                    rows.append(np.column_stack([np.append(np.arange(len(where)), -1), np.vstack([where, [[-1, -1]]]), crossing])[:keep])
                    owners.append((np.full(keep, i), total[:keep]))
                table = np.vstack(rows).astype(np.int64)
                owner, total = (np.concatenate(x) for x in zip(*owners))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner.astype(np.int64))), pa.array(table[:, 0].astype(np.int32)), pa.array(table[:, 1]), pa.array(table[:, 2]),
                     pa.array(total if rule == "split" else total.astype(np.int64)), pa.array(table[:, 3])], names=names)

    wanted = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(sections).alias("sections")] if sections else [])]
    schema = f"id {kind}, section int, start long, end long, n_tokens {'double' if rule == 'split' else 'long'}, n_crossing long"
    return docs.select(*wanted).mapInArrow(run, schema).withColumnRenamed("id", id_col)
