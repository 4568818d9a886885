"""Token counts of the sections of documents, from one encoding of each whole document.

Tokens have character spans in the document (a token that holds part of a character spans that character). Sections have
spans too; tokens are joined to the sections that they overlap. A token that crosses a boundary is allocated whole by one
of three rules: `first` (the section of its first character, the default), `last`, or `most` (the section that
holds most of its characters, the earlier one if equal). So counts of sections that cover the text add up to its tokens.

Sections of a text are its lines with their line feeds unless the caller gives a column of spans, array<struct<begin,
end>> in characters, ordered and without overlap; tokens outside all spans count to none. Null and empty texts have one empty
section without tokens. Rows with equal doc_id are counted each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import Codec

RULES = ("first", "last", "most")


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(chars == 10) + 1
    if not len(ends) or ends[-1] < len(chars) or not len(chars):
        ends = np.append(ends, len(chars))
    return np.concatenate([[0], ends[:-1]]), ends


def token_spans(text: str, ids: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token."""
    raw = np.frombuffer(text.encode(), np.uint8)
    at = np.cumsum((raw & 0xC0) != 0x80)  # number of the character that holds a byte, from 1
    ends = np.cumsum(widths[ids])
    return at[ends - widths[ids]] - 1, at[ends - 1]


def allocate(first: np.ndarray, end: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section: an interval join over ordered spans."""
    n = len(begins)
    low = np.searchsorted(ends, first, "right")  # first section that ends after the token begins
    high = np.searchsorted(begins, end, "left") - 1  # last section that begins before the token ends
    hit = low <= high
    low, high, first, end = low[hit], high[hit], first[hit], end[hit]
    crossing = (low < high) | (first < begins[low]) | (end > ends[high])
    if rule == "first":
        owner = low
    elif rule == "last":
        owner = high
    else:
        owner = low.copy()
        best = np.minimum(end, ends[low]) - np.maximum(first, begins[low])
        for step in range(1, int((high - low).max(initial=0)) + 1):
            other = np.minimum(low + step, high)
            share = np.minimum(end, ends[other]) - np.maximum(first, begins[other])
            better = (low + step <= high) & (share > best)
            owner[better], best[better] = other[better], share[better]
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count(docs: DataFrame, rank_path: str, pattern: str, spans: str | None = None, rule: str = "first") -> DataFrame:
    """doc_id, section, begin, end (characters), n_tokens, n_crossing, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(rank_path, pattern)
        for whole in batches:
            for batch in common.slices(whole):
                out: list[list[np.ndarray]] = [[] for _ in range(6)]
                docs_of, sizes = [], []
                given = batch.column("spans").to_pylist() if spans else [None] * batch.num_rows
                for doc, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), given):
                    text = text or ""
                    ids = np.array(codec.encode(text), np.int64)
                    if spans:
                        begins, ends = (np.array([s[k] for s in own or []], np.int64) for k in ("begin", "end"))
                    else:
                        begins, ends = lines(text)
                    if len(ids) and len(begins):
                        n, crossing = allocate(*token_spans(text, ids, codec.widths), begins, ends, rule)
                    else:
                        n = crossing = np.zeros(len(begins), np.int64)
                    for column, values in zip(out, (np.arange(len(begins)), begins, ends, n, crossing, np.full(len(begins), len(ids)))):
                        column.append(values)
                    docs_of.append(doc)
                    sizes.append(len(begins))
                ids_column = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in out]
                yield pa.RecordBatch.from_arrays([ids_column, columns[0].cast(pa.int32()), *columns[1:]], ["doc_id", "section", "begin", "end", "n_tokens", "n_crossing", "doc_tokens"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if spans:
        columns.append(F.col(spans).cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))
    return docs.select(*columns).mapInArrow(run, "doc_id long, section int, begin long, end long, n_tokens long, n_crossing long, doc_tokens long")
