"""Exact deduplication by recipes of content-defined chunks.

A text is normalised (each run of the bytes 9-13 and 32 becomes one space) and cut where a rolling hash of its last 32
bytes says so, hence equal texts have equal chunks. Its recipe is the ordered list of short chunk identifiers. Only
texts whose recipe occurs more than once can be copies; their chunks alone travel, once each per task, and are verified:
an identifier that stands for two contents sends all candidates to identifiers of 32 bytes, which are verified again.
After that equal recipes are equal texts, and only recipes are grouped and joined, however long the texts are.

Null texts count as empty; empty texts are copies of each other. Of a group one row stays, the one with the smallest
doc_id; a null doc_id comes last. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GEAR = np.random.default_rng(65537).integers(0, 2**32, 256, dtype=np.uint32)
LEAST, MASK, MOST = 2048, 0xFFF00000, 32768
ID_BYTES = (8, 32)
WHITE = b" \t\n\r\x0b\x0c"


def normalise(text: bytes) -> bytes:
    words = text.split()
    if not words:
        return b" " if text else b""
    return b" " * (text[0] in WHITE) + b" ".join(words) + b" " * (text[-1] in WHITE)


def cuts(text: bytes, least: int = LEAST, most: int = MOST, mask: int = MASK) -> list[int]:
    """Ends of the chunks; between `least` and `most` bytes each but for the last."""
    n = len(text)
    if n <= least:
        return [n]
    rolling = GEAR[np.frombuffer(text, np.uint8)]
    for reach in (1, 2, 4, 8, 16):
        longer = rolling.copy()
        longer[reach:] += rolling[:-reach] << np.uint32(reach)
        rolling = longer
    marks = np.flatnonzero((rolling & np.uint32(mask)) == 0) + 1
    out, last = [], 0
    while n - last > least:
        i = int(np.searchsorted(marks, last + least))
        last = min(n, last + most, int(marks[i]) if i < len(marks) else n)
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunks(text: bytes) -> Iterator[bytes]:
    begin = 0
    for end in cuts(text):
        yield text[begin:end]
        begin = end


def identifier(chunk: bytes, width: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=width).digest()


def recipes(docs: DataFrame, width: int, row: str | None = None) -> DataFrame:
    """doc_id, row (unique; that column if named), key of the raw text, text_sha256 and recipe of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            sha, recipe = [], []
            for text in batch.column("text"):
                text = normalise((text.as_py() or "").encode())
                sha.append(hashlib.sha256(text).hexdigest())
                recipe.append(b"".join(identifier(c, width) for c in chunks(text)))
            rows = pa.array(range(row, row + len(sha)), pa.int64()) if batch.column("row").null_count else batch.column("row")
            row += len(sha)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows, batch.column("key"), pa.array(sha, pa.string()), pa.array(recipe, pa.binary())], ["doc_id", "row", "key", "text_sha256", "recipe"])
        common.released()

    own = F.col(row) if row else F.lit(None).cast("long")
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), common.text_key().alias("key"), own.alias("row"))
    return columns.mapInArrow(run, "doc_id long, row long, key long, text_sha256 string, recipe binary")


def ambiguous(docs: DataFrame, width: int) -> DataFrame:
    """Identifiers that stand for more than one content among the chunks of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            ids, contents = [], []
            for text in batch.column("text"):
                for chunk in chunks(normalise((text.as_py() or "").encode())):
                    key = identifier(chunk, width)
                    if seen.get(key) != chunk:
                        seen[key] = chunk
                        ids.append(key)
                        contents.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(contents, pa.binary())], ["id", "content"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "id binary, content binary")
    return found.groupBy("id").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).filter("lo <> hi").select("id")


def verified_recipes(docs: DataFrame, widths: tuple[int, ...] = ID_BYTES, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Written recipes that are equal only for equal texts, and those that occur more than once, with the row that stays and their number."""
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("best")
    for width in widths:
        made = common.materialise(recipes(docs, width, row), "recipes")
        shared = common.materialise(made.groupBy("recipe").agg(best, F.count("*").alias("n")).filter("n > 1"), "groups")
        # Rows are found again by their texts, whether they have a doc_id or not.
        keys = common.small(common.materialise(made.join(common.small(shared.select("recipe")), "recipe", "left_semi").select("key").distinct(), "keys"))
        candidates = docs.select(F.col("text").cast("string").alias("text")).withColumn("key", common.text_key()).join(keys, "key", "left_semi")
        if ambiguous(candidates, width).limit(1).count() == 0:
            return made, shared
        common.discard(made)
    raise ValueError(f"two different chunks have the same {8 * widths[-1]} bits")


def decided(docs: DataFrame, widths: tuple[int, ...] = ID_BYTES, row: str | None = None) -> DataFrame:
    """A row per row of docs: doc_id, row, keep_id, group_size, kept, text_sha256."""
    made, shared = verified_recipes(docs, widths, row)
    joined = made.join(common.small(shared), "recipe", "left")
    return joined.select("doc_id", "row", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("row") == F.coalesce("best.row", "row")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, widths: tuple[int, ...] = ID_BYTES) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return decided(docs, widths).drop("row")


def keep_one(docs: DataFrame, widths: tuple[int, ...] = ID_BYTES) -> DataFrame:
    """The rows of docs that stay, one for each text, with all their columns; decided row by row, whatever doc_ids repeat."""
    own, row = common.numbered(docs, "documents")
    gone = common.materialise(decided(own, widths, row).filter(~F.col("kept")).select(F.col("row").alias(row)), "gone")
    return own.join(common.small(gone), row, "left_anti").select(docs.columns)
