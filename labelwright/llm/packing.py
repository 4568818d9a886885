"""Best-fit packing of token sequences.

Documents are encoded, closed by an end id and cut into pieces of at most `capacity` tokens. The
pieces then fill sequences by best-fit decreasing: longest first, each into the tightest open
sequence, which a segment tree over remaining capacities finds in logarithmic time. Pieces of one
length are alike, so the plan is made over the histogram of lengths (at most `capacity` numbers,
whatever the corpus has) and places whole runs of equal pieces at a time; it is the result that
placing them one by one gives. Which piece takes which place follows from its rank among the
pieces of its length, found by counts over (length, bucket) so that no length is ranked in one task.

Null texts are empty and get one piece with the end id alone. Rows with equal doc_id are packed each.
Columns that the input has besides doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .pretokens import byte_level_table

#: Texts encoded at once, smaller than common.SLICE_BYTES: a worker's tokenizers take their own memory besides.
SLICE_BYTES = 512 << 10

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over capacities 0..size: which are open, and the smallest open one that is at least a given one."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        i = self.leaves + capacity
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = self.leaves + least
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Rows (length, from rank, to rank, first sequence, pieces in each sequence, offset): pieces of that length with
    ranks in [from, to) go to consecutive sequences, the given number into each, from that offset on.
    """
    tree, bins, rows, made = CapacityTree(capacity), {}, [], 0

    def put(left: int, lo: int, hi: int) -> None:
        if hi > lo and left:
            bins.setdefault(left, []).append((lo, hi))
            tree.set(left, True)

    for length in sorted((x for x in counts if x > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                lo, hi = made, made + -(-left // each)
                made = hi
            else:
                each = room // length
                lo, hi = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    tree.set(room, False)
            full = min(hi - lo, left // each)
            if full:
                rows.append((length, rank, rank + full * each, lo, each, capacity - room))
                put(room - each * length, lo, lo + full)
                rank, left, lo = rank + full * each, left - full * each, lo + full
            if 0 < left < each and lo < hi:
                rows.append((length, rank, rank + left, lo, left, capacity - room))
                put(room - left * length, lo, lo + 1)
                rank, left, lo = rank + left, 0, lo + 1
            put(room, lo, hi)
    return rows


def encode_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """A row per piece; `token_ids` (little-endian unsigned 32-bit) besides if `with_ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_level_table(tokenizer_path)
        for whole in batches:
            for batch in common.slices(whole, limit=SLICE_BYTES):
                flat, counts = words.texts([t or "" for t in batch.column("text").to_pylist()])
                ends = np.cumsum(counts)
                ids = np.insert(flat, ends, end_id).astype("<u4")
                view, out, at = memoryview(ids).cast("B"), [], 0
                for doc, n in zip(batch.column("doc_id").to_pylist(), (counts + 1).tolist()):
                    start, size = 0, (n - 1) % capacity + 1
                    for piece in range(-(-n // capacity)):
                        raw = view[4 * (at + start) : 4 * (at + start + size)]
                        out.append((doc, piece, start, size, zlib.crc32(raw), *([bytes(raw)] if with_ids else [])))
                        start, size = start + size, capacity
                    at += n
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "token_ids"]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names[: len(out[0])])
        del words
        common.released()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", token_ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of PIECES at least), which must be cheap to read more than once."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(plan(counts, capacity), "p_length long, p_from long, p_to long, p_bin long, p_each long, p_offset long")
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(common.partitions(spark))))
    before = (
        bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = bucketed.withColumn("_row", within).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_from")) & (F.col("_rank") < F.col("p_to")))
    nth = F.col("_rank") - F.col("p_from")
    return placed.select(
        *pieces.columns,
        (F.col("p_bin") + F.floor(nth / F.col("p_each"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + F.col("length") * F.pmod(nth, F.col("p_each"))).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ids end to end and the documents they hold, from pieces with token_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "token_ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["token_ids"])).alias("token_ids"),
        F.transform("parts", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("parts"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    return pack(common.materialise(encode_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity)
