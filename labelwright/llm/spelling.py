"""Spelling variants: words one edit apart, and of each the far commoner word that it may stand for.

Words are counted in whole texts (vectorised per slice, summed by Spark). One inserted, deleted or replaced code point leaves
the first or the last half of the shorter word intact, so that near words share a block of a forward dictionary (length and
first half) or of a reversed one (length and last half). A block of many pairs is divided: of the unknown middle again a half
is intact, which lengthens the shared prefix or the shared suffix, and so on until blocks are small or one place is left,
where a block has at most as many words as one or two letters allow. Blocks are dealt by range and sorted, scanned in order,
and every pair of a block is verified; a pair is found in one block alone, as the suffix side leaves out pairs of the prefix side.

No step holds more than a block and a batch, hot words are summed where they lie, and forms are followed by doubling.

Null texts have no runs, a null doc_id counts as empty. Repeated rows count each. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .runs import crc32s, gathered, runs
from .words import LOWER

#: Of hashes, those that this number divides mark damaged runs.
DAMAGED = 199
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: Pairs of a block beyond which it is divided.
BLOCK_PAIRS = 2_000
#: Rows and bytes that a scan holds at a time; blocks are never cut.
SCAN_ROWS, SCAN_BYTES = 20_000, 1 << 20
_LETTER = np.array([chr(c).isalpha() for c in range(128)] + [False] * 128)
#: Code points from U+00C0 to U+00FF are this byte and a continuation byte.
_LEAD = 0xC3
KEY = ["side", "m", "lo", "hi", "bar", "head", "tail"]


def words_of(part: pa.RecordBatch, least: int, damaged: int) -> pa.StringArray:
    """All runs of a slice (doc_id, text) with at least `least` code points, lower-cased, damaged ones without their code point."""
    data, offsets = common.text_bytes(part.column("text"))
    data = LOWER[data]
    lead = data == _LEAD
    follows = np.concatenate([[False], lead[:-1]])
    first, size, text = runs(_LETTER[data] | lead | follows, offsets)
    inner = np.concatenate([[0], np.cumsum(follows, dtype=np.int32)])
    points = size - (inner[first + size] - inner[first])
    long = points >= least
    first, size, text, points = first[long], size[long], text[long], points[long]
    prefix = np.fromiter((zlib.crc32(f"{'' if d is None else d}:".encode()) for d in part.column("doc_id").to_pylist()), np.uint32, len(part))
    crc = crc32s(data, first, size, prefix[text])
    hit = crc % np.uint32(damaged) == 0
    mended = []
    for a, n, h, p in zip(first[hit].tolist(), size[hit].tolist(), crc[hit].tolist(), points[hit].tolist()):
        if p > least:
            word = data[a : a + n].tobytes().decode()
            mended.append(word[: h % p] + word[h % p + 1 :])
    body = gathered(data, first[~hit], size[~hit])
    ends = np.concatenate([[0], np.cumsum(size[~hit])]).astype(np.int32)
    whole = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(body))
    return pa.concat_arrays([whole, pa.array(mended, pa.string())])


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """word, n of all words that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                counts = pc.value_counts(words_of(part, least_length, damaged))
                yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _keyed(entries: DataFrame) -> DataFrame:
    head, tail = F.substring("word", F.lit(1), F.col("lo")), F.right("word", F.col("hi"))
    return entries.withColumn("head", head).withColumn("tail", F.when(F.col("hi") > 0, F.reverse(tail)).otherwise(""))


def dictionaries(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """The entries of both dictionaries: a word is met as the shorter one of a pair (m is its length) and as the longer one.

    lo and hi are the code points at its ends that a block shares; pairs with a shared prefix of at least `bar` are found elsewhere,
    so that no two blocks that a pair reaches by different divisions are one.
    """
    size = F.length("word")
    each = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"), (F.length("word")).alias("_size")).filter(F.col("m") >= least_length)
    half = F.floor(F.col("m") / 2).cast("int")
    side = lambda s, lo, hi, bar: each.select(F.lit(s).alias("side"), "m", lo.alias("lo"), hi.alias("hi"), bar.cast("int").alias("bar"), (F.col("_size") > F.col("m")).alias("longer"), "word", "n")
    zero = F.lit(0)
    return _keyed(side(0, half, zero, F.col("m") + 2).unionByName(side(1, zero, half, half)))


def divided(entries: DataFrame, most: int = BLOCK_PAIRS) -> DataFrame:
    """The entries of blocks that have pairs, blocks of more than `most` pairs divided as far as they can be."""
    done = []
    while True:
        entries = common.materialise(entries, "entries")
        short, long = F.sum((~F.col("longer")).cast("long")), F.sum(F.col("longer").cast("long"))
        pairs = short * (short - 1) / 2 + short * long
        sizes = entries.groupBy(*KEY).agg(pairs.alias("pairs")).filter("pairs > 0")
        sizes = common.materialise(sizes.withColumn("heavy", (F.col("pairs") > most) & (F.col("m") - F.col("lo") - F.col("hi") > 1)), "blocks")
        # Blocks with pairs alone go on; the list of blocks has a row for each.
        met = entries.join(common.small(sizes.select(*KEY, "heavy")), KEY)
        done.append(met.filter(~F.col("heavy")).drop("heavy"))
        if not sizes.filter("heavy").limit(1).count():
            break
        rest = met.filter("heavy").drop("heavy", "head", "tail")
        half = F.floor((F.col("m") - F.col("lo") - F.col("hi")) / 2).cast("int")
        left = rest.withColumn("lo", F.col("lo") + half).filter("lo < bar")
        right = rest.withColumn("bar", F.least("bar", F.col("lo") + half)).withColumn("hi", F.col("hi") + half)
        entries = _keyed(left.unionByName(right))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_pairs(block: np.ndarray, longer: np.ndarray, bar: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (first, second) of one edit. block: a number for each row, rows of a block together, shorter words first; words in Latin-1."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    width = int(size.max(initial=0)) + 1
    letters = np.zeros((n, width), np.uint8)
    letters[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    last = np.searchsorted(block, block, "right") - 1
    left = np.where(longer, 0, last - np.arange(n))
    live, d, found = np.flatnonzero(left > 0), 1, []
    while len(live):
        a, b = letters[live], letters[live + d]
        off = a != b
        at = off.argmax(1)
        shifted = (a[:, :-1] != b[:, 1:]) & (np.arange(width - 1) >= at[:, None])
        hit = np.where(longer[live + d], ~shifted.any(1), off.sum(1) == 1) & (at < bar[live])
        found.append((live[hit], live[hit] + d))
        d += 1
        live = live[left[live] >= d]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def near_words(entries: DataFrame) -> DataFrame:
    """word, near, near_n for both words of every pair of blocks."""
    spark = entries.sparkSession
    columns = [*KEY, "longer", "word", "n"]
    dealt = entries.select(columns).repartitionByRange(common.partitions(spark), *KEY).sortWithinPartitions(*KEY, "longer", "word")

    def scanned(table: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        m = table.column("m").to_numpy()
        edges = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]  # rows of one length, as long words make wide rows
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = table.slice(lo, hi - lo)
            words, n = own.column("word").to_pylist(), own.column("n").to_numpy()
            a, b = near_pairs(block[lo:hi], own.column("longer").to_numpy(), own.column("bar").to_numpy(), [w.encode("latin-1") for w in words])
            first, second = np.concatenate([a, b]), np.concatenate([b, a])
            every = pa.array(words, pa.string())
            yield pa.RecordBatch.from_arrays([every.take(pa.array(first)), every.take(pa.array(second)), pa.array(n[second])], ["word", "near", "near_n"])

    def blocks(table: pa.Table) -> np.ndarray:
        """A number for each row that grows by 1 at every new block."""
        new = np.zeros(len(table), bool)
        for c in KEY:
            own = table.column(c).combine_chunks()
            new[1:] |= pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) < SCAN_ROWS and sum(b.nbytes for b in held) < SCAN_BYTES:
                continue
            table = pa.Table.from_batches(held)
            block = blocks(table)
            cut = int(np.searchsorted(block, block[-1]))  # the last block may go on
            if cut:
                yield from scanned(table.slice(0, cut), block[:cut])
            held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if len(table):
                yield from scanned(table, blocks(table))

    return dealt.mapInArrow(run, "word string, near string, near_n long")


def followed(links: DataFrame) -> DataFrame:
    """at, root: where the links (at, root) of distinct `at` without cycles end."""
    now = common.materialise(links, "forms")
    while True:
        further = common.small(now).select(F.col("at").alias("root"), F.col("root").alias("next"))
        moved = common.materialise(now.join(further, "root", "left").select("at", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        now = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, damaged: int = DAMAGED, most: int = BLOCK_PAIRS) -> DataFrame:
    """word, n, n_near (words one edit apart), form (the commonest of them, if at least `factor` times as common), form_n and
    root (where forms lead; the word itself without one). Ties of forms go to the smallest word."""
    words = common.materialise(vocabulary(docs, least_length, least_count, damaged), "words")
    pairs = near_words(divided(dictionaries(words, least_length), most))
    best: Column = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.n") >= factor * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    rows = common.materialise(rows, "variants")
    roots = followed(rows.filter("form is not null").select(F.col("word").alias("at"), F.col("form").alias("root")))
    return rows.join(roots.withColumnRenamed("at", "word"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
