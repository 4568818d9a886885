"""Toxicity by bags of subwords: embeddings of byte n-grams and words, averaged into a linear softmax.

Embeddings and softmax are trained jointly in numpy, in one task, over a bounded sample of labelled rows (`SAMPLE_ROWS`
of each class at most, in hash order of doc_id, so any size of table gives the same kind of sample; of these, in a
mixed order, the texts that fit into `SAMPLE_BYTES`, of which each class has half and what the other leaves). They are
chosen by their sizes, so that only texts that are learnt from leave their tasks. Misspelt or inflected words share the
vectors of their n-grams; runs of one word count once. Scoring covers every row and whole text: with the softmax fixed, an n-gram's part in the logit is one number, and a document's logit is their mean.

Only texts enter a score. Null and empty texts have no features and get the score of the bias. Labels that are null
are left out; of several labels of a document the highest counts. Rows with equal doc_id are scored each, and the longest of
their texts is learnt from (of equally long ones the greatest); without usable labels of both classes every score is 0. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sized

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common
from .words import Lanes, hashes, mixed, spaced

SAMPLE_ROWS, SAMPLE_BYTES = 2500, 24 << 20
BITS, DIM, SIZES = 18, 8, (3, 4, 5, 6)
EPOCHS, BATCH, RATE, SEED, SPREAD = 15, 32, 0.5, 11, 0.05
#: An n-gram counts from this many sampled texts on; so many neutral ones join each mean, so that few words alone decide less.
LEAST_TEXTS, NEUTRAL = 3, 300

def _letters() -> np.ndarray:
    """Lower-cases ASCII; digits, letters and bytes of other scripts stay, as do the signs that stand for letters."""
    out = np.full(256, 32, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum() or chr(b) in "@$*":
            out[b] = ord(chr(b).lower()) if b < 128 else b
    return out


LETTERS = _letters()


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: buckets, which of them count, and where each text's begin (one more than texts)."""
    text = spaced(data, offsets, LETTERS)
    bounds = offsets + np.arange(len(offsets))
    white = text == 32
    spaces = np.concatenate([[0], np.cumsum(white, dtype=np.int32)])
    total = len(text)
    last_bits = np.uint64(64 - BITS)
    first = np.flatnonzero(~white[1:] & white[:-1]) + 1
    last = np.flatnonzero(~white[:-1] & white[1:]) + 1
    words = (hashes(Lanes(text), first, last - first) >> last_bits).astype(np.int32)
    # A word that repeats the one before it in its text does not count again.
    again = np.zeros(len(first), bool)
    again[1:] = (words[1:] == words[:-1]) & (np.searchsorted(bounds, first[1:], "right") == np.searchsorted(bounds, first[:-1], "right"))
    change = np.zeros(total + 1, np.int8)
    change[first[again] - 1] += 1
    change[last[again]] -= 1
    fresh = np.cumsum(change[:-1]) == 0
    gram = np.zeros(total, np.uint64)
    for size in range(1, SIZES[-1] + 1):
        if total < size:
            break
        # The bytes of an n-gram are its key, so that no two share one before buckets are made.
        gram = gram[: total - size + 1]
        gram |= text[size - 1 :].astype(np.uint64) << np.uint64(8 * (size - 1))
        if size in SIZES:
            inner = spaces[size - 1 : total] - spaces[1 : total - size + 2] == 0
            full = inner & (spaces[size:] - spaces[: total - size + 1] < size) & fresh[: len(gram)]
            yield (mixed(gram + np.uint64(size << 56)) >> last_bits).astype(np.int32), full, np.minimum(bounds, len(gram))
    yield words, ~again, np.searchsorted(first, bounds)


class Model:
    def __init__(self, embedding: np.ndarray, softmax: np.ndarray, bias: np.ndarray):
        self.embedding, self.softmax, self.bias = embedding, softmax, bias
        self.parts = (embedding @ (softmax[1] - softmax[0])).astype(np.float32)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for buckets, full, bounds in grams(data, offsets):
            upto = np.concatenate([[0.0], np.cumsum(np.where(full, self.parts[buckets], 0), dtype=np.float64)])
            total += np.diff(upto[bounds])
            count += np.diff(np.concatenate([[0], np.cumsum(full)])[bounds])
        logit = total / (count + NEUTRAL) + self.bias[1] - self.bias[0]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Adagrad on the softmax's log loss. The gradient of an embedding is a number times the difference of the softmax rows."""

    def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        found = [b[f] for b, f, _ in grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))]
        return np.unique(np.concatenate(found), return_counts=True)

    # Twice through the texts, so that n-grams that don't count are never held.
    among = np.zeros(1 << BITS, np.int32)
    for text in texts:
        among[bag(text)[0]] += 1
    bags = []
    for text in texts:
        keys, counts = bag(text)
        own = among[keys] >= LEAST_TEXTS
        bags.append((keys[own], (counts[own] / (counts.sum() + NEUTRAL)).astype(np.float32)))
    random = np.random.default_rng(SEED)
    embedding = random.normal(0, SPREAD, (1 << BITS, DIM)).astype(np.float32)
    embedding[among < LEAST_TEXTS] = 0
    softmax = random.normal(0, 1, (2, DIM)).astype(np.float32)
    bias = np.zeros(2)
    seen_e, seen_w, seen_b = np.full(1 << BITS, 1e-8, np.float32), np.full((2, DIM), 1e-8), np.full(2, 1e-8)
    for epoch in range(EPOCHS):
        order = random.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            keys = np.concatenate([bags[i][0] for i in own])
            share = np.concatenate([bags[i][1] for i in own])
            doc = np.repeat(np.arange(len(own)), [len(bags[i][0]) for i in own])
            rows, back = np.unique(keys, return_inverse=True)
            across = softmax[1] - softmax[0]
            logit = np.bincount(doc, share * (embedding[rows] @ across)[back], minlength=len(own)) + bias[1] - bias[0]
            off = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels[own]) * weights[own]
            pull = np.bincount(back, share * off[doc], minlength=len(rows)).astype(np.float32)
            grad_w = np.outer([-1, 1], pull @ embedding[rows])
            grad_b = off.sum() * np.array([-1, 1])
            seen_e[rows] += pull**2 * float(across @ across)
            embedding[rows] -= RATE * np.outer(pull / np.sqrt(seen_e[rows]), across)
            seen_w += grad_w**2
            softmax -= 0.1 * grad_w / np.sqrt(seen_w)
            seen_b += grad_b**2
            bias -= 0.1 * grad_b / np.sqrt(seen_b)
    return Model(embedding, softmax, bias)


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5))


def fitting(order: list[int], found: dict[int, tuple[int, Sized]], limit: int) -> list[int]:
    """Of documents (class and text) in an order those that fit into `limit` bytes; a class that has none of them gets its shortest."""
    total = [sum(len(text) for own, text in found.values() if own == c) for c in (0, 1)]
    left = [max(limit // 2, limit - total[1 - c]) for c in (0, 1)]
    kept = set()
    for doc in order:
        own, text = found[doc]
        if len(text) <= left[own]:
            left[own] -= len(text)
            kept.add(doc)
    for c in (0, 1):
        rest = [doc for doc in order if found[doc][0] == c]
        if rest and kept.isdisjoint(rest):
            kept.add(min(rest, key=lambda doc: len(found[doc][1])))
    return [doc for doc in order if doc in kept]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES) -> Model | None:
    """Learns from labelled documents outside fold 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold(F.col("doc_id")) != 0)
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    sample = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("size", F.octet_length("text").cast("long"))
    met = texts.select("doc_id", "size").join(F.broadcast(sample[0].unionByName(sample[1])), "doc_id")
    # At most `rows` documents of each class, by size alone.
    found = {r["doc_id"]: (r["toxic"], range(r["size"])) for r in met.groupBy("doc_id", "toxic").agg(F.max("size").alias("size")).collect()}
    order = fitting(sorted(found, key=lambda doc: (doc * 0x9E3779B97F4A7C15) % 2**64), found, limit)
    y = np.array([found[doc][0] for doc in order])
    if len(set(y.tolist())) < 2:
        return None
    # Each class weighs what it does among all labels.
    share = {c: totals[c] / sum(totals.values()) / int((y == c).sum()) * len(y) for c in (0, 1)}
    chosen = docs.sparkSession.createDataFrame([(doc, len(found[doc][1]), i) for i, doc in enumerate(order)], "doc_id long, size long, place int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        for batch in batches:
            for place, text in zip(batch.column("place").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                held[place] = text
        if not held:
            return
        own = [held[i] for i in sorted(held)]
        held.clear()
        model = train(own, y, np.array([share[c] for c in y]))
        fitted = pickle.dumps((model.embedding, model.softmax, model.bias))
        del model, own
        yield pa.RecordBatch.from_arrays([pa.array([fitted], pa.binary())], ["model"])
        common.released()

    # One text for each chosen document, at most `limit` bytes, meets in one task.
    taken = texts.join(F.broadcast(chosen), ["doc_id", "size"]).groupBy("place").agg(F.max("text").alias("text"))
    fitted = taken.repartition(1).mapInArrow(run, "model binary").collect()
    return Model(*pickle.loads(fitted[0]["model"])) if fitted else None


def scored(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    """All rows and columns of docs, and the score under a name that no column has."""
    sent = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.parts, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model.__new__(Model)
        if sent.value is not None:
            scorer.parts, scorer.bias = sent.value
        for whole in batches:
            texts = pa.RecordBatch.from_arrays([whole.column("text").cast(pa.string())], ["text"])
            parts = [np.zeros(len(b)) if sent.value is None else scorer.scores(*common.text_bytes(b.column("text"))) for b in common.slices(texts)]
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(np.concatenate([np.zeros(0), *parts]))], [*whole.schema.names, name])
        common.released()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, "score")
    return rows.select("doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; each by its own text."""
    name = common.fresh(docs, "score")[0]
    return scored(docs, fit(docs, labels), name).filter(F.col(name) < 0.5).select(docs.columns)
