"""Secret scans with ownership frequency over the corpus.

Candidates of four kinds are found in whole texts: assigned values, access key ids, long hex runs, and mixed runs that look
generated. A candidate's value is known by its SHA-256 alone. Distinct (value, owner, repository) are counted first, then
owners of each value, so that a value that a third of all rows hold is summed where it lies. A value of several owners is a
copied example, one of a single owner that has enough different characters looks live. Matches of the first three kinds are
always kept; mixed runs become spans (`owned`) only if they look live and overlap no match of the other kinds.

Only values of several owners are sent back to the texts (broadcast by counted size, else by a join that Spark may split),
texts without candidates take no part in it. Spans are places of code points, end exclusive; an assignment's span is the
whole match, its value the assigned one. Null and empty texts have no spans; a null owner or repository is one of its own;
repeated rows are rows of their own; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .runs import INNER, runs

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "owned")
#: Over text with A-Z lower-cased, which moves no place, as its classes have both cases.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
LEAST_ASSIGN, LEAST_HEX, LEAST_MIXED = 12, 16, 20
#: Different characters that a value needs to look generated.
LEAST_DIFFERENT = 8
_HEX = np.array([chr(c) in "0123456789abcdef" for c in range(256)])
_MIXED = np.array([c < 128 and (chr(c).isalnum() or chr(c) in "_-") for c in range(256)])
FOUND = "array<struct<kind:int,start:int,end:int,value:binary,varied:boolean>>"


def mixed(value: bytes) -> bool:
    return bool(re.search(rb"[0-9]", value) and re.search(rb"[a-z]", value) and re.search(rb"[A-Z]", value))


def candidates(joined: bytes, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """kind, start, end, start and end of the value of all candidates in texts that a zero byte parts."""
    data = np.frombuffer(joined, np.uint8)
    out = [(0, m.start(), m.end(), m.start(1), m.end(1)) for m in ASSIGN.finditer(joined.lower()) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    out += [(1, *m.span(), *m.span()) for m in ACCESS.finditer(joined)]
    first, size, _ = runs(_HEX[data], offsets)
    out += [(2, a, a + n, a, a + n) for a, n in zip(first[size >= LEAST_HEX].tolist(), size[size >= LEAST_HEX].tolist())]
    taken = sorted(x[1:3] for x in out)
    starts, ends = np.array([a for a, _ in taken], np.int64), np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else np.zeros(0, np.int64)
    first, size, _ = runs(_MIXED[data], offsets)
    first, size = first[size >= LEAST_MIXED], size[size >= LEAST_MIXED]
    before = np.searchsorted(starts, first + size)  # matches that begin before the run ends
    free = np.concatenate([[0], ends])[before] <= first
    return out + [(3, a, a + n, a, a + n) for a, n in zip(first[free].tolist(), size[free].tolist()) if mixed(joined[a : a + n])]


def scanned(rows: DataFrame) -> DataFrame:
    """row, doc_id, owner, repository and the candidates of each text of rows (the same and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("varied", pa.bool_())]))
        for batch in batches:
            for part in common.slices(batch):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                joined = b"\0".join([*texts, b""])
                offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
                inner = np.flatnonzero(INNER[np.frombuffer(joined, np.uint8)])
                found: list[list[dict]] = [[] for _ in texts]
                hits = candidates(joined, offsets)
                starts = np.array([h[1] for h in hits], np.int64)
                own = np.searchsorted(offsets, starts, "right") - 1
                at = starts - offsets[own] - np.searchsorted(inner, starts) + np.searchsorted(inner, offsets[own])
                for i, begin, (k, a, b, c, d) in zip(own.tolist(), at.tolist(), hits):
                    value = joined[c:d]  # matches are of ASCII
                    found[i].append({"kind": k, "start": begin, "end": begin + b - a, "value": hashlib.sha256(value).digest(), "varied": len(set(value)) >= LEAST_DIFFERENT})
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "owner", "repository")), pa.array(found, kind)], ["row", "doc_id", "owner", "repository", "found"])

    return rows.mapInArrow(run, f"row long, doc_id long, owner string, repository string, found {FOUND}")


def owners(found: DataFrame) -> DataFrame:
    """value, owners, repositories, holders (rows) of every candidate's value."""
    each = found.select("owner", "repository", "row", F.explode(F.array_distinct(F.transform("found", lambda c: c["value"]))).alias("value"))
    by_place = each.groupBy("value", "owner", "repository").agg(F.count("*").alias("holders"))
    by_owner = by_place.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("holders").alias("holders"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("holders").alias("holders"))


def _named(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def summary(spans: Column) -> list[Column]:
    """The columns of a row made of its spans (start, kind, end, owners, varied) in order."""
    count = lambda hit: F.size(F.filter(spans, hit)).cast("long")
    kind = lambda k: count(lambda s: s["kind"] == k)
    return [
        *(kind(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(_named(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _named(spans).alias("spans"),
        count(lambda s: (s["owners"] == 1) & s["varied"]).alias("n_live"), count(lambda s: s["owners"] > 1).alias("n_copied"),
    ]


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Of every document doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live (spans of a value that one owner has and
    that looks generated) and n_copied (of a value that several have). Owners are sources, repositories their languages, unless given."""
    owner, repository = F.col("source") if owner is None else owner, F.col("lang") if repository is None else repository
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.col("text").cast("string").alias("text"))
    found = common.materialise(scanned(rows), "secrets")
    some = found.filter(F.size("found") > 0)
    shared = common.materialise(owners(some).filter("owners > 1").select("value", "owners"), "shared")
    each = some.select("row", "doc_id", F.explode("found").alias("c")).select("row", "doc_id", "c.*")
    judged = each.join(common.small(shared), "value", "left").withColumn("owners", F.coalesce("owners", F.lit(1).cast("long")))
    kept = judged.filter((F.col("kind") < 3) | ((F.col("owners") == 1) & F.col("varied")))
    # Rows whose candidates all go keep their place.
    spans = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "varied"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,varied:boolean>>")
    full = some.select("row", "doc_id").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", none))
    every = full.select("doc_id", "spans").unionByName(found.filter(F.size("found") == 0).select("doc_id", none.alias("spans")))
    return every.select("doc_id", *summary(F.col("spans")))
