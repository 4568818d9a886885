"""WARC archives: a writer of response and revisit records, and a Python data source that reads them.

Written with Spark's text writer (a record is its text, closed by two line ends), so archives go wherever Spark can
write. The data source plans one partition for each run of files of about `splitBytes`, takes predicates on headers from
the query, parses the headers of a record first and seeks past the blocks of records that no predicate or option wants.
Archives are written uncompressed, so that seeking skips; gzip archives are read too, but as one stream for a whole file,
of which blocks that are passed are still decompressed.

Null payloads are empty; a record of equal payloads with the largest id is the response, the others (rows that repeat
that id excepted) revisit it. Line ends in a target are percent-encoded; a null target is left out; a null id is written
as `null`, is never a response that others refer to and never revisits. An empty table writes no record.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import common

#: RFC 4648 (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, http_length long, content_length long, warc_file string, payload binary"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_length": "content-length"}
BATCH_BYTES = 8 << 20


def base32_sha1(payload: Column) -> Column:
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("long") for g in range(8)]
    letter = lambda n, shift: F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return F.concat(*[letter(n, shift) for n in groups for shift in (15, 10, 5, 0)])


def records(pages: DataFrame, key: str = "page_id", target: str = "url", payload: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The text of a WARC record per row."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(target).cast("string").alias("target"), body.alias("payload")).withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.length("payload").cast("long"))
    groups = rows.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("key").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "bytes", "first")
    # Only payloads that repeat are joined, and their written list has a byte check: as a rule no payload is shuffled.
    joined = rows.join(common.small(common.materialise(groups, "groups")), ["digest", "bytes"], "left").withColumn("revisits", F.coalesce(F.col("key") < F.col("first"), F.lit(False)))
    end = "\r\n"
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    clean = F.regexp_replace(F.regexp_replace("target", "\r", "%0D"), "\n", "%0A")
    head = F.concat(F.lit("HTTP/1.1 200 OK" + end + "Content-Type: text/html; charset=utf-8" + end + "Content-Length: "), F.col("bytes").cast("string"), F.lit(end + end))
    length = F.octet_length(head) + F.when(F.col("revisits"), F.lit(0)).otherwise(F.col("bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisits"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("key"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisits"), F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")))),
        F.when(F.col("revisits"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    kept = F.when(F.col("revisits"), F.lit("")).otherwise(F.col("payload").cast("string"))
    return joined.select(F.concat(F.concat_ws(end, *lines), F.lit(end + end), head, kept).alias("value"))


def write(pages: DataFrame, path: str, compression: str = "none", **columns: Any) -> None:
    records(pages, **columns).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files below a folder and their sizes, by the file system that Spark uses for it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    out = []
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def read(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = 64 << 20) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("files", json.dumps(listed(spark, path))).option("payload", str(payload).lower()).option("splitBytes", str(split_bytes)).load()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WarcReader:
        return WarcReader(self.options)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class WarcReader(DataSourceReader):
    def __init__(self, options: Any):
        self.files = json.loads(options.get("files", "[]"))
        self.payload = options.get("payload", "true") == "true"
        self.split = int(options.get("splitBytes", 64 << 20))
        self.wanted: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "=", EqualNullSafe: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            kind = kinds.get(type(f))
            if kind and len(f.attribute) == 1 and f.attribute[0] in HEADERS and getattr(f, "value", 0) is not None:
                self.wanted.append((f.attribute[0], kind, tuple(f.value) if kind == "in" else f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out, held = [], 0
        for path, size in self.files:
            if not out or held + size > self.split:
                out.append(Files([]))
                held = 0
            out[-1].value.append(path)
            held += size
        return out

    def wants(self, row: dict[str, Any]) -> bool:
        for name, kind, value in self.wanted:
            own = row[name]
            if own is None or not (own in value if kind == "in" else own == value if kind == "=" else own > value if kind == ">" else own >= value if kind == ">=" else own < value if kind == "<" else own <= value):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in partition.value:
            with opened(path) as f:
                for row in parsed(f, path, self.wants, self.payload):
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in SCHEMA.split(", ")])


def opened(path: str) -> Any:
    if path.startswith("file:") or "://" not in path:
        raw: Any = open(path.removeprefix("file:").replace("///", "/", 1), "rb")
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        raw = store.open_input_file(name)
    return gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20) if isinstance(raw, io.RawIOBase) else raw


def headers(f: Any) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in iter(f.readline, b""):
        if not line.strip():
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parsed(f: Any, path: str, wants: Any, payload: bool) -> Iterator[dict[str, Any]]:
    """Records that `wants` accepts by their headers; the blocks of the others are not read."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record where one must begin")
        head = headers(f)
        size = int(head["content-length"])
        row: dict[str, Any] = {name: head.get(key) for name, key in HEADERS.items()} | {"content_length": size, "warc_file": path, "http_length": None, "payload": None}
        row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
        if not wants(row):
            f.seek(size, io.SEEK_CUR)
            continue
        begin = f.tell()
        if head.get("content-type", "").startswith("application/http"):
            f.readline()
            inner = headers(f)
            row["http_length"] = int(inner["content-length"]) if inner.get("content-length", "").isdigit() else None
        left = size - (f.tell() - begin)
        if payload and row["record_type"] != "revisit":
            row["payload"] = f.read(left)
        else:
            f.seek(left, io.SEEK_CUR)
        yield row


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as an archive and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = common.scratch(spark, "warc")
    write(pages, path)
    rows = read(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:record:(-?[0-9]+)>$", 1), F.lit("")).cast("long")
    return rows.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), "http_length").alias("payload_bytes"),
        F.coalesce(base32_sha1(F.col("payload")), "payload_digest").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
