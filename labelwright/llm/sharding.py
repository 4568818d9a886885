"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions alone.

Every shard scores every key, weight / -ln(u) with u drawn from a hash of (key, shard); the highest score takes the
record. A further shard only adds one more score, so records move to it or stay. Places (slots) inside a shard are
counted over (shard, bucket) pairs, and buckets follow the number of shuffle partitions: no shard is sorted in one task.

Null keys hash like a fixed key; rows with equal keys share a shard and have slots of their own; an empty table gives
no rows; other columns pass through `assign` untouched (its own are named by the caller).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def highest(key: Column, weights: list[float], first: int = 0) -> Column:
    """The highest score (score, shard) of each key among shards numbered from `first` on; ties go to the higher number."""
    live = [(i, w) for i, w in enumerate(weights, first) if w > 0]
    if not live:
        raise ValueError("no shard has a weight above 0")

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.lit(weight) / -F.log(u)).alias("score"), F.lit(shard).alias("shard"))

    scores = [score(i, w) for i, w in live]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (index into weights) of each key."""
    return highest(key, weights)["shard"]


def slots(df: DataFrame, shard: str, order: list[str], name: str = "slot") -> DataFrame:
    """Adds the gapless place of each row in its shard."""
    bucket, row, n, upto = common.fresh(df, "bucket", "row", "n", "upto")
    bucketed = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(common.partitions(df.sparkSession))))
    before = (
        bucketed.groupBy(shard, bucket).agg(F.count("*").alias(n))
        .withColumn(upto, F.sum(n).over(Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)))
        .select(shard, bucket, F.coalesce(upto, F.lit(0)).alias(upto))
    )
    placed = bucketed.withColumn(row, F.row_number().over(Window.partitionBy(shard, bucket).orderBy(*order))).join(before, [shard, bucket])
    return placed.select(*df.columns, (F.col(upto) + F.col(row) - 1).cast("long").alias(name))


def assign(df: DataFrame, key: Column, weights: list[float], shard: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Adds the shard; with `grown`, also the one that each row has when a shard of grown_weight is added."""
    (best,) = common.fresh(df, "best")
    out = df.withColumn(best, highest(key, weights)).withColumn(shard, F.col(best)["shard"])
    if grown:
        more = highest(key, [grown_weight], len(weights)) if grown_weight > 0 else F.col(best)
        out = out.withColumn(grown, F.greatest(F.col(best), more)["shard"] if grown_weight > 0 else F.col(best)["shard"])
    return out.drop(best)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign(rows, F.col("doc_id"), [1.0] * shards, grown="grown_shard")
    return slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard."""
    df.write.partitionBy(shard).parquet(path)
