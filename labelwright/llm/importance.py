"""Importance resampling towards a target's distribution, by hashed n-grams.

Words are posexploded; for orders above 1 a window over each document leads the following words in and joins them to n-grams.
An n-gram's bucket is a hash of its bytes; a bucket's gain compares how often the target and the documents have it. A
document's weight is the sum of the gains of its n-grams, its score adds Gumbel noise from its doc_id, and the highest scores
are drawn, which is a draw without replacement in proportion to the weights' exponentials.

Counts of buckets are a table of at most `buckets` rows. Scores are ranked by a range exchange over (score, doc_id, row), so
that no task sorts all of them and ties, even of a third of all rows, are split; ranks are places within a part plus the rows of the parts before.

Null texts have no words; a null doc_id makes noise as an empty one and comes last among ties. Rows that repeat are drawn one
by one, copies in any order. Empty documents give no rows, an empty target lowers common buckets; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words once A-Z are lower-cased, over text that isn't yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Buckets whose gains are sent to every task; more are joined by a shuffle.
SENT_BUCKETS = 1_000_000


def lowered(word: Column) -> Column:
    return F.when(word.rlike("[A-Z]"), F.translate(word, string.ascii_uppercase, string.ascii_lowercase)).otherwise(word)


def ngrams(docs: DataFrame, orders: int, buckets: int, outer: bool = False) -> DataFrame:
    """The columns of docs but text, and size and bucket of each run of 1 to `orders` words; with `outer` a row of nulls for texts without words.

    docs needs the columns text and, for orders above 1, row, which tells rows apart.
    """
    keep = [c for c in docs.columns if c != "text"]
    spread = F.posexplode_outer if outer else F.posexplode
    found = docs.select(*keep, spread(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "word")).withColumn("word", lowered(F.col("word")))
    if orders == 1:
        found = found.withColumn("gram", F.struct(F.when(F.col("word").isNotNull(), 1).alias("size"), F.col("word").alias("text")))
    else:
        place = Window.partitionBy("row").orderBy("pos")
        follows = [F.col("word"), *(F.lead("word", k).over(place) for k in range(1, orders))]
        found = found.select("*", *(w.alias(f"w{k}") for k, w in enumerate(follows)))
        grams = [F.when(F.col(f"w{k}").isNotNull(), F.struct(F.lit(k + 1).alias("size"), F.concat_ws(" ", *(f"w{i}" for i in range(k + 1))).alias("text"))) for k in range(orders)]
        made = F.filter(F.array(*grams), lambda g: g.isNotNull())
        found = found.select(*keep, (F.explode_outer if outer else F.explode)(made).alias("gram"))
    return found.select(*keep, F.col("gram.size").alias("size"), (F.crc32(F.col("gram.text").cast("binary")) % buckets).alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, orders: int, buckets: int) -> DataFrame:
    """bucket, gain of every bucket that documents or target have."""
    each = lambda df, s, t: ngrams(df, orders, buckets).groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", (F.col("n") * s).alias("s"), (F.col("n") * t).alias("t"))
    counts = common.materialise(each(docs, 1, 0).unionByName(each(target, 0, 1)).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    over = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    under = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(over / under)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scores: DataFrame, first: Column, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """scores (a written table) with `place`, from 1, by `first` (rows where it holds come first) and then by order, which must
    tell all rows apart; and how many rows `first` holds for."""
    order = [F.desc("_first"), *order]
    spark = scores.sparkSession
    dealt = scores.withColumn("_first", F.coalesce(first, F.lit(False))).repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    # The number of a row is its part in the upper bits and its place there in the lower 33.
    dealt = common.materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33).alias("_part")
    parts = common.materialise(dealt.groupBy(part).agg(F.count("*").alias("_rows"), F.count_if("_first").alias("_held")), f"{name}-parts")
    # As many rows as there are parts.
    before = parts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    placed = dealt.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    held = parts.agg(F.coalesce(F.sum("_held"), F.lit(0)).alias("n")).first()["n"]
    return placed.drop("_first", "_at", "_part", "_before"), held


def resample(docs: DataFrame, target: DataFrame, orders: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank of every document; floor(percent * N / 100) of the N documents with
    at least `least_words` words are drawn and have a rank."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    goal = target.select(F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    known = gains(rows, goal, orders, buckets)
    grams = ngrams(rows, orders, buckets, outer=True).join(F.broadcast(known) if buckets <= SENT_BUCKETS else known, "bucket", "left")
    weights = grams.groupBy("row", "doc_id").agg(F.count("size").alias("n_features"), F.count_if(F.col("size") == 1).alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0).cast("long")).alias("weight"))
    scores = common.materialise(weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    placed, n = ranked(scores, F.col("n_words") >= least_words, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "ranked")
    drawn = percent * n // 100
    return placed.select("doc_id", "n_features", "n_words", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
