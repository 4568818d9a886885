"""Headline queries at $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from labelwright.functions.text import normalize_code
from labelwright.operators.reach import within_reach
from labelwright.plans import synthetic
from labelwright.plans.queries import NO_REPAIR, QUERIES

HEADLINES = (
    "master_upsert", "master_prior", "exact_match", "fuzzy_match", "weighted_edit_distance", "posterior_topk", "verified_flags", "positional_profile", "shape_loglik", "text_cleaning",
    "barcode_date", "label_numbers", "pass_observations", "merge_passes", "grammar_repair", "guess_full", "text_to_result", "otsu_histogram",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    texts = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    pairs = texts * spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    seen = synthetic.observations(spark, sf_dir).select(normalize_code(F.col("text")).alias("observed")).filter("observed <> ''")
    listed = synthetic.frame(spark, sf_dir, synthetic.MASTER).select("code", F.col("code").alias("ord"))
    measured = within_reach(seen, listed, NO_REPAIR.length_band, NO_REPAIR.most_distance, verify=False).count()
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None,
        "fuzzy_pairs": seen.distinct().count() * listed.count(), "fuzzy_pairs_measured": measured, "fuzzy_pairs_per_sec": round(pairs / took["fuzzy_match"]), "text_guesses_per_sec": round(texts / took["text_to_result"]), "labels_per_sec": round(synthetic.frame(spark, sf_dir, "SELECT count(*) AS n FROM {orders}").first().n / took["label_numbers"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
