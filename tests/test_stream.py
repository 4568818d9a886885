"""Passes that come one by one, late and repeated, and results written in two places."""

import json
import time

import pytest
from pyspark.sql import functions as F

from labelwright.operators.passes import PASSES
from labelwright.plans.pipeline import Engine
from labelwright.sources.sinks import write_results
from labelwright.streaming import passes as S

ARTICLE, BATCH = "Article : RD25815O", "Batch : V23"
#: image_id, pass_no, variant, text, mean_conf by batch: 1 is whole at once, 2 waits for its last pass, 3 repeats a pass and needs
#: turns, 4 lacks passes, 5 is improved after it was whole.
BATCHES = [
    [(1, 0, "gray", ARTICLE, 0.7), (1, 1, "sauvola", BATCH, 0.9), (1, 2, "otsu", "", 0.0), (2, 0, "gray", "", 0.0), (2, 2, "otsu", "Quality : EA511872FX30", 0.6), (3, 0, "gray", BATCH, 0.2), (3, 0, "gray", ARTICLE, 0.1), (None, 0, "gray", ARTICLE, 0.9)],
    [(2, 1, "sauvola", BATCH, 0.5), (2, 2, "otsu", "Quality : EA511872FX30", 0.6), (3, 1, "sauvola", "", 0.0), (3, 2, "otsu", "", 0.0), (4, 1, "sauvola", ARTICLE, 0.8), (5, 0, "gray", BATCH, 0.5), (5, 1, "sauvola", "", None), (5, 2, "otsu", "", 0.0)],
    [(3, 3, "turned", ARTICLE, 0.8), (3, 4, "turned", "", 0.0), (3, 5, "turned", "", 0.0), (5, 1, "sauvola", ARTICLE, 0.6), (1, 1, "sauvola", BATCH, 0.9)],
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, []) for r in rows], PASSES)


@pytest.fixture
def engine(spark):
    return Engine(spark.createDataFrame([("RD258150", "Mocha", 40.0), ("EA511872FX30", None, 20.0)], "code string, description string, cnt double").cache())


def plain(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.collect())


def until(query, done):
    """Waits for what a running stream does: it has to be stopped, as Spark goes on asking which waits are over."""
    end = time.monotonic() + 90
    while not done():
        assert query.isActive and time.monotonic() < end, query.exception()
        time.sleep(0.1)


def test_stream_of_passes_equals_the_batch(spark, engine, tmp_path):
    revisions = []
    whole = lambda: {r.image_id for r in revisions if r.whole}
    frame(spark, BATCHES[0]).coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = S.together(spark.readStream.schema(PASSES).parquet(f"{tmp_path}/in"), wait_ms=3000).writeStream.outputMode("update")
    query = rows.foreachBatch(lambda df, n: revisions.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    try:
        until(query, lambda: whole() == {1})
        frame(spark, BATCHES[1]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        until(query, lambda: whole() == {1, 2, 5} and {3, 4} <= {r.image_id for r in revisions})
        frame(spark, BATCHES[2]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        until(query, lambda: whole() == {1, 2, 3, 5} and len([r for r in revisions if r.image_id == 5]) == 2)
    finally:
        query.stop()
    assert [(r.revision, r.whole) for r in revisions if r.image_id in (1, 4)] == [(1, True), (1, False)]
    every = spark.createDataFrame([tuple(r) for r in revisions], S.TOGETHER)
    batch = S.once(frame(spark, [r for rows in BATCHES for r in rows]))
    assert plain(S.latest(every)) == plain(batch)
    for ours, theirs in zip(engine.from_passes(S.latest(every)), engine.from_passes(batch)):
        assert plain(ours) == plain(theirs) and ours.count() > 0


def test_results_of_a_stream_are_written_once(spark, engine, tmp_path):
    frame(spark, [r for rows in BATCHES[:2] for r in rows]).write.parquet(f"{tmp_path}/in")

    def sink(candidates, fields, number):
        for _ in range(2):  # a batch that is done again
            write_results(candidates.select("req_id", "code", "rank"), fields.filter("article is null").select("image_id"), f"{tmp_path}/out", number)

    query = S.results(spark.readStream.schema(PASSES).parquet(f"{tmp_path}/in"), engine, sink, f"{tmp_path}/state", {"processingTime": "200 milliseconds"})
    until(query, lambda: any(p["numInputRows"] for p in query.recentProgress))
    query.stop()
    found = spark.read.json(f"{tmp_path}/out/results")
    assert {r.req_id: r.code for r in found.filter("rank = 1").collect()} == {1: "RD258150", 2: "EA511872FX30"} and found.count() == found.distinct().count()
    assert {r.image_id for r in spark.read.json(f"{tmp_path}/out/failures").collect()} == {2, 5}


def test_results_and_failures_are_apart(spark, tmp_path):
    good = spark.createDataFrame([(1, "A", None)], "req_id long, articleCode string, method string")
    bad = spark.createDataFrame([("x.png", "broken")], "path string, error string")
    write_results(good, bad, str(tmp_path / "out"))
    lines = spark.read.text(f"{tmp_path}/out/results").collect()
    assert [json.loads(r.value) for r in lines] == [{"req_id": 1, "articleCode": "A", "method": None}] and spark.read.json(f"{tmp_path}/out/failures").first().error == "broken"
    with pytest.raises(Exception, match="(?i)already exists"):
        write_results(good, bad, str(tmp_path / "out"))


def test_no_passes(spark):
    assert S.once(frame(spark, [])).count() == 0 and S.latest(spark.createDataFrame([], S.TOGETHER)).count() == 0
    repeated = frame(spark, [(1, 0, "gray", "a", None), (1, 0, "gray", "b", 0.0), (1, 0, "gray", "a", 0.0)])
    assert [(r.text, r.mean_conf) for r in S.once(repeated).withColumn("n", F.lit(1)).collect()] == [("b", 0.0)]
