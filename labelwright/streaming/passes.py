"""A stream of recognised passes, which come one by one, late or repeated: keyed state puts the passes of an image together.

An image is whole when its variants are there and, where none of them is good, its turns too. It is emitted then, or after a
wait if passes fail to come. A pass that comes later, or a better one of the same number, gives another revision with all
passes; the last revision counts. State without news is dropped after `forget_ms`: a pass that comes later still begins anew.
Of passes of one number the most confident one counts, of equally confident ones the greatest text of JSON, in whatever
order they come; a null confidence is 0. Passes without image_id or pass_no are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.labels import WORDS
from ..operators.passes import ROTATE_BELOW, ROTATIONS
from ..plans.pipeline import Engine

VARIANTS = 3
PACKED = f"variant string, text string, words {WORDS}"
HELD = "nos array<int>, confs array<double>, packed array<string>"
STATE = HELD + ", revision int, waits boolean"
TOGETHER = "image_id long, revision int, whole boolean, " + HELD


def packed(passes: DataFrame) -> DataFrame:
    """image_id, pass_no, mean_conf and the rest as JSON."""
    rest = F.to_json(F.struct("variant", "text", F.col("words").cast(WORDS).alias("words"))).alias("packed")
    return passes.filter("image_id is not null and pass_no is not null").select(F.col("image_id").cast("long").alias("image_id"), F.col("pass_no").cast("int").alias("pass_no"), F.coalesce(F.col("mean_conf").cast("double"), F.lit(0.0)).alias("mean_conf"), rest)


def unpacked(rows: DataFrame) -> DataFrame:
    """Passes of rows with image_id, pass_no, mean_conf, packed."""
    return rows.withColumn("p", F.from_json("packed", PACKED)).select("image_id", "pass_no", "p.variant", "p.text", "mean_conf", "p.words")


def once(passes: DataFrame) -> DataFrame:
    """Passes of a batch without repeats, by the rule of the stream."""
    best = F.max(F.struct("mean_conf", "packed")).alias("b")
    return unpacked(packed(passes).groupBy("image_id", "pass_no").agg(best).select("image_id", "pass_no", "b.*"))


def together(passes: DataFrame, variants: int = VARIANTS, turns: int = len(ROTATIONS), rotate_below: float = ROTATE_BELOW, wait_ms: int = 60_000, forget_ms: int = 3_600_000) -> DataFrame:
    """Rows of TOGETHER, one for each revision of an image, from a stream of passes. Passes are numbered from 0 on, turns behind
    variants. State holds the passes of images that may still change, whatever the stream has seen before."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nos, confs, texts, revision, waits = state.get if state.exists else ([], [], [], 0, False)
        if state.hasTimedOut and not waits:
            state.remove()
            return
        held = {n: (c, t) for n, c, t in zip(nos, confs, texts)}
        before, whole = dict(held), False
        if not state.hasTimedOut:
            for frame in frames:
                for n, c, t in zip(frame["pass_no"].tolist(), frame["mean_conf"].tolist(), frame["packed"].tolist()):
                    held[n] = max(held.get(n, (c, t)), (c, t))
            waits = waits or held != before
            good = max(c for c, _ in held.values()) >= rotate_below
            whole = set(range(variants if good else variants + turns)) <= set(held)
        emits = waits and (whole or state.hasTimedOut)
        order = sorted(held)
        columns = (order, [held[n][0] for n in order], [held[n][1] for n in order])
        revision, waits = revision + int(emits), waits and not emits
        state.update((*columns, revision, waits))
        state.setTimeoutDuration(wait_ms if waits else forget_ms)
        if emits:
            yield pd.DataFrame({"image_id": [key[0]], "revision": [revision], "whole": [whole], **{name: [column] for name, column in zip(("nos", "confs", "packed"), columns)}})

    return packed(passes).groupBy("image_id").applyInPandasWithState(run, TOGETHER, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def latest(revisions: DataFrame) -> DataFrame:
    """Passes of the last revision of each image in rows of TOGETHER."""
    last = revisions.groupBy("image_id").agg(F.max_by(F.arrays_zip("nos", "confs", "packed"), "revision").alias("every"))
    each = last.select("image_id", F.explode("every").alias("e")).select("image_id", F.col("e.nos").alias("pass_no"), F.col("e.confs").alias("mean_conf"), F.col("e.packed").alias("packed"))
    return unpacked(each)


def results(passes: DataFrame, engine: Engine, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, trigger: dict[str, Any] | None = None, **waits: Any) -> StreamingQuery:
    """Candidates and merged fields of the images that a micro-batch of a stream of passes has made whole or changed, or that have
    waited long enough: `sink` gets both and the batch's number, the same ones again after a failure. waits: as of `together`.
    The query runs until it is stopped, whatever its trigger, as Spark goes on asking which waits are over."""

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # else state is asked once more for each plan
        sink(*engine.from_passes(latest(kept)), number)
        kept.unpersist()
        engine.keep.release()

    rows = together(passes, rotate_below=engine.rotate_below, **waits)
    return rows.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
