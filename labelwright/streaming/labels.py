"""A stream of label texts or observations against a static master list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.labels import parse_labels
from ..plans.pipeline import Engine


def parsed(texts: DataFrame) -> DataFrame:
    """Fields of a stream of texts (req_id, text): stateless, hence the plan of a batch."""
    return parse_labels(texts)


def guesses(texts: DataFrame, engine: Engine, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Ranks each micro-batch as a whole (requests don't span batches); `sink` gets candidates, verdicts and the batch's number."""

    def each(batch: DataFrame, number: int) -> None:
        ranked = engine.guess(engine.text_observations(batch))
        sink(ranked, engine.verified(ranked), number)

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
