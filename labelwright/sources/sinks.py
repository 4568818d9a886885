"""Sinks: results and failures in two places."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(results: DataFrame, failures: DataFrame, folder: str, batch: int | None = None) -> None:
    """Result documents as lines of JSON below folder/results, nulls included, and failures below folder/failures.

    Without `batch` nothing that is there is replaced: the call fails instead. A batch of a stream has a folder of its own in both
    places, which writing it again replaces, so that after a failure each batch is there once; Spark's committer shows files
    of finished jobs alone. Results are computed once where the caller has kept them.
    """
    for name, rows in (("results", results), ("failures", failures)):
        where = f"{folder.rstrip('/')}/{name}" + ("" if batch is None else f"/batch={batch}")
        rows.write.mode("errorifexists" if batch is None else "overwrite").option("ignoreNullFields", "false").json(where)
