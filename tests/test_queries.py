"""Driver contract, and some queries against their DuckDB twins."""

import glob
import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module
from labelwright.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["master_upsert", "master_merge", "fuzzy_match", "posterior_topk", "verified_flags", "label_fields", "label_numbers", "pass_observations", "merge_passes", "shape_loglik", "otsu_histogram", "jaro_winkler", "grammar_repair", "symbol_repair", "guess_full", "guess_votes"])
def test_twin(spark, name):
    con = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    ours, twin = QUERIES[name](spark, DATA), con.sql(SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(twin.columns)

    def tidy(rows):
        cell = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)
        return sorted(tuple(cell(v) for v in r) for r in rows)

    assert tidy(ours.select(columns).collect()) == tidy(twin.select(", ".join(columns)).fetchall())


def test_registered():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()[-1]) > 30
