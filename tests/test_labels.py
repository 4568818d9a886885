"""Labels: values that resemble keys, and what a plan evaluates."""

from pyspark.sql import functions as F

from labelwright.operators import labels

TEXTS = ["Batch : V8055 Roll : 7\nC010R : Mocha", "BP 0RDER N. 12 W101 : 3\r\nQuaIity\t: TE000123FX2", "PO. No. : TM-1 20231 2023-06-01 Net: .5KG", "", None]


def test_number_is_no_key(spark):
    """V8055 comes near GROSS, but is a batch."""
    row = labels.parse_labels(spark.createDataFrame([(1, TEXTS[0])], "req_id long, text string")).first()
    assert (row.batch, row.roll, row.gross, row.color_name) == ("V8055", "7", None, "Mocha")


def test_text_as_words(spark):
    """Plain text gives the fields that its words give."""
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "req_id long, text string")
    fields = lambda df: {r.req_id: [f[:4] for f in r.fields] for r in df.collect()}
    by_words = labels.with_fields(rows.withColumn("words", labels.words_of_text(F.col("text"))))
    found = fields(labels.parse_labels(rows))
    assert found == fields(by_words) and sum(map(len, found.values())) > 5


def test_python_once(spark):
    """The map of fields is not evaluated again for a filter of its size."""
    from labelwright.plans.queries import QUERIES

    plan = QUERIES["fields_map"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "size(map_filter" not in plan and plan.count("ArrowEvalPython") <= 1
