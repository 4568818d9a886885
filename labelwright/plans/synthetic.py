"""Inputs made of the driver's tables by SQL that Spark and DuckDB both run.

Known codes are the suppliers' (weighted by their line items) and the parts'; observations are the customers', each a
supplier's code damaged in one of six ways; labels are the orders'. All rows of these tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.guess import SYMBOLS
from ..operators.labels import words_of_text

TABLES = ("supplier", "lineitem", "part", "customer", "orders")


def code(k: str) -> str:
    """A code of two letters and six digits, another for each k below 900000."""
    return f"concat(chr(CAST(65 + ({k}) % 26 AS INT)), chr(CAST(65 + CAST(floor(({k}) / 26) AS INT) % 26 AS INT)), lpad(CAST(100000 + ({k}) * 7919 % 900000 AS STRING), 6, '0'))"


MASTER = f"""SELECT {code('s_suppkey')} AS code, s_name AS description, CAST(count(l_suppkey) AS DOUBLE) AS cnt
    FROM {{supplier}} LEFT JOIN {{lineitem}} ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name"""
PARTS = f"SELECT {code('p_partkey')} AS code, p_name AS description, CAST(p_size AS DOUBLE) AS cnt FROM {{part}}"
#: Entries as they come: codes repeat in other spellings, counts may be missing or not positive, descriptions empty.
ENTRIES = f"""SELECT CASE p_partkey % 3 WHEN 0 THEN lower({code('p_partkey % 700')}) WHEN 1 THEN concat(' ', {code('p_partkey % 700')}) ELSE {code('p_partkey % 700')} END AS code,
    CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END AS description, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size - 3 AS DOUBLE) END AS cnt, p_partkey AS ord FROM {{part}}"""
OBSERVATIONS = f"""SELECT req_id, 1 AS obs_no, true_code,
    CASE req_id % 6 WHEN 0 THEN true_code WHEN 1 THEN replace(true_code, '0', 'O') WHEN 2 THEN replace(true_code, '1', 'I') WHEN 3 THEN replace(true_code, '5', 'S')
        WHEN 4 THEN concat(substr(true_code, 1, 2), '.', substr(true_code, 3)) ELSE substr(true_code, 1, 7) END AS text,
    CASE req_id % 4 WHEN 0 THEN 'ArticleField' WHEN 1 THEN 'QualityField' WHEN 2 THEN 'RawToken' ELSE 'UserText' END AS source, CAST(0.5 + 0.05 * (req_id % 10) AS DOUBLE) AS conf
    FROM (SELECT c_custkey AS req_id, {code('c_custkey % n')} AS true_code FROM {{customer}} CROSS JOIN (SELECT count(*) AS n FROM {{supplier}}))"""
#: Up to three observations of a request: as above, the code itself, and a neighbour's.
VOTES = f"""SELECT req_id, v AS obs_no, CASE v WHEN 1 THEN text WHEN 2 THEN true_code ELSE concat(substr(true_code, 1, 7), '?') END AS text,
    CASE v WHEN 1 THEN source WHEN 2 THEN 'RawToken' ELSE 'QualityField' END AS source, CAST(conf - 0.1 * v AS DOUBLE) AS conf FROM ({OBSERVATIONS.replace("1 AS obs_no, ", "")}) CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3) WHERE v <= 1 + req_id % 3"""
#: Characters of the observations as symbols of five kinds (DuckDB), and the readings that a kind offers; a null is the character itself.
SYMBOL_CHARS = """SELECT req_id AS id, i AS t, upper(substr(text, CAST(i AS INT), 1)) AS char, CAST(3 + (req_id + i) % 5 * 2 AS DOUBLE) / 10 AS conf, CAST((req_id + i) % 5 AS INT) AS kind
    FROM (SELECT req_id, text, unnest(range(1, length(text) + 1)) AS i FROM {})"""
CHOICES = ((1, 1, None, 0.55), (1, 2, "0", 0.25), (2, 1, "8", 0.5), (2, 2, None, 0.3), (2, 3, "b", 0.1), (3, 1, "X", 0.01), (4, 1, "o", 0.9), (4, 2, "-", 0.05))
SYMBOL_CHOICES = "SELECT * FROM (VALUES " + ", ".join(f"({k}, {n}, {'NULL' if c is None else repr(c)}, {p}::DOUBLE)" for k, n, c, p in CHOICES) + ") c(kind, nth, char, p)"
LABELS = f"""SELECT o_orderkey AS req_id, concat(
    'MILL ', o_orderkey % 7, chr(10), 'Quality : TE', lpad(CAST(o_orderkey % 900000 AS STRING), 6, '0'), 'FX2', chr(10),
    CASE o_orderkey % 3 WHEN 0 THEN 'Color : EPB80772HPM' WHEN 1 THEN 'Color : V01A001A Black 0813' ELSE 'Color : Mocha Taffy' END, chr(10),
    'Batch : V', o_orderkey * 31 % 100000, '  Roll : ', o_orderkey % 50, chr(10), CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(423061000000 + o_orderkey, chr(10)) END,
    'Width : ', 140 + o_orderkey % 30, 'cm 2023-06-', lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), chr(10),
    'QTY : ', 10 + o_orderkey % 90, CASE WHEN o_orderkey % 2 = 0 THEN '.50Y' ELSE ',25M' END, ' Weight: ', 150 + o_orderkey % 200, ' g/m2', chr(10),
    'Gross : ', 10 + o_orderkey % 20, '.00KG Free:', chr(10), 'PO. No. : TM-', o_orderkey, ' Net: ', o_orderkey % 20, '.50KG', chr(10),
    'Article : ', {code('o_orderkey % 20000')}, chr(10), 'Color : Blue ', o_orderkey % 7, chr(10), 'Remark :') AS text FROM {{orders}}"""
#: Labels whose keys are damaged in several ways, some beyond recognition.
DAMAGED = f"""SELECT req_id, replace(replace(replace(replace(replace(text, 'Quality', CASE req_id % 4 WHEN 0 THEN 'Qua1ity' WHEN 1 THEN 'QuaIitv' WHEN 2 THEN 'Oualty' ELSE 'Xuxlxty' END),
    'Color', CASE req_id % 3 WHEN 0 THEN 'Co1or' WHEN 1 THEN 'C0l0r' ELSE 'Cloor' END), 'Article', CASE req_id % 3 WHEN 0 THEN 'Artic1e' WHEN 1 THEN 'Articel' ELSE 'Art.' END),
    'Batch', CASE req_id % 2 WHEN 0 THEN '8atch' ELSE 'Bateh' END), 'Weight', CASE req_id % 2 WHEN 0 THEN 'Weigth' ELSE 'Wight' END) AS text FROM ({LABELS})"""
#: Passes of the customers' labels: a grey reading without its Article line, a thresholded one, and an empty one.
PASSES = f"""SELECT c_custkey AS image_id, v AS pass_no, CASE v WHEN 0 THEN 'gray' WHEN 1 THEN 'sauvola' ELSE 'otsu' END AS variant,
    CASE v WHEN 0 THEN concat('Quality : TE', lpad(CAST(c_custkey AS STRING), 6, '0'), 'FX2', chr(10), 'Batch : V', c_custkey, chr(10), 'Color : Mocha Taffy')
        WHEN 1 THEN concat('Article : ', {code('c_custkey % n')}, ' Mocha', chr(10), CASE WHEN c_custkey % 3 = 0 THEN 'Batch : ???' ELSE concat('Batch : W', c_custkey) END, chr(10), {code('(c_custkey + 1) % n')}) ELSE '' END AS text,
    CAST(CASE WHEN v = 2 OR c_custkey % 11 = 0 THEN 0 WHEN v = 0 THEN 0.5 + 0.04 * (c_custkey % 10) ELSE 0.9 - 0.05 * (c_custkey % 8) END AS DOUBLE) AS mean_conf
    FROM {{customer}} CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2) CROSS JOIN (SELECT count(*) AS n FROM {{supplier}})"""
#: A pixel per line item: an image per supplier, its levels from quantity and discount.
PIXELS = "SELECT l_suppkey AS image_id, CAST(CASE WHEN l_quantity < 25 THEN 40 + l_quantity ELSE 160 + l_quantity END AS INT) AS level FROM {lineitem}"


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **named)


def duck(sql: str) -> str:
    """The same for DuckDB, in parentheses."""
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return f"({sql})"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, OBSERVATIONS).withColumn("symbols", F.lit(None).cast(SYMBOLS))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, VOTES).withColumn("symbols", F.lit(None).cast(SYMBOLS))


def symbol_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations with a symbol for each character, as SYMBOL_CHARS has them."""

    def symbol(char, i):  # noqa: ANN001, ANN202
        kind = (F.col("req_id") + i + 1) % 5
        offers = F.lit(None)
        for k in range(5):
            own = [F.struct((char if c is None else F.lit(c)).alias("ch"), F.lit(p).alias("p")) for n, _, c, p in CHOICES if n == k]
            offers = F.when(kind == k, F.array(*own) if own else F.array().cast("array<struct<ch:string,p:double>>")).otherwise(offers)
        return F.struct(char.alias("ch"), ((3 + kind * 2).cast("double") / 10).alias("conf"), offers.alias("choices"))

    return frame(spark, sf_dir, OBSERVATIONS).withColumn("symbols", F.transform(F.split("text", ""), symbol).cast(SYMBOLS))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out, as the driver's table of orders is one row group, which one task reads."""
    return frame(spark, sf_dir, LABELS).repartition(spark.sparkContext.defaultParallelism)


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, PASSES).withColumn("words", words_of_text(F.col("text"), 0.7))
