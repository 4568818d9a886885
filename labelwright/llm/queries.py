"""Queries of this subpackage for the driver."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact, importance, jaccard, media, mixing, packing, secretscan, sharding, spelling, tokencounts, toxicity, warc
from .common import table

CAPACITY, END = 1024, 2


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), orders=1)
    return drawn.drop("n_words")


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
#: One row with the 256 steps of CRC-32, and the CRC-32 of a text's UTF-8.
_CRC_STEPS = "crc_steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"


def _crc(text: str) -> str:
    units = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {units}), lambda c, u: xor(c >> 8, steps[CAST((xor(c, u) & 255) + 1 AS INT)])), 4294967295)"


_BASE32 = " || ".join(f"substr('{warc.BASE32}', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31 AS INT) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
#: DuckDB twins of the queries that SQL can express.
SQL = {
    "op5_warc": f"""
        WITH t AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages), g AS (SELECT x, max(page_id) AS first FROM t GROUP BY x)
        SELECT page_id, octet_length(encode(x)) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to FROM t JOIN g USING (x)""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
        g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)""",
    "op11_spelling_variants": rf"""
        WITH RECURSIVE {_CRC_STEPS},
        r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{6,}}')) AS run FROM documents),
        d AS (SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS w, count(*) AS n FROM r GROUP BY 1, 2),
        h AS (SELECT w, n, {_crc("concat(doc_id, ':', w)")} AS h FROM d, crc_steps),
        f AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) + 2 AS INT)) ELSE w END AS word, n FROM h),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM f WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
        o AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i + 2 AS INT)) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
        e AS (SELECT a.word, b.word AS near, b.n AS m FROM o a JOIN o b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word AND length(a.word) = length(b.word)
            UNION SELECT v.word, o.word, o.n FROM o JOIN v ON o.cut = v.word UNION SELECT o.word, v.word, v.n FROM o JOIN v ON o.cut = v.word),
        b AS (SELECT word, near, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM e),
        x AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN near END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN b ON v.word = b.word AND place = 1),
        c AS (SELECT word, form AS at FROM x WHERE form IS NOT NULL UNION ALL SELECT c.word, x.form FROM c JOIN x ON c.at = x.word WHERE x.form IS NOT NULL),
        z AS (SELECT c.word, c.at AS root FROM c JOIN x ON c.at = x.word WHERE x.form IS NULL)
        SELECT x.word, form, coalesce(root, x.word) AS root, n, n_near, form_n FROM x LEFT JOIN z ON x.word = z.word""",
    "op13_importance_resampling": rf"""
        WITH {_CRC_STEPS},
        docs AS (SELECT row_number() OVER () AS row, doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS x FROM documents),
        w AS (SELECT row, unnest(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM docs),
        g AS (SELECT unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        k AS (SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT w FROM w UNION SELECT w FROM g), crc_steps),
        s AS (SELECT bucket, count(*) AS s FROM w JOIN k USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (w) GROUP BY 1),
        a AS (SELECT (SELECT count(*) FROM w) + 10000 AS total_s, (SELECT count(*) FROM g) + 10000 AS total_t),
        gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * total_s / (CAST(s + 1 AS DOUBLE) * total_t))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), a),
        f AS (SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN k USING (w) JOIN gains USING (bucket) GROUP BY 1),
        d AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || left(sha256(concat('2024:', doc_id)), 8) AS BIGINT) AS h FROM docs LEFT JOIN f USING (row)),
        c AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS eligible FROM c)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM o""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return SQL
