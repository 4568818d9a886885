"""Queries over the driver's tables, with DuckDB twins where SQL can express them. Doubles are rounded to six digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import confusion, metrics
from ..functions import text as T
from ..functions.grammar import PATTERNS, Grammar
from ..operators import guess as G
from ..operators import image, labels, master, passes, render
from ..operators.repair import repairs
from ..sources.readers import master_lines
from . import duck
from . import synthetic as S
from .keeping import Kept
from .pipeline import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Shared parts of the twins.
D_MASTER, D_PARTS, D_ENTRIES, D_OBS, D_LABELS, D_PASSES, D_PIXELS = map(S.duck, (S.MASTER, S.PARTS, S.ENTRIES, S.OBSERVATIONS, S.LABELS, S.PASSES, S.PIXELS))
D_NORMAL = "upper(regexp_replace({}, '\\s+', '', 'g'))"
D_CLEAN = "nullif(trim(" + D_NORMAL + ", ':.,;-_|''\"`=*'), '')"
NO_REPAIR = G.GuessParams()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def named(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return named


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


@query(f"""WITH e AS (SELECT {D_NORMAL.format('code')} AS code, trim(description) AS d, CASE WHEN cnt > 0 THEN cnt ELSE 1 END AS c, ord FROM {D_ENTRIES})
    SELECT code, arg_min(d, ord) FILTER (WHERE d <> '') AS description, CAST(sum(c) AS DOUBLE) AS cnt FROM e GROUP BY code""")
def master_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.upsert(S.frame(spark, sf_dir, S.ENTRIES), "ord").drop("ord")


@query(f"""WITH e AS (SELECT {D_NORMAL.format('code')} AS code, trim(description) AS d, CASE WHEN cnt > 0 THEN cnt ELSE 1 END AS c, ord FROM {D_ENTRIES})
    SELECT code, arg_min(d, ord) FILTER (WHERE d <> '') AS description, CAST(sum(c) AS DOUBLE) AS cnt, min(ord) AS ord FROM e GROUP BY code""")
def master_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of the first half of the entries, then of a quarter more, then of the rest."""
    entries = S.frame(spark, sf_dir, S.ENTRIES)
    last = entries.agg(F.max("ord")).first()[0] or 0
    rows = master.upsert(entries.filter(F.col("ord") <= last // 2), "ord")
    for low, high in ((last // 2, last * 3 // 4), (last * 3 // 4, last)):
        rows = master.merged(rows, entries.filter((F.col("ord") > low) & (F.col("ord") <= high)), "ord")
    return rows


@query(f"""WITH m AS {D_MASTER}, t AS (SELECT sum(cnt) AS s, count(*) AS n FROM m)
    SELECT p.code, round((coalesce(m.cnt, 0) + 1) / (s + n), 6) AS prior FROM {D_PARTS} p LEFT JOIN m ON p.code = m.code CROSS JOIN t""")
def master_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.frame(spark, sf_dir, S.PARTS).select("code")
    return master.with_prior(rows, S.frame(spark, sf_dir, S.MASTER)).withColumn("prior", r6("prior"))


@query(f"""WITH l AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN '# note' WHEN p_partkey % 10 = 0 THEN 'Code,Description,Count'
        ELSE concat('"', code, '"', CASE WHEN p_partkey % 2 = 0 THEN ';' ELSE ', ' END, p_name, chr(9), CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END) END AS value
        FROM (SELECT *, {S.code('p_partkey')} AS code FROM part)),
    c AS (SELECT list_transform(string_split_regex(value, '[,;\t]'), lambda x: trim(trim(trim(x), '"'))) AS c FROM l WHERE value NOT LIKE '#%')
    SELECT {D_NORMAL.format('c[1]')} AS code, nullif(c[2], '') AS description, CASE WHEN TRY_CAST(c[3] AS DOUBLE) > 0 THEN TRY_CAST(c[3] AS DOUBLE) ELSE 1 END AS cnt FROM c WHERE upper(c[1]) <> 'CODE'""")
def master_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"""SELECT CASE WHEN p_partkey % 9 = 0 THEN '# note' WHEN p_partkey % 10 = 0 THEN 'Code,Description,Count'
        ELSE concat('"', {S.code('p_partkey')}, '"', CASE WHEN p_partkey % 2 = 0 THEN ';' ELSE ', ' END, p_name, chr(9), CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END) END AS value FROM {{part}}"""
    return master_lines(S.frame(spark, sf_dir, text))


@query(f"SELECT req_id, o.text AS code, m.cnt FROM {D_OBS} o JOIN {D_MASTER} m ON o.text = m.code")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = S.frame(spark, sf_dir, S.MASTER)
    return S.observations(spark, sf_dir).select("req_id", T.normalize_code(F.col("text")).alias("code")).join(known.select("code", "cnt"), "code")


D_PAIRS = f"SELECT DISTINCT o.text AS a, m.code AS b FROM {D_OBS} o, {D_MASTER} m WHERE abs(length(o.text) - length(m.code)) <= 3 AND o.text <> m.code"
D_NEAR = f"(SELECT a, b, distance FROM ({duck.distances(D_PAIRS)}) WHERE distance / greatest(length(a), length(b)) <= 0.45)"


@query(f"SELECT req_id, a AS observed, b AS code, round(distance, 6) AS distance FROM {D_OBS} o JOIN {D_NEAR} n ON o.text = n.a")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = S.observations(spark, sf_dir).select("req_id", T.normalize_code(F.col("text")).alias("observed"))
    near = G.fuzzy(seen, G.ordered_master(_master(spark, sf_dir)), NO_REPAIR)
    return seen.join(near, "observed").select("req_id", "observed", "code", r6("distance").alias("distance"))


@query(f"""WITH d AS ({duck.distances(f"SELECT text AS a, true_code AS b FROM {D_OBS}")})
    SELECT req_id, round(distance, 6) AS distance, round(distance / greatest(length(text), length(true_code)), 6) AS normalised FROM {D_OBS} o JOIN d ON o.text = d.a AND o.true_code = d.b""")
def weighted_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.observations(spark, sf_dir).select("req_id", "text", "true_code", metrics.weighted_distance(F.col("text"), F.col("true_code")).alias("d"))
    return rows.select("req_id", r6("d").alias("distance"), r6(metrics.normalised(F.col("d"), F.col("text"), F.col("true_code"))).alias("normalised"))


@query(f"""WITH d AS ({duck.distances(f"SELECT text AS a, true_code AS b FROM {D_OBS}")})
    SELECT req_id, round(distance, 6) AS distance FROM {D_OBS} o JOIN d ON o.text = d.a AND o.true_code = d.b""")
def weighted_edit_distance_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.observations(spark, sf_dir)
    return rows.select("req_id", r6(metrics.weighted_distance_expr(F.col("text"), F.col("true_code"))).alias("distance"))


D_HYPS = f"""WITH m AS {D_MASTER}, o AS {D_OBS}, near AS {D_NEAR}, t AS (SELECT sum(cnt) AS s, count(*) AS n FROM m),
    h AS (SELECT req_id, text AS observed, source, conf, code, 'Exact' AS method, 1 AS gen, 0::DOUBLE AS distance FROM o JOIN m ON o.text = m.code
        UNION ALL SELECT req_id, text, source, conf, b, 'MasterList', 2, distance FROM o JOIN near ON o.text = near.a
        UNION ALL SELECT req_id, text, source, conf, text, CASE WHEN {' OR '.join(f"regexp_matches(text, '{p}')" for p in PATTERNS)} THEN 'GrammarOnly' ELSE 'Unverified' END, 4, 0::DOUBLE FROM o WHERE text NOT IN (SELECT code FROM m)),
    w AS (SELECT h.*, (coalesce(m.cnt, 0) + 1) / (s + n) * exp(-2.0 * distance) * (0.5 + 0.5 * conf)
            * CASE source WHEN 'QualityField' THEN 0.6 WHEN 'RawToken' THEN 0.4 ELSE 1.0 END
            * CASE WHEN {' OR '.join(f"regexp_matches(h.code, '{p}')" for p in PATTERNS)} THEN 1.0 ELSE 0.35 END AS weight FROM h LEFT JOIN m ON h.code = m.code CROSS JOIN t),
    p AS (SELECT *, weight / (sum(weight) OVER (PARTITION BY req_id) + {NO_REPAIR.unknown}::DOUBLE) AS probability FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY round(probability, 12) DESC, round(distance, 12), gen, code) AS rank FROM p)"""


#: What the last query has cached; the next one gives it back.
_KEPT = Kept()


def _master(spark: SparkSession, sf_dir: str) -> DataFrame:
    _KEPT.release()
    return _KEPT(S.frame(spark, sf_dir, S.MASTER))


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(_master(spark, sf_dir), keep=_KEPT)


def _without_repair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known = _master(spark, sf_dir)
    return G.guess(S.observations(spark, sf_dir), known, with_repair=False, keep=_KEPT), known


@query(D_HYPS + " SELECT req_id, CAST(rank AS INT) AS rank, code, method, round(distance, 6) AS distance, round(weight, 6) AS weight, round(probability, 6) AS probability FROM r WHERE rank <= 10")
def posterior_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, _ = _without_repair(spark, sf_dir)
    return ranked.select("req_id", "rank", "code", "method", *(r6(c).alias(c) for c in ("distance", "weight", "probability")))


@query(D_HYPS + """, v AS (SELECT *, probability - coalesce(lead(probability) OVER (PARTITION BY req_id ORDER BY rank), 0) AS margin FROM r WHERE rank <= 10)
    SELECT req_id, code, round(probability, 6) AS probability, round(margin, 6) AS margin,
        probability >= 0.6 AND method <> 'Unverified' AND distance <= 0.9 AND margin >= 0.25 AND code IN (SELECT code FROM m) AS verified FROM v WHERE rank = 1""")
def verified_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, known = _without_repair(spark, sf_dir)
    return G.verified(ranked, known).select("req_id", "code", r6("probability").alias("probability"), r6("margin").alias("margin"), "verified")


@query(f"""SELECT req_id, round(jaro, 6) AS jaro, round(winkler, 6) AS jaro_winkler FROM {D_OBS} o
    JOIN ({duck.jaros(f"SELECT text AS a, true_code AS b FROM {D_OBS}")}) j ON j.a = o.text AND j.b = o.true_code""")
def jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("text"), F.col("true_code")
    return S.observations(spark, sf_dir).select("req_id", r6(metrics.jaro(a, b)).alias("jaro"), r6(metrics.jaro_winkler(a, b)).alias("jaro_winkler"))


@query(f"""WITH o AS {D_OBS}, g AS (SELECT req_id, s, unnest(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS gram FROM
        (SELECT req_id, 1 AS s, '^' || upper(text) || '$' AS x FROM o UNION ALL SELECT req_id, 2, '^' || upper(true_code) || '$' FROM o)),
    c AS (SELECT req_id, s, gram, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY ALL),
    d AS (SELECT x.req_id, sum(x.n * y.n) AS dot FROM c x JOIN c y ON x.req_id = y.req_id AND x.gram = y.gram AND x.s = 1 AND y.s = 2 GROUP BY x.req_id),
    z AS (SELECT req_id, sqrt(sum(n * n) FILTER (WHERE s = 1)) * sqrt(sum(n * n) FILTER (WHERE s = 2)) AS norm FROM c GROUP BY req_id)
    SELECT req_id, round(coalesce(dot, 0) / norm, 6) AS cosine FROM z LEFT JOIN d USING (req_id)""")
def ngram_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.observations(spark, sf_dir).select("req_id", r6(metrics.ngram_cosine(F.col("text"), F.col("true_code"))).alias("cosine"))


@query(f"""SELECT req_id, a, b, CASE WHEN a = b THEN 1 ELSE coalesce({duck.SIMILAR}[a || b], 0) END AS similarity FROM
    (SELECT req_id, substr(text, 3, 1) AS a, substr(true_code, 4, 1) AS b FROM {D_OBS})""")
def char_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.observations(spark, sf_dir).select("req_id", F.substring("text", 3, 1).alias("a"), F.substring("true_code", 4, 1).alias("b"))
    return rows.select("req_id", "a", "b", confusion.similarity_column(F.col("a"), F.col("b")).alias("similarity"))


@query(f"SELECT req_id, text, {' OR '.join(f'''regexp_matches(text, '{p}')''' for p in PATTERNS)} AS valid FROM {D_OBS}")
def code_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.observations(spark, sf_dir).select("req_id", "text", Grammar().valid_column(F.col("text")).alias("valid"))


@query(f"""WITH t AS (SELECT req_id, unnest(string_split_regex(text, '\\s+')) AS token FROM {D_LABELS}), n AS (SELECT *, length(token) AS n, length(regexp_replace(token, '[^0-9]', '', 'g')) AS d, length(regexp_replace(token, '[^A-Za-z]', '', 'g')) AS l FROM t)
    SELECT req_id, token FROM n WHERE n BETWEEN 5 AND 19 AND d >= 3 AND l >= 1 AND NOT regexp_matches(token, '[.,:;%"'']') AND regexp_matches(token, '^[A-Za-z0-9]') AND d + l >= n - 1""")
def plausible_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = S.labels(spark, sf_dir).select("req_id", F.explode(F.split("text", r"\s+")).alias("token"))
    return tokens.filter(Grammar().plausible_column(F.col("token")))


D_CLASS = duck.CLASS
D_SHAPES = duck.shapes(D_PARTS)


def _parts_grammar(spark: SparkSession, sf_dir: str) -> Grammar:
    return Grammar.learn(S.frame(spark, sf_dir, S.PARTS))


@query(f"WITH {D_SHAPES} SELECT CAST(pos AS INT) AS pos, CAST(cls AS INT) AS cls, round(p, 6) AS p FROM profile")
def positional_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _parts_grammar(spark, sf_dir)
    return spark.createDataFrame([(i, k, round(float(p), 6)) for i, row in enumerate(own.profile) for k, p in enumerate(row)], "pos int, cls int, p double")


@query(f"WITH {D_SHAPES} SELECT CAST(before AS INT) AS before, CAST(cls AS INT) AS cls, round(p, 6) AS p FROM transition")
def class_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _parts_grammar(spark, sf_dir)
    return spark.createDataFrame([(a, k, round(float(p), 6)) for a, row in enumerate(own.transition) for k, p in enumerate(row)], "before int, cls int, p double")


@query(f"""WITH {D_SHAPES}, o AS {D_OBS},
    x AS (SELECT req_id, i AS pos, {D_CLASS.format('substr(text, CAST(i + 1 AS INT), 1)')} AS cls FROM (SELECT req_id, text, unnest(range(length(text))) AS i FROM o)),
    y AS (SELECT *, lag(cls) OVER (PARTITION BY req_id ORDER BY pos) AS before FROM x)
    SELECT req_id, round(sum(ln(p.p) + coalesce(ln(t.p), 0)), 6) AS log_likelihood FROM y JOIN profile p ON p.pos = least(y.pos, (SELECT max(pos) FROM profile)) AND p.cls = y.cls LEFT JOIN transition t ON t.before = y.before AND t.cls = y.cls GROUP BY req_id""")
def shape_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.observations(spark, sf_dir).select("req_id", r6(_parts_grammar(spark, sf_dir).log_likelihood_column(F.col("text"))).alias("log_likelihood"))


@query(f"""WITH {D_SHAPES} SELECT string_agg(shape, '' ORDER BY pos) AS shape FROM
    (SELECT pos, substr('LD-', CAST(1 + arg_max(cls, p - 0.000000001 * cls) AS INT), 1) AS shape FROM profile GROUP BY pos)""")
def shape_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_parts_grammar(spark, sf_dir).shape(),)], "shape string")


@query(f"""SELECT req_id, {D_NORMAL.format('line')} AS normalised, {D_CLEAN.format('line')} AS cleaned, translate(upper(regexp_replace(line, '[^A-Za-z0-9]', '', 'g')), '1058', 'IOSB') AS letters
    FROM (SELECT req_id, unnest(string_split(text, chr(10))) AS line FROM {D_LABELS})""")
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.labels(spark, sf_dir).select("req_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("req_id", T.normalize_code(F.col("line")).alias("normalised"), T.clean_code(F.col("line")).alias("cleaned"), T.letters_key(F.col("line")).alias("letters"))


D_WORDS = f"""lines AS (SELECT req_id, string_split(text, chr(10)) AS l FROM {D_LABELS}),
    numbered AS (SELECT req_id, CAST(i - 1 AS INT) AS line, list_filter(string_split_regex(l[i], '[ \t]+'), lambda w: w <> '') AS w FROM (SELECT req_id, l, unnest(range(1, length(l) + 1)) AS i FROM lines)),
    words AS (SELECT req_id, line, CAST(j - 1 AS INT) AS nth, w[j] AS word FROM (SELECT *, unnest(range(1, length(w) + 1)) AS j FROM numbered))"""


@query(f"WITH {D_WORDS} SELECT * FROM words")
def label_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.labels(spark, sf_dir).select("req_id", F.explode(labels.words_of_text(F.col("text"))).alias("w"))
    first = F.min("w.pos").over(Window.partitionBy("req_id", "w.line"))
    return rows.select("req_id", F.col("w.line").alias("line"), (F.col("w.pos") - first).alias("nth"), F.col("w.text").alias("word"))


_ALIASES = ", ".join(f"('{a}', '{k}')" for k, own in labels.KEYS.items() for a in own)
D_FIELDS = f"""{D_WORDS}, keyed AS (SELECT w.*, CASE WHEN letters = 'PO' AND lead(letters) OVER o = 'NO' THEN 'PoNo' WHEN lag(letters) OVER o = 'PO' AND letters = 'NO' THEN NULL ELSE a.key END AS key,
        lag(letters) OVER o = 'PO' AND letters = 'NO' AS eaten FROM (SELECT *, translate(upper(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')), '1058', 'IOSB') AS letters FROM words) w
        LEFT JOIN (VALUES {_ALIASES}) a(alias, key) ON a.alias = w.letters WINDOW o AS (PARTITION BY req_id, line ORDER BY nth)),
    grouped AS (SELECT *, count(key) OVER (PARTITION BY req_id, line ORDER BY nth) AS field FROM keyed),
    fields AS (SELECT req_id, line, field, max(key) AS key, trim(ltrim(trim(regexp_replace(coalesce(string_agg(word, ' ' ORDER BY nth) FILTER (WHERE key IS NULL AND NOT coalesce(eaten, false)), ''), '20\\d{{2}}[-/.]\\d{{2}}[-/.]\\d{{2}}', '', 'g')), ':.-_|;,''" =')) AS value
        FROM grouped WHERE field > 0 GROUP BY req_id, line, field)"""


@query(f"WITH {D_FIELDS} SELECT req_id, line, key, value FROM fields")
def segment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.parse_labels(S.labels(spark, sf_dir)).select("req_id", F.explode("fields").alias("f"))
    return rows.select("req_id", "f.line", "f.key", "f.value")


def _keys() -> str:
    """SQL of w (letters of a word) and key, by distance: the first key in the list's order with an alias near enough."""
    near = duck.distances("SELECT w AS a, alias AS b FROM seen JOIN listed ON length(alias) > 3 AND abs(length(alias) - length(w)) <= 2 AND alias <> w")
    return f"""SELECT w, arg_min(key, nth) AS key FROM (SELECT w, key, nth FROM seen JOIN listed ON alias = w
        UNION ALL SELECT a, key, nth FROM ({near}) JOIN listed ON alias = b WHERE distance / greatest(length(a), length(b)) <= 0.30) GROUP BY w"""


_LISTED = ", ".join(f"({i}, '{a}', '{k}')" for i, (a, k) in enumerate((a, k) for k, own in labels.KEYS.items() for a in own))


@query(f"""WITH words AS (SELECT req_id, unnest(string_split_regex(text, '\\s+')) AS word FROM {S.duck(S.DAMAGED)}),
    lettered AS (SELECT req_id, word, translate(upper(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')), '1058', 'IOSB') AS w FROM words),
    seen AS MATERIALIZED (SELECT DISTINCT w FROM lettered WHERE w <> ''), listed AS (SELECT * FROM (VALUES {_LISTED}) l(nth, alias, key)), keyed AS MATERIALIZED ({_keys()})
    SELECT req_id, word, key, count(*) AS n FROM lettered JOIN keyed USING (w) GROUP BY ALL""")
def fuzzy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of labels that stand for a key, by the weighted distance from its aliases."""
    words = S.frame(spark, sf_dir, S.DAMAGED).select("req_id", F.explode(F.split("text", r"\s+")).alias("word"))
    return labels.key_words(words).filter("key is not null").groupBy("req_id", "word", "key").agg(F.count("*").alias("n"))


def _first(key: str, clean: bool = False) -> str:
    value = D_CLEAN.format("value") if clean else "nullif(value, '')"
    return f"arg_min({value}, line * 100 + field) FILTER (WHERE key = '{key}' AND {value} IS NOT NULL)"


D_NUMBER = "TRY_CAST(replace(nullif(regexp_extract({}, '[0-9]+([.,][0-9]+)?', 0), ''), ',', '.') AS DOUBLE)"
D_LABEL_FIELDS = f"""{D_FIELDS}, wide AS (SELECT req_id, {', '.join(f'{_first(k, True)} AS {c}' for c, k in labels.CODES.items())}, {', '.join(f'{_first(k)} AS {c}' for c, k in labels.TEXTS.items())},
        {_first('Color')} AS color, list(value ORDER BY line, field) FILTER (WHERE key = 'Color' AND value <> '') AS colors FROM fields GROUP BY req_id),
    parsed AS (SELECT wide.*, CASE WHEN regexp_matches(split_part(color, ' ', 1), '[0-9]') THEN split_part(color, ' ', 1) END AS color_code,
        coalesce(CASE WHEN regexp_matches(split_part(color, ' ', 1), '[0-9]') THEN nullif(substr(color, length(split_part(color, ' ', 1)) + 2), '') ELSE color END, colors[2]) AS color_name,
        nullif(regexp_extract(text, '(^|[^0-9])([0-9]{{12,14}})([^0-9]|$)', 2), '') AS barcode, nullif(regexp_extract(text, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}', 0), '') AS date FROM wide JOIN {D_LABELS} USING (req_id)),
    numbers AS (SELECT *, {D_NUMBER.format('width')} AS width_cm, {D_NUMBER.format('quantity')} * CASE WHEN regexp_extract(upper(quantity), '[YM]', 0) = 'Y' THEN 0.9144 ELSE 1 END AS quantity_m,
        {D_NUMBER.format('gross')} AS gross_kg, {D_NUMBER.format('net')} AS net_kg, {D_NUMBER.format('weight')} AS gsm FROM parsed)"""


@query(f"WITH {D_LABEL_FIELDS} SELECT req_id, {', '.join(labels.STRINGS)} FROM numbers")
def label_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.parse_labels(S.labels(spark, sf_dir)).select("req_id", *labels.STRINGS)


@query(f"""WITH {D_LABEL_FIELDS} SELECT req_id, width_cm, round(quantity_m, 6) AS quantity_m, gross_kg, net_kg, gsm,
    round(CASE WHEN net_kg > 0 THEN net_kg / (gsm * (width_cm / 100) * quantity_m / 1000) END, 6) AS weight_consistency FROM numbers""")
def label_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.parse_labels(S.labels(spark, sf_dir)).select("req_id", *(r6(c).alias(c) for c in labels.NUMBERS))


@query(f"""WITH {D_LABEL_FIELDS}, long AS (UNPIVOT (SELECT req_id, {', '.join(labels.STRINGS)} FROM numbers) ON {', '.join(labels.STRINGS)} INTO NAME key VALUE value)
    SELECT req_id, key, value FROM long WHERE trim(value) <> ''""")
def fields_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.fields_map(labels.parse_labels(S.labels(spark, sf_dir))).select("req_id", F.explode_outer("fields_map").alias("key", "value")).filter("key is not null")


@query(f"""SELECT req_id, nullif(regexp_extract(text, '(^|[^0-9])([0-9]{{12,14}})([^0-9]|$)', 2), '') AS barcode, nullif(regexp_extract(text, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}', 0), '') AS date FROM {D_LABELS}""")
def barcode_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.labels(spark, sf_dir).select("req_id", T.barcode(F.col("text")).alias("barcode"), T.iso_date(F.col("text")).alias("date"))


D_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY mean_conf DESC, pass_no) AS pass_rank FROM {D_PASSES})"


@query(f"WITH {D_RANKED} SELECT image_id, variant AS best_variant, text AS raw_text, round(mean_conf, 6) AS ocr_confidence FROM ranked WHERE pass_rank = 1")
def best_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.best_pass(S.passes(spark, sf_dir)).withColumn("ocr_confidence", r6("ocr_confidence"))


@query(f"WITH {D_RANKED} SELECT image_id, variant AS best_variant FROM ranked WHERE pass_rank = 1 AND mean_conf < 0.35")
def rotation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.passes(spark, sf_dir)
    return passes.need_rotation(rows.select("image_id").distinct(), rows)


D_SEEN = f"""{D_RANKED}, field AS (SELECT image_id, pass_rank, 0 AS kind, CASE WHEN text LIKE 'Article%' THEN regexp_extract(text, 'Article : (\\S+)', 1) ELSE regexp_extract(text, 'Quality : (\\S+)', 1) END AS text,
        CASE WHEN text LIKE 'Article%' THEN 'ArticleField' ELSE 'QualityField' END AS source, 0.7 * (0.5 + 0.5 * mean_conf) AS conf, 0 AS nth FROM ranked WHERE text <> ''),
    tokens AS (SELECT image_id, pass_rank, mean_conf, unnest(string_split_regex(text, '\\s+')) AS t, generate_subscripts(string_split_regex(text, '\\s+'), 1) AS nth FROM ranked WHERE text <> ''),
    raw AS (SELECT image_id, pass_rank, 1 AS kind, {D_CLEAN.format('t')} AS text, 'RawToken' AS source, 0.7 * (0.5 + 0.5 * mean_conf) AS conf, nth FROM tokens),
    plausible AS (SELECT * FROM raw WHERE length(text) BETWEEN 7 AND 10 AND length(regexp_replace(text, '[^0-9]', '', 'g')) >= 3 AND regexp_matches(text, '[A-Z]') AND regexp_matches(text, '^[A-Z0-9]+$')),
    every AS (SELECT * FROM field UNION ALL SELECT * FROM plausible),
    marked AS (SELECT *, row_number() OVER (PARTITION BY image_id, text ORDER BY pass_rank, kind, nth) AS n FROM every)"""


@query(f"WITH {D_SEEN} SELECT image_id AS req_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pass_rank, kind, nth) AS INT) AS obs_no, text, source, round(conf, 6) AS conf FROM marked WHERE kind = 0 OR n = 1")
def pass_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    grammar = Grammar.learn(S.frame(spark, sf_dir, S.MASTER))
    parsed = passes.with_pass_fields(passes.ranked(S.passes(spark, sf_dir)))
    return passes.observations(parsed, grammar).select("req_id", "obs_no", "text", "source", r6("conf").alias("conf"))


@query(f"""WITH {D_RANKED}, f AS (SELECT image_id, pass_rank, nullif(regexp_extract(text, 'Quality : (\\S+)', 1), '') AS quality, nullif(regexp_extract(text, 'Batch : (\\S+)', 1), '') AS batch,
        CASE WHEN text LIKE 'Article%' THEN {D_CLEAN.format("regexp_extract(text, 'Article : ([^\\n]+)', 1)")} END AS article, nullif(regexp_extract(text, 'Color : ([^\\n]+)', 1), '') AS color_name FROM ranked)
    SELECT image_id, {', '.join(f'arg_min({c}, pass_rank) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in ('quality', 'batch', 'article', 'color_name'))} FROM f GROUP BY image_id""")
def merge_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = passes.with_pass_fields(passes.ranked(S.passes(spark, sf_dir)))
    return passes.merged_fields(parsed).select("image_id", "quality", "batch", "article", "color_name")


D_REPAIRS = duck.repairs(
    f"SELECT text AS id, i AS t, upper(substr(text, CAST(i AS INT), 1)) AS char, 0.6::DOUBLE AS conf, -1 AS kind FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM (SELECT DISTINCT text FROM {D_OBS}))",
    "SELECT 0 AS kind, 1 AS nth, 'A' AS char, 0::DOUBLE AS p WHERE false", D_MASTER, PATTERNS,
)


@query(f"WITH RECURSIVE {D_REPAIRS} SELECT req_id, nth, code, round(log_score, 6) AS log_score, valid FROM {D_OBS} o JOIN repaired r ON o.text = r.id")
def grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.observations(spark, sf_dir)
    found = rows.select("req_id", F.posexplode(repairs(F.col("text"), F.col("symbols"), Grammar.learn(S.frame(spark, sf_dir, S.MASTER)))).alias("nth", "r"))
    return found.select("req_id", "nth", "r.code", r6("r.log_score").alias("log_score"), "r.valid")


@query(f"WITH RECURSIVE {duck.repairs(S.SYMBOL_CHARS.format(S.duck(S.OBSERVATIONS)), S.SYMBOL_CHOICES, D_MASTER, PATTERNS, 5)} SELECT id AS req_id, nth, code, round(log_score, 6) AS log_score, valid FROM repaired")
def symbol_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of characters that come with confidences and other readings of their own."""
    rows = S.symbol_observations(spark, sf_dir)
    found = rows.select("req_id", F.posexplode(repairs(F.col("text"), F.col("symbols"), Grammar.learn(S.frame(spark, sf_dir, S.MASTER)), most=5)).alias("nth", "r"))
    return found.select("req_id", "nth", "r.code", r6("r.log_score").alias("log_score"), "r.valid")


def _guesses(observations: str) -> str:
    """CTEs up to ranked candidates of SQL of observations (req_id, obs_no, text, source, conf), repairs included."""
    chars = f"SELECT text AS id, i AS t, upper(substr(text, CAST(i AS INT), 1)) AS char, 0.6::DOUBLE AS conf, -1 AS kind FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM (SELECT DISTINCT text FROM {observations}))"
    fits = lambda c: "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in PATTERNS) + ")"
    near = duck.distances(f"SELECT DISTINCT o.text AS a, m.code AS b FROM {observations} o, {D_MASTER} m WHERE abs(length(o.text) - length(m.code)) <= 3 AND o.text <> m.code")
    at = "obs_no, gen, hyp"
    return f"""WITH RECURSIVE {duck.repairs(chars, "SELECT 0 AS kind, 1 AS nth, 'A' AS char, 0::DOUBLE AS p WHERE false", D_MASTER, PATTERNS)},
    m AS MATERIALIZED {D_MASTER}, o AS MATERIALIZED {observations}, total AS (SELECT sum(cnt) AS s, count(*) AS n FROM m),
    fixed AS (SELECT r.*, first_value(log_score) OVER (PARTITION BY id ORDER BY nth) AS top, m.code IS NOT NULL AS listed FROM repaired r LEFT JOIN m ON m.code = r.code),
    hyps AS (SELECT req_id, obs_no, text AS observed, code, 1 AS gen, '0' AS hyp, 'Exact' AS method, NULL AS note, 1::DOUBLE AS factor FROM o JOIN m ON o.text = m.code
        UNION ALL SELECT req_id, obs_no, text, b, 2, b, 'MasterList', NULL, 1 FROM o JOIN (SELECT a, b FROM ({near}) WHERE distance / greatest(length(a), length(b)) <= 0.45) ON o.text = a
        UNION ALL SELECT req_id, obs_no, text, code, 3, CAST(nth AS VARCHAR), CASE WHEN listed THEN 'MasterList' WHEN valid AND code = text THEN 'GrammarOnly' WHEN valid THEN 'GrammarRepair' ELSE 'Unverified' END,
            CASE WHEN listed THEN 'reached via grammar repair' WHEN NOT valid THEN 'does not fit the article pattern' END, CASE WHEN NOT listed AND valid AND code <> text THEN exp(greatest(-6, log_score - top)) ELSE 1 END FROM o JOIN fixed ON o.text = id
        UNION ALL SELECT req_id, obs_no, text, text, 4, '0', CASE WHEN {fits('text')} THEN 'GrammarOnly' ELSE 'Unverified' END, NULL, 1 FROM o),
    own AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id, obs_no, code ORDER BY gen, hyp) AS nth FROM hyps) WHERE nth = 1),
    apart AS MATERIALIZED ({duck.distances("SELECT DISTINCT observed AS a, code AS b FROM own")}),
    weighed AS (SELECT own.*, source, conf, distance, {fits('own.code')} AS fits, (coalesce(m.cnt, 0) + 1) / (s + n) * exp(-2.0 * distance) * (0.5 + 0.5 * conf)
            * CASE source WHEN 'QualityField' THEN 0.6 WHEN 'RawToken' THEN 0.4 ELSE 1.0 END * CASE WHEN {fits('own.code')} THEN 1.0 ELSE 0.35 END * factor AS weight
        FROM own JOIN o USING (req_id, obs_no) JOIN apart ON a = observed AND b = own.code LEFT JOIN m ON m.code = own.code CROSS JOIN total),
    grouped AS (SELECT req_id, code, list_reduce(list(weight ORDER BY {at}), lambda x, y: x + y) AS weight, count(*) AS votes, min(distance) AS distance, max(conf) AS ocr_conf, first(observed ORDER BY {at}) AS seen,
        first(coalesce(note, '') ORDER BY {at}) AS notes, first({{'o': observed, 's': source, 'm': method}} ORDER BY round(distance, 12), {at}) AS near, first(fits ORDER BY {at}) AS matches_grammar, min(row(obs_no, gen, hyp)) AS place FROM weighed GROUP BY req_id, code),
    odds AS (SELECT *, weight / (sum(weight) OVER (PARTITION BY req_id) + {NO_REPAIR.unknown}::DOUBLE) AS probability FROM grouped),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY round(probability, 12) DESC, round(distance, 12), place) AS rank FROM odds),
    named AS (SELECT * FROM ranked JOIN ({duck.jaros("SELECT DISTINCT seen AS a, code AS b FROM ranked WHERE rank <= 10")}) ON seen = a AND code = b WHERE rank <= 10)
    SELECT req_id, CAST(rank AS INT) AS rank, code, near.o AS observed, near.s AS source, near.m AS method, round(distance, 6) AS distance, ocr_conf, matches_grammar,
        round(weight, 6) AS weight, round(probability, 6) AS probability, votes, notes, round(winkler, 6) AS jaro_winkler FROM named"""


def _rounded(ranked: DataFrame) -> DataFrame:
    return ranked.withColumns({c: r6(c) for c in ("distance", "weight", "probability", "jaro_winkler")}).withColumn("notes", F.array_join("notes", "; "))


@query(_guesses(D_OBS))
def guess_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_engine(spark, sf_dir).guess(S.observations(spark, sf_dir)))


@query(_guesses(S.duck(S.VOTES)))
def guess_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several observations of a request, whose weights for a code add up."""
    return _rounded(_engine(spark, sf_dir).guess(S.votes(spark, sf_dir)))


@query()
def text_to_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label texts to result documents: the flagship."""
    engine = _engine(spark, sf_dir)
    texts = S.frame(spark, sf_dir, S.OBSERVATIONS).select("req_id", F.concat(F.lit("Artic1e : "), "text", F.lit("\nNet: 17.00KG\nColor : Mocha Taffy")).alias("text"))
    ranked, parsed = engine.from_text(texts)
    return render.documents(ranked, engine.verified(ranked), labels.fields_map(parsed))


@query(_guesses(f"(WITH {D_SEEN} SELECT image_id AS req_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pass_rank, kind, nth) AS INT) AS obs_no, text, source, conf FROM marked WHERE kind = 0 OR n = 1)"))
def passes_to_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes to candidates: parsed once, observed, guessed."""
    ranked, _ = _engine(spark, sf_dir).from_passes(S.passes(spark, sf_dir))
    return _rounded(ranked)


@query()
def passes_to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes to result documents with raw text, best variant and diagnostics."""
    passed = S.passes(spark, sf_dir)
    said = passes.diagnostics(passed.withColumns({"error": F.lit(None).cast("string"), "elapsed_ms": F.lit(0).cast("long")}))
    return _engine(spark, sf_dir).results(passed, said)


@query()
def json_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.as_json(text_to_result(spark, sf_dir))


@query()
def html_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.as_html(text_to_result(spark, sf_dir))


@query(D_HYPS + """ SELECT req_id, CASE WHEN probability >= 0.6 THEN 'ok' ELSE 'guess' END AS verdict, CASE method WHEN 'Exact' THEN 'exact match in master list' WHEN 'MasterList' THEN 'matched to master list'
    WHEN 'GrammarOnly' THEN 'fits the pattern (not in master list)' ELSE 'unverified' END AS method, round_even(probability, 4) AS probability FROM r WHERE rank = 1""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, _ = _without_repair(spark, sf_dir)
    return ranked.filter("rank = 1").select("req_id", render.verdict(F.col("code"), F.col("probability") >= 0.6).alias("verdict"), render.described(F.col("method"), render.METHODS).alias("method"), F.bround("probability", 4).alias("probability"))


@query(f"""WITH h AS (SELECT image_id, level, count(*) AS n FROM {D_PIXELS} GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER w AS below, sum(n * level) OVER w AS mass, sum(n) OVER (PARTITION BY image_id) AS total, sum(n * level) OVER (PARTITION BY image_id) AS all_mass FROM h WINDOW w AS (PARTITION BY image_id ORDER BY level)),
    b AS (SELECT *, CAST(below AS DOUBLE) * (total - below) * pow(mass / below - (all_mass - mass) / (total - below), 2) AS between_classes FROM c WHERE below < total)
    SELECT image_id, arg_max(level, between_classes - level * 0.0000001) AS threshold FROM b GROUP BY image_id""")
def otsu_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of many images from their histograms, by windows over levels."""
    counted = S.frame(spark, sf_dir, S.PIXELS).groupBy("image_id", "level").agg(F.count("*").alias("n"))
    upto, whole = Window.partitionBy("image_id").orderBy("level"), Window.partitionBy("image_id")
    mass = F.col("n") * F.col("level")
    rows = counted.withColumns({"below": F.sum("n").over(upto), "mass": F.sum(mass).over(upto), "total": F.sum("n").over(whole), "all_mass": F.sum(mass).over(whole)}).filter("below < total")
    above = F.col("total") - F.col("below")
    between = F.col("below").cast("double") * above * F.pow(F.col("mass") / F.col("below") - (F.col("all_mass") - F.col("mass")) / above, F.lit(2))
    return rows.withColumn("between", between).groupBy("image_id").agg(F.max_by("level", F.col("between") - F.col("level") * 0.0000001).alias("threshold"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 96 x 64 with slanted bars, one per supplier."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("image_id"))
    pixel = lambda i: F.when(F.pmod(F.floor(i / 96) + F.floor(F.pmod(i, F.lit(96)) * F.pmod("image_id", F.lit(9)) / 48), F.lit(12)) < 4, "28").otherwise("E0")
    return rows.select("image_id", F.lit(96).alias("width"), F.lit(64).alias("height"), F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(96 * 64 - 1)), pixel), "")).alias("data"))


@query()
def image_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.build_variants(_pages(spark, sf_dir)).select("image_id", "pass_no", "variant", "width", "height", F.crc32("data").alias("crc32"), "deskew_angle")


@query()
def quarter_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = image.build_variants(_pages(spark, sf_dir)).filter("variant = 'gray'")
    return image.quarter_turns(made).select("image_id", "pass_no", "variant", "width", "height", F.crc32("data").alias("crc32"), "rotation")
