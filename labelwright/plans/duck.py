"""DuckDB twins of expressions that SQL has no function for."""

from __future__ import annotations


#: Fixed values, written out once more so that the twins don't take them from the code under test: similarities of pairs of
#: characters in order of insertion, signs that are mostly dirt, and examples of the patterns.
PAIRS = """
    0O 0.85, 0D 0.55, 0Q 0.50, 0U 0.25, 0C 0.25, 1I 0.85, 1L 0.55, 1T 0.35, 17 0.40, 1J 0.30, 2Z 0.80, 27 0.30, 2S 0.20, 3B 0.40,
    3E 0.35, 38 0.35, 4A 0.55, 4H 0.25, 49 0.20, 5S 0.85, 56 0.35, 35 0.25, 6G 0.65, 6B 0.35, 68 0.35, 6C 0.25, 06 0.25, 7T 0.55,
    7Z 0.40, 7Y 0.25, 8B 0.85, 8S 0.30, 08 0.30, 9G 0.40, 9Q 0.30, 09 0.30, 9P 0.25, AR 0.35, BR 0.40, BE 0.30, BD 0.35, CG 0.55,
    CO 0.45, CE 0.30, DO 0.55, DQ 0.35, DP 0.30, EF 0.60, EL 0.35, FP 0.50, FT 0.30, FR 0.25, GQ 0.35, GO 0.30, HN 0.50, HM 0.35,
    HK 0.35, IL 0.45, IT 0.30, IJ 0.35, KX 0.50, KR 0.40, MN 0.50, MW 0.30, NW 0.25, OQ 0.60, OU 0.30, PR 0.50, SZ 0.25, TY 0.35,
    UV 0.55, UJ 0.35, VY 0.50, VW 0.45, WY 0.20, XY 0.35, I| 0.90, 1| 0.80, I! 0.60, 1! 0.55, L| 0.40, -_ 0.80, -~ 0.60, -= 0.60,
    -. 0.30, O° 0.40, 0° 0.40
"""
DIRT = " .,:;'\"-_|~^*°·¨´‘’“”!()[]{}<>/\\`"
EXAMPLES = (
    "AA000000", "AA000000A0", "AA000000A000", "AA000000AA0", "AA000000AA000", "AA000000A0-A0", "AA000000A0-A00", "AA000000A000-A0", "AA000000A000-A00",
    "AA000000AA0-A0", "AA000000AA0-A00", "AA000000AA000-A0", "AA000000AA000-A00", "A00000", "A00000000", "AAA00000", "AAA00000000",
)
_PAIRS = [(x.strip()[:2], float(x.strip()[3:])) for x in PAIRS.split(",") if x.strip()]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BOTH_WAYS = {p: s for pair, s in _PAIRS for p in (pair, pair[::-1])}
SIMILAR = "MAP {" + ", ".join(f"{_quoted(p)}: {s}::DOUBLE" for p, s in _BOTH_WAYS.items()) + "}"
_COSTS = "MAP {" + ", ".join(f"{_quoted(p)}: {1 - s}::DOUBLE" for p, s in _BOTH_WAYS.items()) + "}"


def _drop(char: str) -> str:
    return f"(CASE WHEN contains({_quoted(DIRT)}, {char}) THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END)"


def _change(a: str, b: str) -> str:
    alike = f"(regexp_matches({a}, '^\\p{{Nd}}$') AND regexp_matches({b}, '^\\p{{Nd}}$')) OR (regexp_matches({a}, '^\\p{{L}}$') AND regexp_matches({b}, '^\\p{{L}}$'))"
    return f"(CASE WHEN {a} = {b} THEN 0::DOUBLE ELSE coalesce({_COSTS}[{a} || {b}], CASE WHEN {alike} THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END) END)"


def distances(pairs: str) -> str:
    """SQL of a, b, distance for the distinct rows of SQL with a and b: the table's rows one after the other."""
    cell = (
        "list_append(acc, least("
        f"row_now[j + 1] + {_drop('ca')}, acc[-1] + {_drop('substr(b, j, 1)')}, row_now[j] + {_change('ca', 'substr(b, j, 1)')}, "
        f"CASE WHEN i > 1 AND j > 1 AND ca = substr(b, j - 1, 1) AND substr(a, i - 1, 1) = substr(b, j, 1) AND ca <> substr(b, j, 1) THEN row_before[j - 1] + 0.8::DOUBLE END))"
    )
    return f"""
        WITH RECURSIVE p AS (SELECT DISTINCT upper(a) AS a, upper(b) AS b FROM ({pairs})),
        t AS (
            SELECT a, b, 0 AS i, [0::DOUBLE] AS row_before,
                   list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, acc[-1] + {_drop('substr(b, j, 1)')}), [0::DOUBLE]) AS row_now
            FROM p
            UNION ALL
            SELECT a, b, i, row_now AS row_before,
                   list_reduce(range(1, length(b) + 1), lambda acc, j: {cell}, [row_now[1] + {_drop('ca')}]) AS row_now
            FROM (SELECT a, b, i + 1 AS i, substr(a, i + 1, 1) AS ca, row_before, row_now FROM t WHERE i < length(a))
        )
        SELECT a, b, row_now[-1] AS distance FROM t WHERE i = length(a)"""


CLASS = "CASE WHEN regexp_matches({0}, '[A-Za-z]') THEN 0 WHEN regexp_matches({0}, '[0-9]') THEN 1 ELSE 2 END"


def shapes(codes: str) -> str:
    """CTEs of what is learnt from SQL of codes and the examples: profile (pos, cls, p) and transition (before, cls, p)."""
    examples = ", ".join(f"('{x}')" for x in EXAMPLES)
    return f"""codes AS (SELECT code FROM {codes} UNION ALL SELECT * FROM (VALUES {examples}) e(code)),
    chars AS (SELECT row_number() OVER () AS id, code FROM codes),
    cls AS (SELECT id, i AS pos, {CLASS.format('substr(code, CAST(i + 1 AS INT), 1)')} AS cls FROM (SELECT id, code, unnest(range(length(code))) AS i FROM chars)),
    grid AS (SELECT pos, cls FROM (SELECT DISTINCT pos FROM cls) CROSS JOIN (VALUES (0), (1), (2)) k(cls)),
    counted AS (SELECT g.pos, g.cls, 0.5::DOUBLE + count(c.id) AS n FROM grid g LEFT JOIN cls c ON c.pos = g.pos AND c.cls = g.cls GROUP BY g.pos, g.cls),
    profile AS (SELECT pos, cls, n / sum(n) OVER (PARTITION BY pos) AS p FROM counted),
    steps AS (SELECT cls, lag(cls) OVER (PARTITION BY id ORDER BY pos) AS before FROM cls),
    moved AS (SELECT b.cls AS before, k.cls, 0.5::DOUBLE + count(s.cls) AS n FROM (VALUES (0), (1), (2)) b(cls) CROSS JOIN (VALUES (0), (1), (2)) k(cls) LEFT JOIN steps s ON s.before = b.cls AND s.cls = k.cls GROUP BY b.cls, k.cls),
    transition AS (SELECT before, cls, n / sum(n) OVER (PARTITION BY before) AS p FROM moved)"""


def repairs(symbols: str, choices: str, codes: str, patterns: tuple[str, ...], most: int = 3) -> str:
    """CTEs up to repaired (id, nth, code, log_score, valid): a beam that a recursive query carries from symbol to symbol.

    symbols: SQL of id, t (from 1), char, conf, kind; choices: SQL of kind, nth, char (null: the symbol's own), p; codes: SQL of
    the known codes, none of which is longer than an example.
    """
    pairs = ", ".join(f"({i}, {_quoted(p[0])}, {_quoted(p[1])}, {s}::DOUBLE)" for i, (p, s) in enumerate(_PAIRS))
    valid = " OR ".join(f"regexp_matches(text, '{p}')" for p in patterns)
    return f"""{shapes(codes)},
    symbols AS MATERIALIZED ({symbols}), choices AS ({choices}), pairs AS (SELECT * FROM (VALUES {pairs}) p(nth, a, b, s)),
    kinds AS (SELECT row_number() OVER () AS symbol, * FROM (SELECT DISTINCT char, conf, kind FROM symbols)),
    near AS (SELECT nth, a AS char, b AS other, s FROM pairs UNION ALL SELECT nth, b, a, s FROM pairs),
    offered AS (SELECT symbol, c.nth AS nth, coalesce(upper(c.char), k.char) AS char, greatest(0.02::DOUBLE, p) AS value FROM kinds k JOIN choices c ON c.kind = k.kind
        UNION ALL SELECT symbol, 1000, char, greatest(conf, 0.3::DOUBLE) FROM kinds
        UNION ALL SELECT symbol, 2000 + nth, other, s * greatest(1 - least(greatest(conf, 0::DOUBLE), 0.98::DOUBLE), 0.25::DOUBLE) FROM kinds k JOIN near n ON n.char = k.char),
    best AS (SELECT symbol, char, max(value) AS value, min(nth) AS nth FROM offered GROUP BY symbol, char),
    listed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY value DESC, nth) AS place FROM best),
    readings AS MATERIALIZED (SELECT symbol, place, char, ln(greatest(0.02::DOUBLE, value)) AS log, {CLASS.format('char')} AS cls FROM listed WHERE place <= 4),
    marks AS MATERIALIZED (SELECT id, t, symbol, ln(CASE WHEN contains({_quoted(DIRT)}, s.char) AND s.char <> '-' THEN 0.5::DOUBLE ELSE 0.03::DOUBLE END) AS gone FROM symbols s JOIN kinds k ON s.char = k.char AND s.conf = k.conf AND s.kind = k.kind),
    places AS MATERIALIZED (SELECT pos, cls, ln(3 * p) AS log FROM profile), follows AS MATERIALIZED (SELECT before, cls, ln(3 * p) AS log FROM transition),
    bounds AS MATERIALIZED (SELECT (SELECT max(pos) FROM profile) AS last, (SELECT max(length(code)) FROM {codes}) + 2 AS longest),
    beam AS (
        SELECT DISTINCT id, 0::BIGINT AS t, '' AS text, 0::DOUBLE AS score, -1 AS before, 1::BIGINT AS place FROM symbols
        UNION ALL
        SELECT id, t, text, score, before, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, nth) AS place FROM (
            SELECT id, t, text, max(score) AS score, max(before) AS before, min(nth) AS nth FROM (
                SELECT b.id, m.t, b.text || r.char AS text, b.score + r.log + p.log + coalesce(f.log, 0::DOUBLE) AS score, r.cls AS before, b.place * 10 + r.place AS nth
                FROM beam b JOIN marks m ON m.id = b.id AND m.t = b.t + 1 CROSS JOIN bounds JOIN readings r ON r.symbol = m.symbol JOIN places p ON p.pos = least(length(b.text), last) AND p.cls = r.cls
                LEFT JOIN follows f ON f.before = b.before AND f.cls = r.cls WHERE length(b.text) < longest
                UNION ALL SELECT b.id, m.t, b.text, b.score + m.gone, b.before, b.place * 10 + 9 FROM beam b JOIN marks m ON m.id = b.id AND m.t = b.t + 1)
            GROUP BY id, t, text)) WHERE place <= 64),
    ends AS (SELECT id, max(t) AS t FROM symbols GROUP BY id),
    found AS (SELECT id, text, score, place, {valid} AS valid FROM beam JOIN ends USING (id, t) WHERE text <> ''),
    fitting AS (SELECT *, bool_or(valid) OVER (PARTITION BY id) AS any_valid FROM found),
    repaired AS (SELECT * FROM (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS INT) AS nth, text AS code, score AS log_score, valid FROM fitting WHERE valid OR NOT any_valid) WHERE nth < {most})"""



def jaros(pairs: str) -> str:
    """SQL of a, b, jaro, winkler for the distinct rows of SQL with a and b (upper-case, under 60 characters): the first word's
    characters one after the other, each taking the first free place of the second word within reach."""
    return f"""
        WITH RECURSIVE p AS (SELECT DISTINCT a, b, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS reach FROM ({pairs})),
        t AS (
            SELECT a, b, reach, 0 AS i, 0::BIGINT AS used, '' AS mine FROM p
            UNION ALL
            SELECT a, b, reach, i, used | CASE WHEN hit > 0 THEN 1::BIGINT << hit ELSE 0 END, mine || CASE WHEN hit > 0 THEN c ELSE '' END FROM (
                SELECT *, coalesce(list_filter(range(greatest(1, i - reach), least(length(b), i + reach) + 1), lambda j: substr(b, j, 1) = c AND (used >> j) & 1 = 0)[1], 0) AS hit
                FROM (SELECT a, b, reach, i + 1 AS i, used, mine, substr(a, i + 1, 1) AS c FROM t WHERE i < length(a)))
        ),
        m AS (SELECT a, b, mine, array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda j: (used >> j) & 1 = 1), lambda j: substr(b, j, 1)), '') AS other FROM t WHERE i = length(a)),
        j AS (SELECT a, b, CASE WHEN a = b THEN 1 WHEN length(mine) = 0 THEN 0 ELSE (length(mine)::DOUBLE / length(a) + length(mine)::DOUBLE / length(b)
            + (length(mine) - len(list_filter(range(1, length(mine) + 1), lambda k: substr(mine, k, 1) <> substr(other, k, 1))) / 2.0::DOUBLE) / length(mine)) / 3 END AS jaro FROM m)
        SELECT a, b, jaro, CASE WHEN jaro > 0.7 THEN jaro + 0.1 * len(list_filter(range(1, 5), lambda k: k <= least(length(a), length(b)) AND left(a, k) = left(b, k))) * (1 - jaro) ELSE jaro END AS winkler FROM j"""
