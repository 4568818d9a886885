import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwright.functions import metrics
from labelwright.functions import text as T
from labelwright.functions.confusion import Confusion, similarity_column
from labelwright.functions.grammar import Grammar, examples
from labelwright.operators.repair import Repairer, RepairParams, Symbol

DISTANCES = [
    ("RD258150", "RD258150", 0), ("rd258150", "RD258150", 0), ("RD25815O", "RD258150", 0.15), ("RD25815W", "RD258150", 1.0), ("RD258150", "RD258151", 0.85),
    ("RD.258-150", "RD258150", 0.6), ("RD285150", "RD258150", 0.8), ("", "", 0), ("", "ABC", 3), ("ABC", "", 3),
]


@pytest.mark.parametrize(("a", "b", "expected"), DISTANCES)
def test_weighted_distance(a, b, expected):
    assert metrics.distances([a], [b])[0] == pytest.approx(expected)


def test_distance_of_a_batch_equals_single_ones():
    random = np.random.default_rng(3)
    words = ["".join(random.choice(list("A0O1I.5-S"), random.integers(0, 9))) for _ in range(80)]
    a, b = words[:40], words[40:]
    assert metrics.distances(a, b).tolist() == pytest.approx([metrics.distances([x], [y])[0] for x, y in zip(a, b)])


def test_native_distance_equals_the_arrow_one(spark):
    pairs = [(a, b) for a, b, _ in DISTANCES] + [(None, "AB")]
    row = spark.createDataFrame(pairs, "a string, b string").select(metrics.weighted_distance_expr(F.col("a"), F.col("b")).alias("x"), metrics.weighted_distance(F.col("a"), F.col("b")).alias("y")).collect()
    assert [r.x for r in row] == pytest.approx([r.y for r in row])


def test_jaro_winkler():
    assert metrics.jaro_winklers(["RD258150", "", "MARTHA", "XYZ"], ["RD258150", "RD258150", "MARHTA", "RD258150"]).tolist() == pytest.approx([1, 0, 0.96111, 0], abs=1e-3)
    assert metrics.jaro_winklers(["RD25815O"], ["RD258150"])[0] > 0.9
    assert metrics.jaro_winklers(["abcdefgh"], ["bcadefgh"], False)[0] == pytest.approx(0.9375)


def test_jaro_of_a_batch_equals_single_ones():
    random = np.random.default_rng(9)
    words = ["".join(random.choice(list("ABab01é"), random.choice([0, 1, 2, 3, 8, 9, 33, 64, 70]))) for _ in range(600)]
    a, b = words[:300] + ["MARTHA", "x" * 64], words[300:] + ["MARHTA", "x" * 63 + "y"]
    b = [y if i % 3 else a[i][1:] + a[i][:1] for i, y in enumerate(b)]
    for winkler in (True, False):
        assert metrics.jaro_winklers(a, b, winkler).tolist() == [metrics._jaro(x.upper(), y.upper(), winkler) for x, y in zip(a, b)]
    assert metrics.jaro_winklers([], []).tolist() == []


def test_cosine_and_similarity(spark):
    rows = spark.createDataFrame([("RD258150", "RD258150"), ("RD258151", "RD258150"), ("ZZZZZZ", "RD258150")], "a string, b string").select(metrics.ngram_cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0].c == pytest.approx(1) and rows[1].c > 0.6 and rows[2].c < 0.1
    model = Confusion()
    assert model.similarity("0", "O") == model.similarity("O", "0") == 0.85 and model.similarity("A", "a") == 1
    assert model.similarity("3", "8") == 0.35 and len(model.pairs) == 87
    changed = model.with_pair("O", "0", 0.5)
    assert changed.similarity("0", "O") == 0.5 and list(changed.pairs) == list(model.pairs)
    with pytest.raises(ValueError):
        model.with_pair("A", "B", 1.5)
    assert spark.range(1).select(similarity_column(F.lit("o"), F.lit("0")).alias("s")).first().s == 0.85


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert one(T.clean_code(F.lit('" : rd 258150. "'))) == "RD258150"
    assert one(T.clean_code(F.lit("  "))) is None and one(T.clean_code(F.lit(None).cast("string"))) is None
    assert one(T.first_number(F.lit("158cm / 62.20"))) == 158 and one(T.first_number(F.lit("13,92M"))) == 13.92 and one(T.first_number(F.lit("x"))) is None
    assert one(T.metres(F.lit("13.92M"))) == 13.92 and one(T.metres(F.lit("48.00Y"))) == pytest.approx(48 * 0.9144)
    assert one(T.barcode(F.lit("a 423061001874\nb"))) == "423061001874" and one(T.barcode(F.lit("123456789012345"))) is None
    assert one(T.iso_date(F.lit("w 2023/06.11 x"))) == "2023-06-11" and one(T.iso_date(F.lit("x"))) is None


def test_grammar():
    own = Grammar()
    assert [own.valid(x) for x in ("RD258150", "EA511872FX30", "TE181065FX2-A2", "MOCHA", "rd258150", "")] == [True] * 3 + [False] * 3
    assert (own.least, own.most, len(own.examples)) == (6, 17, 17) and all(own.valid(x) for x in own.examples)
    assert {"AA000000A0-A0", "AA000000AA000-A00"} <= set(own.examples)
    assert examples("^A(B|C)$") == ["AB", "AC"] and examples("^AB?$") == ["A", "AB"] and examples(r"^(?<x>A)\k<x>$") == [] and examples(r"^(?P<x>A)(?P=x)$") == []
    assert own.prior(0, 0) > 0.8 and own.prior(3, 1) > 0.8 and own.log_likelihood("RD258150") > own.log_likelihood("12345678") and own.log_likelihood("") == -math.inf
    assert Grammar(("  ",)).patterns == own.patterns


def test_grammar_learns(spark):
    codes = spark.createDataFrame([(c,) for c in ("AB123456", "CD123456", "EF111111", "GH222222", "IJ333333")], "code string")
    own = Grammar.learn(codes, ("^.*$",))
    assert own.prior(1, 0) > 0.8 and own.prior(2, 1) > 0.8 and (own.least, own.most) == (8, 8) and own.transition[1, 1] > own.transition[1, 0]
    row = codes.limit(1).select(own.log_likelihood_column(F.col("code")).alias("x"), "code").first()
    assert row.x == pytest.approx(own.log_likelihood(row.code))
    tokens = spark.createDataFrame([(c,) for c in ("RD258150", "EA511?72FX30", "MOCHA", "48.00Y", "423061001874")], "t string").select(Grammar().plausible_column(F.col("t")).alias("p"))
    assert [r.p for r in tokens.collect()] == [True, True, False, False, False]
    assert Grammar.learn(spark.createDataFrame([], "code string")).most == 17


def test_repair():
    own = Repairer(Grammar())
    assert [own.of_text(x)[0][0] for x in ("EA5118Z2FX3O", "TE1B1O65FX2-A2", "RD.258150'")] == ["EA511822FX30", "TE181065FX2-A2", "RD258150"]
    assert own.of_text("") == [] and own.of_text("###")
    symbols = [Symbol(c, 0.95) for c in "RD258150"]
    symbols[4] = Symbol("8", 0.40, (("8", 0.40), ("6", 0.39)))
    assert {"RD258150", "RD256150"} <= {c for c, _, _ in own.repair(symbols, 5)}


def plain_beam(own, symbols, most):
    """The search as a dict of readings for each hypothesis, one symbol after the other."""
    beam = [("", 0.0, -1)] if symbols else []
    for symbol in symbols:
        taken, drop = own.moves(symbol)
        best = {}
        for text, score, before in beam:
            if len(text) < own.grammar.most + 2:
                for char, kind, log in taken:
                    value = score + log + own.place[min(len(text), len(own.place) - 1)][kind] + (own.after[before][kind] if before >= 0 else 0.0)
                    if text + char not in best or value > best[text + char][0]:
                        best[text + char] = value, kind
            if text not in best or score + drop > best[text][0]:
                best[text] = score + drop, before
        beam = sorted(((t, s, k) for t, (s, k) in best.items()), key=lambda x: -x[1])[: own.params.beam]
    found = [(t, s, own.grammar.valid(t)) for t, s, _ in beam if t]
    return ([x for x in found if x[2]] or found)[:most]


@pytest.mark.parametrize("params", [RepairParams(), RepairParams(beam=5, readings=2), RepairParams(beam=200, readings=6, drop_char=math.log(0.3))])
def test_beams_of_a_batch_equal_single_ones(params):
    random = np.random.default_rng(7)
    own = Repairer(Grammar(), params=params)
    letters = list("AABB001188OIS5-.|é世ß")
    pick = lambda: str(random.choice(letters))
    reads = [own.symbols("".join(pick() for _ in range(random.integers(0, 11)))) for _ in range(120)]
    reads += [[Symbol(pick(), float(random.random() * 1.2 - 0.1), tuple((pick(), float(random.random())) for _ in range(random.integers(0, 4)))) for _ in range(random.integers(0, 9))] for _ in range(120)]
    reads += [own.symbols("A0" * 20), own.symbols("EA5118Z2FX3O"), [Symbol("", 0.5), Symbol("R", 0.9), Symbol("", 0.5)], own.symbols("AAAAAAAA")]
    found = own.repair_all(reads, 64)
    assert found == [plain_beam(own, r, 64) for r in reads] and any(v for r in found for _, _, v in r)
