"""Equal requests are guessed once, and all get the candidates."""

import random

from pyspark.sql import functions as F

from labelwright.operators import guess as G

ROWS = [(1, 1, "RD258150", "UserText", 0.6, None), (2, 1, "rd 25815O", "UserText", 0.6, None), (3, 1, "RD25815O", "UserText", 0.6, None), (4, 1, "RD25815O", "RawToken", 0.6, None), (5, 1, "RD25815O", "UserText", 0.6, None), (5, 2, "RD258150", "UserText", 0.6, None), (6, 1, " ", "UserText", 0.6, None)]


def test_equal_requests(spark):
    seen = spark.createDataFrame(ROWS, G.OBSERVATION)
    asked, distinct = G.questions(seen)
    assert {r.req_id: r.first for r in asked.collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}
    assert distinct.count() == 5
    master = spark.createDataFrame([("RD258150", "x", 5.0), ("RD258151", "y", 2.0), ("ZZ999999", "z", 1.0)], "code string, description string, cnt double")
    found = {i: [tuple(r)[1:] for r in G.guess(seen, master).filter(F.col("req_id") == i).orderBy("rank").collect()] for i in (2, 3, 4, 5)}
    alone = [tuple(r)[1:] for r in G.guess(seen.filter("req_id = 3"), master).orderBy("rank").collect()]
    assert found[2] == found[3] == alone and found[4] != alone and found[5] != alone


def test_answers_are_those_of_shuffled_hypotheses(spark, monkeypatch):
    """Answers of tasks against hypotheses that are shuffled, with texts in common, equal counts, symbols, repeated numbers and missing values."""
    from labelwright.operators import answers

    r = random.Random(5)
    codes = ["".join(r.choices("AB", k=2)) + "".join(r.choices("01258", k=6)) for _ in range(120)]
    master = spark.createDataFrame([(c, "x", float(r.randrange(3))) for c in sorted(set(codes))], "code string, description string, cnt double")
    symbols = [[("R", 0.9, [("A", 0.7), ("R", 0.2)])] + [(c, 0.6, None) for c in "B.015?5"]]
    rows = []
    for req in range(60):
        texts = [r.choice(codes) for _ in range(r.randrange(1, 4))]
        texts = [t.replace("0", "O", r.randrange(3)).replace("5", "S", r.randrange(2))[: r.choice([7, 8, 8])] + r.choice(["", "", ".", "FX2"]) for t in texts] + r.choice([[], [codes[0]], ["?"], ["é"]])
        for i, t in enumerate(texts):
            number = 1 if req % 9 == 0 else i if req % 10 else None if i == 0 else i
            rows.append((req, number, t, r.choice(["UserText", "QualityField", "RawToken", None]), r.choice([0.3, 0.6, 1.5, -1.0, None]), r.choice(symbols) if req % 7 == 0 and i == 0 else None))
    seen = spark.createDataFrame(rows, G.OBSERVATION)
    tidy = lambda df: sorted((x.req_id, x["rank"], x.code, x.observed, x.source, x.method, round(x.distance, 9), x.ocr_conf, x.matches_grammar, round(x.weight, 9), round(x.probability, 9), x.votes, tuple(x.notes), round(x.jaro_winkler, 9)) for x in df.collect())
    for repair in (True, False):
        found, schema = G.guess(seen, master, with_repair=repair), [(f.name, f.dataType) for f in G.guess(seen, master, with_repair=repair).schema]
        # Equal codes of one number of a request: the shuffle may take either of two observations with the same kind and place.
        found = tidy(found)
        with monkeypatch.context() as m:
            m.setattr(answers, "SENT_CODES", 0)
            shuffled = G.guess(seen, master, with_repair=repair)
            assert [(f.name, f.dataType) for f in shuffled.schema] == schema
            once = [x for x in tidy(shuffled) if x[0] % 9]
        assert [x for x in found if x[0] % 9] == once and len({x[0] for x in once}) > 50
    assert G.guess(seen.limit(0), master).count() == 0 and G.guess(seen, master.limit(0)).count() > 0


def test_hypotheses_stay_in_their_task(spark):
    """Only the best candidates are shuffled, however many codes are near."""
    master = spark.createDataFrame([(f"RD{i:06d}", "x", 1.0) for i in range(3000)], "code string, description string, cnt double")
    seen = spark.createDataFrame([(1, 1, "RD001500", "UserText", 0.6, None), (2, 1, "RD00150O", "UserText", 0.6, None)], G.OBSERVATION)
    ranked = G.guess(seen, master, with_repair=False)
    assert "Window" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    assert [r.code for r in ranked.filter("rank = 1").orderBy("req_id").collect()] == ["RD001500", "RD001500"] and ranked.count() == 20
