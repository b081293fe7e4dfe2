"""Calibration and answers on small, odd rows."""

from gritstone.functions import text
from gritstone.streaming import proximity


def test_calibration_range_and_fallback(spark):
    rows = [("good", i, 0.3 if i % 5 else 0.05) for i in range(40)] + [("wide", i, 0.9) for i in range(40)] + [("few", i * 10, 0.3) for i in range(5)] + [("short", i, 0.3) for i in range(20)] + [("none", i, None) for i in range(40)]
    rows += [(None, 1, 0.3), ("good", None, 0.9), ("good", 31, 0.9), ("wide", 3, float("nan"))]
    df = spark.createDataFrame([(k, None if s is None else s * 1_000_000, x) for k, s, x in rows], "k string, us long, x double")
    got = {r.k: (r.done, r.n, round(r.threshold, 6), r.fallback) for r in proximity.eye_threshold(df, "k", "x", 30, 20).collect()}
    assert got == {"good": (True, 31, 0.225, False), "wide": (True, 31, 0.22, True), "few": (True, 4, 0.22, True), "short": (False, 20, 0.22, False), "none": (True, 0, 0.22, True)}
    assert proximity.eye_threshold(df.limit(0), "k", "x").count() == 0


def test_codes_decide_between_answers(spark):
    q = spark.createDataFrame([(1, "What does code e-215 mean?"), (2, "engine oil pressure low"), (3, None), (4, "hello"), (5, "engine E-999 oil pressure")], "id long, t string")
    a = spark.createDataFrame([(10, "What does code E-110 mean"), (11, "E-215"), (12, "oil, OIL pressure"), (13, "engine oil pressure E-110"), (14, None), (15, "oil oil pressure")], "a long, t string")
    got = {r.id: (r.a, r.score) for r in text.best_answers(q, a, "id", "t", "a", "t").collect()}
    assert got == {1: (11, 5 + 1), 2: (12, 3), 3: (None, None), 4: (None, None), 5: (12, 3)}


def test_answers_in_many_groups(spark, monkeypatch):
    """Groups of questions and answers, steps within a group, repeated and missing ids."""
    for name, most in (("QUESTIONS", 7), ("ANSWERS", 4), ("STEP", 5)):
        monkeypatch.setattr(text, name, most)
    q = [(i if i % 9 else None, " ".join(f"w{(i * j) % 11}x" for j in range(i % 7)) + (" e-110" if i % 4 == 0 else "")) for i in range(60)] + [(8, "w1x w3x")]
    a = [(i, " ".join(f"w{(i + j * j) % 13}x" for j in range(i % 6)) + (" E-110" if i % 5 == 0 else " E-360" if i % 5 == 1 else "")) for i in range(30)] + [(3, "w1x w1x"), (3, "E-110")]
    merged = lambda rows: {k: [t.split() for i, t in rows if i == k] for k, _ in rows if k is not None}
    code = lambda texts: {w.upper() for t in texts for w in t if "-" in w}
    words = lambda t: [w for w in " ".join(t).replace("-", " ").split() if len(w) > 2]
    want = {}
    for k, asked in merged(q).items():
        scores = []
        for i, given in merged(a).items():
            n = sum(w == v for t in asked for w in {*words(t)} for u in given for v in words(u))
            scores.append((-(n + (5 if code(asked) & code(given) else -5 if code(asked) and code(given) else 0)), i))
        want[k] = (min(scores)[1], -min(scores)[0]) if min(scores)[0] <= -2 else (None, None)
    got = text.best_answers(spark.createDataFrame(q, "id long, t string"), spark.createDataFrame(a, "a long, t string"), "id", "t", "a", "t")
    rows = got.collect()
    assert len(rows) == len(q) and {r.id: (r.a, r.score) for r in rows if r.id is not None} == want
    assert all(r.a is None for r in rows if r.id is None)


def test_calibration_takes_more_tasks_for_more_rows(spark, monkeypatch):
    """A task's memory doesn't grow with the table."""
    monkeypatch.setattr(proximity, "EYE_ROWS", 50)
    df = spark.createDataFrame([(k, i * 1_000_000, 0.3) for k in range(40) for i in range(40)], "k long, us long, x double")
    got = proximity.eye_threshold(df, "k", "x", 30, 20)
    assert "hashpartitioning(k" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 32), REPARTITION_BY_NUM" in plan
    assert {(r.done, r.n, round(r.threshold, 6), r.fallback) for r in got.collect()} == {(True, 31, 0.225, False)}
