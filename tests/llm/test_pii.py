import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gritstone.llm import pii


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("a@b.1-% _+2() 345\n"), max_size=40))
def test_base_patterns(text):
    assert pii.base_spans(text) == brute.private(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "x1", "+", "++", "(", ")", "@", ".", "-", " ", "\n", "_", "7", "2024", "5551234"]), max_size=20).map("".join))
def test_field_takes_any_text(text):
    base, more = pii.find(text, pii.field())
    assert base == pii.base_spans(text) and all(0 <= i < j <= len(text) for _, i, j in more)


@pytest.mark.parametrize("text", ["f(2024)", "1+1000", "C++2011", "y=x+10000", "x = f(20241234, 12)"])
def test_sums_and_calls_are_clean(text):
    assert pii.find(text, pii.field()) == ([], [])


def test_number_joined_to_a_word():
    text = "phone(555) 123-4567"
    assert [k for k, _, _ in pii.find(text, pii.field())[1]] == ["phone"]


def test_documents(spark, small, texts):
    for r in pii.annotate(spark.read.parquet(f"{small}/documents.parquet")).collect():
        base = brute.private(texts[r.doc_id])
        written = [f"{k}:{i}:{j}" for k, i, j in base]
        assert r.base_sha256 == brute.digest(",".join(written))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE)
        spans = r.spans.split(",") if r.spans else []
        assert set(written) <= set(spans) and len(spans) == len(base) + r.n_added


@pytest.mark.parametrize(
    "text, kind, part",
    [("call (555) 123-4567 now", "phone", "(555) 123-4567"), ("card 4111.1111.1111.1111 is old", "card", "4111.1111.1111.1111"), ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" in', "secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), ("mail joe@localhost please", "email", "joe@localhost")],
)
def test_field_adds_other_forms(text, kind, part):
    base, more = pii.find(text, pii.field())
    assert base == [] and [(k, text[i:j]) for k, i, j in more] == [(kind, part)]


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("call 555 12 34 56 7 8 9 now", "phone", "555 12 34 56 7 8 9"), ("call 00 33 1 23 45 67 89 now", "phone", "00 33 1 23 45 67 89"), ("phone 555 - 123 - 4567", "phone", "555 - 123 - 4567"), ("tel 555  123  4567 ok", "phone", "555  123  4567"),
        ("tel 555\u00a0123\u00a04567 ok", "phone", "555\u00a0123\u00a04567"), ("call 555\n123 4567 ok", "phone", "555\n123 4567"), ("card 41/11/11/11/11/11/11/11 ok", "card", "41/11/11/11/11/11/11/11"), ("visa 4111  1111  1111  1111.", "card", "4111  1111  1111  1111"),
    ],
)
def test_many_groups_and_wide_gaps_are_one_span(text, kind, part):
    base, more = pii.find(text, pii.field())
    assert base == [] and [(k, text[i:j]) for k, i, j in more] == [(kind, part)]


def test_a_table_of_figures_has_few_candidates():
    text = "12 34 5.6 78,9\n" * 500
    for tokens, before in pii.windows(text):
        assert len(pii.candidates(text, tokens, before)) <= pii.MOST * len(tokens)
    assert pii.find(text, pii.field()) == ([], [])


@pytest.mark.parametrize("text", ["on 2024-01-02 at 12:30", "version v1.2.30 of 3", "1 2 3 4 5 6 7 8 9 10 11", "pi is 3.14159", "no digits at all", "", None, "12 " * 500])
def test_field_leaves_clean_text(text):
    assert pii.find(text, pii.field()) == ([], [])


def test_best_path_equals_all_segmentations():
    """The dynamic program against every segmentation of short lines."""
    model = pii.field()

    def score(n, segments, path):
        weights = {(i, j): model.weights[:, on].sum(axis=1) for i, j, on in segments}
        total, x, at = 0.0, 0, 0
        for i, j, y in [*path, (n, n, None)]:
            while at < i:
                total, x, at = total + model.moves[x, 0], 0, at + 1
            if y is not None:
                total, x, at = total + model.moves[x, y] + weights[i, j][y], y, j
        return total

    def every(n, segments, at=0):
        yield []
        for i, j, _ in segments:
            if i >= at:
                for y in range(1, len(pii.TYPES)):
                    for rest in every(n, segments, j):
                        yield [(i, j, y), *rest]

    for text in ("a.1@b.co 12345678", "+12 3456 (789)", "4111-1111"):
        for tokens, before in pii.windows(text):
            segments = pii.candidates(text, tokens, before)[:7]
            best = max(score(len(tokens), segments, p) for p in every(len(tokens), segments))
            assert abs(score(len(tokens), segments, model.best(len(tokens), segments)) - best) < 1e-9


def test_redaction_and_odd_rows(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "mail a.b@c.org or +1 (555) 123-4567.", "x", 36), (2, None, "y", None)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "mail <email> or <phone>." and got[1].n_chars == len(got[1].text) and got[2].text is None
    assert pii.annotate(odd_docs).count() == odd_docs.count() and pii.redact(odd_docs).columns == odd_docs.columns
    assert pii.annotate(no_docs).collect() == []


def test_long_runs_cost_their_length():
    """Lines without blanks, figures after figures, and a text of a megabyte take seconds, not minutes."""
    import time

    model = pii.field()
    for text, most in (("漢" * 1_000_000 + " 1", 5), ("漢字。" * 200_000 + "12", 15), ("a" * 1_000_000 + " 1", 5), ("\n".join(f"2024-01-{i % 28 + 1:02d},{i % 24:02d}:30:00,{(i * 7919) % 100000 / 100:.2f},{i % 977}" for i in range(3000)), 15)):
        began = time.perf_counter()
        assert pii.find(text, model)[1] == []
        assert time.perf_counter() - began < most


@pytest.mark.parametrize("text", ["Results: 1204 1311 1420 1533 1640 1755 units", "pages 1021, 1044, 1050, 1061, 1077", "years 1998 1999 2000 2001 2002 2003 2004", "version 10.0.19041.1234", "in 1995, 1996, 1997, 1998 and 1999", "1204\t1311\t1420\t1533\n1640\t1755\t1800\t1911"])
def test_figures_are_no_entities(text):
    assert pii.find(text, pii.field()) == ([], [])


def test_figures_in_tables_are_seldom_taken():
    rng = random.Random(12)
    tables = ["\n".join(" ".join(str(rng.randrange(1000, 10000)) for _ in range(6)) for _ in range(8)) for _ in range(60)]
    taken = sum(j - i for t in tables for _, i, j in pii.find(t, pii.field())[1])
    assert taken < 0.02 * sum(map(len, tables))


def test_groups_of_segments_are_settled_as_the_whole():
    """The best path of a stretch is that of its groups of segments."""
    model, found = pii.field(), 0
    for text, *_ in pii._examples(random.Random(3))[:1500]:
        for tokens, before in pii.windows(text + " 12.5 and 7 " + text):
            segments = pii.candidates(text + " 12.5 and 7 " + text, tokens, before)
            parts = [(a + i, a + j, y) for a, b, own in pii.clusters(len(tokens), segments) for i, j, y in model.best(b - a, [(i - a, j - a, on) for i, j, on in own])]
            assert parts == (model.best(len(tokens), segments) if segments else [])
            found += len(parts)
    assert found > 200
