import random

import brute
import numpy as np
import pytest

from gritstone.llm import minhash as m


LIKE = m.Likeness(words=3, share=85)


def found(df, like=LIKE):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in m.duplicates(df, like).collect()}


def test_documents(spark, small, texts):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found(docs) == brute.near_duplicates(texts.items())
    assert found(docs, m.Likeness()) == brute.near_duplicates(texts.items(), 5, 80)


def test_bands_suffice():
    for like in (LIKE, m.Likeness(), m.Likeness(5, 95)):
        assert (1 - (like.share / 100) ** m.ROWS) ** like.bands <= 1e-6 and like.hashes % 8 == 0


@pytest.mark.parametrize("small_band", [2, 12])
def test_large_group_of_near_copies(spark, monkeypatch, small_band):
    """Copies of one text with few or many edits, and copies of those copies: links and chains, in lists and in blocks."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    rows, near = [], []
    for i in range(150):
        own = list(rng.choice(near) if near and i % 3 == 0 else base)
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(150)] = word()
        near.append(own)
        rows.append((1000 - i, " ".join(own)))
    rows += [(i, " ".join(word() for _ in range(40))) for i in range(2000, 2040)]
    monkeypatch.setattr(m, "SMALL", small_band)
    monkeypatch.setattr(m, "ASKING", 2000)
    monkeypatch.setattr(m, "ASKED", 4000)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute.near_duplicates(rows)


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        union = rng.integers(1, 1 << 62, 2000, dtype=np.uint64)
        n = int(share * 2000)
        a, b = np.append(union[:n], union[n : n + (2000 - n) // 2]), np.append(union[:n], union[n + (2000 - n) // 2 :])
        sigs = [np.frombuffer(m.sketch(np.unique(x), LIKE)[0], np.uint8)[None] for x in (a, b)]
        assert abs(m.estimate(*sigs)[0] - share) < 0.15


def test_odd_rows(odd_docs, no_docs):
    rows = m.duplicates(odd_docs, LIKE).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[2] == [(0, 2, True)] and by[3][0] == (0, 3, True) and by[4][0] == (0, 4, True)
    assert by[6] == [by[6][0]] * 2 and by[6][0][1:] == (1, False) and by[1][0][1:] == (1, True)
    assert by[None][0][1:] == (None, True) and by[8][0] == (1, 8, True)
    assert m.duplicates(no_docs).collect() == []


def test_texts_of_one_document_are_linked(spark):
    a, b, c = ("one text of some length", "quite another text than that", "a third one of its own")
    rows = [(1, a), (6, a), (6, b), (9, b), (4, c), (None, b)]
    got = m.duplicates(spark.createDataFrame(rows, "doc_id long, text string"), LIKE).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (4, 4, True), (6, 1, False), (6, 1, False), (9, 1, False)]


def test_heavy_keys_lose_no_rows(spark, monkeypatch):
    """Joins whose keys are dealt over tasks, with every key heavy and with none."""
    from gritstone.llm import frames

    rows = frames.cut(spark.range(1000).selectExpr("id", "if(id % 3 = 0, 0, id) as k"), "rows")
    one = rows.select("k").distinct().withColumn("twice", rows.k * 2)
    for heavy in (1, 10**9):
        monkeypatch.setattr(frames, "HEAVY", heavy)
        got = frames.join_dealt(rows, one, "k", "id").collect()
        assert sorted((r.id, r.k, r.twice) for r in got) == sorted((i, k, 2 * k) for i in range(1000) if (k := 0 if i % 3 == 0 else i) is not None)


def test_minima_of_a_long_text_take_bounded_memory(monkeypatch):
    """Stretches of shingles give what the whole gives, and no table of all shingles by functions is made."""
    import tracemalloc

    import numpy as np

    from gritstone.llm import minhash

    found = np.random.default_rng(1).integers(0, 1 << 63, 1_000_000, dtype=np.uint64)
    few = minhash.minima(found[:5000], 64)
    tracemalloc.start()
    minhash.minima(found, 64)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    monkeypatch.setattr(minhash, "STRETCH", 37)
    assert (minhash.minima(found[:5000], 64) == few).all()
