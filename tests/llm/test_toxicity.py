import zlib

import numpy as np
import pytest

from gritstone.llm import toxicity
from gritstone.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    """On rows that taught nothing; the labels themselves are noisy, mostly towards toxic."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.scores(spark.read.parquet(f"{FOLDER}/documents.parquet"), model).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    y, p = np.array([r.toxic for r in rows]), np.array([r.predicted for r in rows])
    assert p[y == 0].mean() < 0.01 and y[p == 1].mean() > 0.95


@pytest.mark.parametrize("token", ["1d1ot", "idi0t", "i.d.i.o.t", "iiidiooot", "m0r0n", "$tup1d", "tr@sh", "w0rthl3ss"])
def test_disguised_words_are_restored(model, token):
    words = model.words()
    assert words.hits(f"and {token} was")[0], token


def test_words_set_apart(model):
    assert model.words().hits("you i d i o t there")[0] and model.words().hits("a b c d e f")[0] == []


@pytest.mark.parametrize(
    "text, words",
    [("a m o r o n", ["moron"]), ("d u m b i d i o t", ["idiot"]), ("m o r o n i d i o t", ["moron", "idiot"]), ("i d i o t  m o r o n", ["idiot", "moron"]), ("i  d  i  o  t", ["idiot"]), ("i d i o t " * 12, ["idiot"] * 12), ("moron/idi0t", ["moron", "idiot"]), ("idioot", ["idiot"]), ("stuupid", ["stupid"]), ("id" + 40 * "i" + "ot", ["idiot"]), ("idi0" + 38 * "o" + "t", ["idiot"]), ("y o u i d i o t", ["idiot"]), ("s t u p i d i d i o t", ["stupid", "idiot"]), ("." * 90 + "1d1ot", ["idiot"]), ("xyz.-_!" * 40 + ".1d1ot", ["idiot"])],
)
def test_spacing_and_repetition_reach_the_lattice(model, text, words):
    found = model.words().hits(f"you are {text} there")[0]
    names = {i: w for w, i in model.lexicon.items()}
    assert [w for i in found if (w := names[i]) in ("moron", "idiot", "stupid")] == words


@pytest.mark.parametrize("text", ["v1.2.30 of 2024", "mail a.19@mail5.example.com", "l'été à la mer", "THE END!!", "### $$$"])
def test_clean_text_has_no_hits(model, text):
    assert model.words().hits(text)[0] == []


def test_restore_equals_all_readings():
    """The Viterbi path against every reading of short tokens."""
    counts = toxicity.trigram_counts({"abba": 5, "bob": 3, "ebb": 2})
    channel = toxicity.Channel(counts)

    def readings(whole, at=0, word="", score=0.0):
        if at == len(whole):
            a = b = 0
            for c in word + "\0":
                i = toxicity._INDEX[c]
                score += channel.log[a][b][i]
                a, b = b, i
            yield score, word
            return
        sign, previous = whole[at], whole[at - 1] if at else ""
        for c in sign if sign in toxicity._INDEX else toxicity.LOOKALIKES.get(sign, ""):
            yield from readings(whole, at + 1, word + c, score + (toxicity.KEEP if c == sign else toxicity.SWAP))
        letters = lambda x: {x} | set(toxicity.LOOKALIKES.get(x, ""))
        if previous and letters(sign) & letters(previous):
            thrice = any(letters(x) & letters(y) & letters(z) for x, y, z in (whole[i : i + 3] for i in range(max(0, at - 2), min(at, len(whole) - 3) + 1)))
            yield from readings(whole, at + 1, word, score + (toxicity.REPEAT if thrice else toxicity.TWICE))
        elif sign not in toxicity._INDEX:
            yield from readings(whole, at + 1, word, score + (toxicity.LOSE if sign in toxicity.LOOKALIKES else toxicity.SKIP))

    for token in ("4bb4", "b0b", "a.b.b.a", "33bb", "b000b", "b0ob", "b0oob", "8b6a"):
        assert channel.restore(token) == max(readings(token))[1]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (6, 0), (6, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    rows = toxicity.scores(odd_docs, toxicity.train(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.train(no_docs, labels.limit(0))
    assert toxicity.scores(no_docs, none).collect() == [] and {r.score for r in toxicity.scores(odd_docs, none).collect()} == {0.0}
    assert toxicity.keep_clean(odd_docs, none).columns == odd_docs.columns
    assert "op7_toxicity" in QUERIES


def test_one_row_a_document_teaches(spark):
    """A labelled id that is repeated many times brings one row to the driver."""
    docs = spark.range(5000).selectExpr("id % 3 as doc_id", "concat('text ', cast(id % 6 as string)) as text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (9, 1)], "doc_id long, toxic int")
    rows = toxicity._sample(docs, labels, 100).collect()
    assert len(rows) == len({r.doc_id for r in rows}) <= 3 and all(r.text == f"text {r.doc_id}" for r in rows)
