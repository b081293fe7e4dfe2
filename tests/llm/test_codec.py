import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gritstone.llm import sentencepiece_codec as codec
from gritstone.llm.queries import vocabulary

FILE = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def ids_of(texts):
    model, store = codec.model(FILE)
    flat, counts = store.expand([model.split(t) for t in texts])
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if texts else []


def test_equals_library_on_documents(texts, library):
    all_texts = list(texts.values())
    assert ids_of(all_texts) == library.encode(all_texts)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("  \n\taabcdehlnost.,1290▁éßпр日本ﬁ😀"), max_size=60))
def test_equals_library_on_any_text(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=FILE)
    assert ids_of([text])[0] == sp.encode(text)


@pytest.mark.parametrize("text", ["", " ", " " * 40, "a" * 3000, "日" * 50, "x" + " " * 17 + "y", "\n\n\n"])
def test_equals_library_on_runs(text, library):
    assert ids_of([text])[0] == library.encode(text)


def test_pieces_are_built_as_the_library_builds_them(library):
    model, _ = codec.model(FILE)
    for i in range(300, 32000, 97):
        piece = model.texts[i]
        if model.usable[i] and len(piece) > 1 and piece[0] != codec.MARK:
            ids, counts = model.encode_words([piece])
            assert ids.tolist() == [i]


def test_round_trip_and_odd_rows(spark, odd_docs, no_docs):
    rows = codec.encode(odd_docs, FILE).collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (2, 3)} == {2: 0, 3: 0}
    back = {r.doc_id: r.text for r in codec.decode(codec.encode(odd_docs, FILE, check=False), FILE).collect()}
    assert back[7] == {r.doc_id: r.text for r in odd_docs.collect()}[7]
    assert codec.encode(no_docs, FILE).collect() == []


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_store_forgets_without_harm(texts, limit):
    """A store that keeps few words gives the same ids."""
    from gritstone.llm.wordstore import WordStore

    model, full = codec.model(FILE)
    store = WordStore(model.encode_words, limit=limit)
    for text in list(texts.values())[:40] + ["one two three four", "five six one", "two two two", ""]:
        flat, counts = store.expand([model.split(text)])
        assert flat.tolist() == full.expand([model.split(text)])[0].tolist()
