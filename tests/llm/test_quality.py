import inspect
import random
import string

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gritstone.llm import compression_quality as q


def test_base_counts_match_plain_version(spark, small, texts):
    for r in q.assess(spark.read.parquet(f"{small}/documents.parquet")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.band in ("ok", "short"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t\x0b\x85\xa0#$é"), max_size=80))
def test_any_text(text):
    n, chars, symbols, lines, repeats = q.base_counts(text)
    assert (n, chars, symbols, lines, repeats) == brute.quality(text)[:5]


def _words(rng, alphabet, n):
    out = ""
    while len(out.encode()) < n:
        out += "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 10))) + " "
    return out


def test_bands():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choice(words) for _ in range(1500))
    assert q.compression(prose)[3] == "ok"
    assert q.compression("the same line again\n" * 400)[3] == "repetitive"
    assert q.compression("short text")[3] == "short" and q.compression(None)[3] == "short"
    half = prose[:6000] + "tick tock " * 1200
    assert q.compression(half)[3] == "repetitive"  # most chunks are


ALPHABETS = {"letters": "abcdefghijklmnopqrstuvwxyz", "hex": "0123456789abcdef", "base64": string.ascii_letters + string.digits + "+/", "signs": "".join(map(chr, range(33, 127))), "cyrillic": "".join(map(chr, range(0x430, 0x450))), "han": "".join(map(chr, range(0x4E00, 0x9FFF)))}


def test_random_text_of_two_byte_characters_is_a_known_limit():
    assert q.compression(_words(random.Random(1), ALPHABETS["cyrillic"], 20000))[3] == "ok"


@pytest.mark.parametrize("name", [x for x in ALPHABETS if x != "cyrillic"])
def test_random_text_is_rejected(name):
    """From 4096 bytes on; where the alphabet is large, from 512."""
    rng = random.Random(name)
    for n in (4200, 6000, 9000, 20000, 60000, *((600, 1200, 2500) if name in ("base64", "signs") else ())):
        assert all(q.compression(_words(rng, ALPHABETS[name], n))[3] == "random" for _ in range(10)), n


def test_natural_text_is_kept():
    """Prose of this library's documentation at all lengths."""
    prose = inspect.getdoc(random.Random.sample) + "".join(open(m.__file__).read() for m in (inspect, random, string))
    for n in (256, 400, 800, 1500, 3000, 6000, 12000, 30000):
        verdicts = [q.compression(prose[i : i + n])[3] for i in range(0, len(prose) - n, n)]
        assert verdicts.count("random") == 0, n


def test_chunks_cover_the_whole_text():
    rng = random.Random(3)
    for n in (256, 2047, 2048, 2303, 2304, 4000, 5000, 100_000):
        raw = bytes(rng.randrange(97, 123) for _ in range(n))
        parts = q._chunks(raw)
        assert b"".join(parts) == raw and all(256 <= len(x) < q.CHUNK + 256 for x in parts)
    clean = _words(rng, ["alpha ", "beta ", "gamma ", "delta ", "epsilon ", "zeta ", "eta ", "theta "] + [f"w{i} " for i in range(500)], 2048)
    noise = "".join(rng.choice(ALPHABETS["signs"]) for _ in range(1900))
    assert q.compression(clean[:2048] + noise)[1] == 1  # the last, shorter chunk is judged too


def test_odd_rows(odd_docs, no_docs):
    rows = q.assess(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 4, 8))
    kept = q.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert q.assess(no_docs).collect() == [] and q.keep_good(no_docs).collect() == []
