from collections import defaultdict

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gritstone.llm import packing
from gritstone.llm.queries import vocabulary

FILE = vocabulary("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_places_every_item_once(sizes):
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)


def check(docs, rows, limit):
    tokenizer = Tokenizer.from_file(FILE)
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in docs}
    by = defaultdict(list)
    for r in rows:
        assert r.length <= limit and brute.crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    total = sum(len(ids[d]) for d, _ in docs)
    assert sum(r.length for r in rows) == total
    return len(by), -(-total // limit)


@pytest.mark.parametrize("limit", [64, 4096])
def test_pieces_and_offsets(spark, small, texts, limit):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(12)
    rows = packing.pack_documents(docs, FILE, 1, limit).collect()
    bins, least = check(list(texts.items()), rows, limit)
    assert bins <= least * 1.02 + 1


def test_tree_merges_small_partitions(spark):
    """Forty partitions with one small piece each end in few bins."""
    docs = spark.createDataFrame([(i, "word " * 9) for i in range(40)], "doc_id long, text string").repartition(40, "doc_id")
    rows = packing.pack_documents(docs, FILE, 1, 100).collect()
    assert len({r.sequence_id for r in rows}) <= 5  # ten pieces of ten ids fill one; bins merge as wholes


def test_sequences_hold_the_ids(spark, small, texts):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    packed = packing.pack_documents(docs, FILE)
    out = packing.sequences(docs, packed, FILE).collect()
    assert sum(len(r.ids) for r in out) == sum(r.length for r in packed.collect()) and max(len(r.ids) for r in out) <= 4096


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, FILE).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.doc_id] += r.piece == 0
    assert by[6] == 2 and by[None] == 1 and by[2] == 1
    assert [r.length for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert packing.pack_documents(no_docs, FILE).collect() == []
