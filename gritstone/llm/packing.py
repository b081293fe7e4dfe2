"""Operator 5: packing token sequences with hierarchical residual packing.

Partitions pack their own pieces best-fit (longest first, into the open bin with the
least room that suffices). Bins with almost no room left are final. The others become
items of the next round, where fewer partitions pack them again as wholes, and so on:
a tree whose inner nodes see only bins with room. Each round is a written table, so
its bins are made once and survive lost executors. A task packs at most
`FLUSH` items at a time, and a round has a partition for every `ROUND_ITEMS` bins, so
no round gathers the corpus in one task.

Edge cases: null and empty texts are one piece of the end id alone; repeated rows are
packed as often as they occur; a long text is cut into pieces and packed whole; an empty table packs into no bins;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_schema, cut, documents, held, keep, map_text, scratch, scratched
from .wordstore import WordStore

FLUSH = 200_000
ROUND_ITEMS = 50_000
MEMBERS = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"
BINS = f"sequence_id long, used long, members {MEMBERS}"


#: A private-use character that parts words which are encoded together.
_PART = "\ue000"
#: A full stop or comma right after a letter or digit, at a word's end.
_STOP = re.compile(r"([.,])(?<=[^\W_][.,]) ")


def word_ids(tokenizer_file: str) -> WordStore:
    """Ids by space-separated word; the tokenizer never joins what a space or line end parts."""
    return held(("packing", tokenizer_file), lambda: _word_ids(tokenizer_file))


def _word_ids(tokenizer_file: str) -> WordStore:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    ids_of = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    between = np.array(ids_of([_PART])[0])
    ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
    ends_word[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True

    def joined(words: list[str], mark: str) -> np.ndarray:
        return np.array([i for x in ids_of([mark.join([*words[i : i + 400], ""]) for i in range(0, len(words), 400)]) for i in x], np.int32)

    def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone are one unit each for the tokenizer, and a unit's last id says so."""
        ids = joined(words, " ")
        ends = np.flatnonzero(ends_word[ids])
        return ids, np.diff(np.append(-1, ends))

    def others(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words at once, with a mark between them whose ids give the words' ends away."""
        if any(_PART in w for w in words):
            found = ids_of(words)
            return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found])
        ids, n = joined(words, f" {_PART} "), len(between)
        marks = np.flatnonzero(np.logical_and.reduce([ids[k : len(ids) - n + 1 + k] == between[k] for k in range(n)]))
        counts = np.diff(np.append(-n, marks)) - n
        return np.delete(ids, (marks[:, None] + np.arange(n)).ravel()), counts

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([w.isalpha() and w.lower().isalpha() for w in words])
        parts = [(f, np.flatnonzero(chosen)) for f, chosen in ((letters, plain), (others, ~plain)) if chosen.any()]
        got = [(*f([words[i] for i in at.tolist()]), at) for f, at in parts]
        if any(len(counts) != len(at) for _, counts, at in got):  # some sign that is no letter to the tokenizer
            return others(words)
        ids, counts, at = (np.concatenate(x) for x in zip(*got, strict=True))
        starts = np.cumsum(counts) - counts
        order = np.argsort(at)
        counts = counts[order]
        ends = np.cumsum(counts)
        return ids[np.repeat(starts[order] - (ends - counts), counts) + np.arange(len(ids))], counts

    return WordStore(encode)


def plain_words(text: str) -> str:
    """Words, parted by blanks, whose ids, one after another, are the text's; as few different ones as can be.

    The tokenizer ignores case and cuts signs from letters. So text is lowered where that gives
    the same letters as the tokenizer's own lowering, and a full stop or comma after a letter is parted from it.
    """
    text = text.replace("\n", " ")
    if text.isascii():
        text = text.lower() if "<|" not in text else text  # special tokens are written in lower case
    elif "\u0130" in text or "\u03a3" in text:
        return text  # lowered, these depend on what follows or leave a mark behind
    elif "<|" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", lower := text.lower()):
        text = lower
    return _STOP.sub(r" \1 ", text)


def tokenise(docs: DataFrame, tokenizer_file: str, end_id: int = 1, limit: int = 4096, ids: bool = False) -> DataFrame:
    """Pieces of at most `limit` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def make():
        store = word_ids(tokenizer_file)

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            words = pc.split_pattern(pa.array([plain_words(t) if t else "" for t in texts], pa.string()), " ")
            flat, counts = store.expand_flat(words.flatten(), pc.list_value_length(words).to_numpy().astype(np.int64))
            ends = np.cumsum(counts)
            flat = np.insert(flat, ends, end_id).astype("<u4")  # each document's end id follows its own ids
            sizes = counts + 1
            first = np.cumsum(sizes) - sizes
            n = -(-sizes // limit)
            owner = np.repeat(np.arange(len(texts)), n)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * limit
            length = np.minimum(limit, sizes[owner] - start)
            at = first[owner] + start
            raw = flat.tobytes()
            spans = list(zip((at * 4).tolist(), ((at + length) * 4).tolist(), strict=True))
            out = {"doc_id": batch.column("doc_id").take(pa.array(owner)), "piece": piece, "start": start, "length": length, "ids_crc32": [zlib.crc32(raw[i:j]) for i, j in spans]}
            if ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(flat, pa.int32()))
            return out

        return step

    return map_text(documents(docs), make, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Bins as lists of item numbers. Longest items first; each goes where least room is left over."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0  # bit r: some open bin has room r
    bins: list[list[int]] = []
    for i in order:
        n = sizes[i]
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = limit, len(bins)
            bins.append([i])
        room -= n
        if room:
            by_room[room].append(at)
            rooms |= 1 << room
    return bins


def _pack_round(items: DataFrame, level: int, limit: int) -> DataFrame:
    """Best-fit within each partition over rows of used and members."""

    def run(batches):
        schema = arrow_schema([("sequence_id", "bigint"), ("used", "bigint"), ("members", MEMBERS)])
        number = (level << 56) | (TaskContext.get().partitionId() << 32)

        def flush(got):
            nonlocal number
            used, members = pa.concat_arrays([x.column("used") for x in got]), pa.concat_arrays([x.column("members") for x in got])
            sizes = used.to_numpy()
            bins = best_fit(sizes.tolist(), limit)
            order = np.fromiter((i for b in bins for i in b), np.int64, len(sizes))
            per_bin = np.fromiter(map(len, bins), np.int64, len(bins))
            moved = members.take(pa.array(order))
            inner = np.append(0, np.cumsum(pc.list_value_length(moved).to_numpy()))
            outer = inner[np.append(0, np.cumsum(per_bin))]
            flat = moved.flatten()
            length = flat.field("length").to_numpy()
            before = np.cumsum(length) - length
            offset = before - np.repeat(before[outer[:-1]], np.diff(outer))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            flat = pa.StructArray.from_arrays([*(flat.field(n) for n in names), pa.array(offset, pa.int64())], fields=list(schema.field("members").type.value_type))
            total = np.add.reduceat(sizes[order], np.append(0, np.cumsum(per_bin))[:-1])
            out = pa.RecordBatch.from_arrays([pa.array(np.arange(len(bins)) + number, pa.int64()), pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(outer, pa.int32()), flat)], schema=schema)
            number += len(bins)
            for i in range(0, len(bins), 2000):
                yield out.slice(i, 2000)

        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= FLUSH:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    return items.select("used", "members").mapInArrow(run, BINS)


@scratched
def pack(pieces: DataFrame, limit: int = 4096, nearly: int = 16, fan: int = 8) -> DataFrame:
    """Pieces with sequence_id and offset. `nearly`: bins with at most this room are final; `fan`: partitions merged by a round."""
    member = F.struct("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    items = pieces.select(F.col("length").alias("used"), F.array(member).alias("members"))
    done, level, parts, before = [], 0, items.rdd.getNumPartitions(), None
    while True:
        bins = cut(_pack_round(items, level, limit), f"bins{level}")
        under = bins.where(F.col("used") < limit - nearly)
        n = under.count()
        last = parts <= 1 or n < 2 or (before is not None and n > 0.99 * before)
        keep(bins)
        done.append(bins if last else bins.where(F.col("used") >= limit - nearly))
        if last:
            break
        parts, before, level = max(-(-parts // fan), math.ceil(n / ROUND_ITEMS)), n if level else None, level + 1
        items = under.select("used", "members").coalesce(parts)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 1, limit: int = 4096) -> DataFrame:
    """Documents to packed pieces."""
    with scratch(docs.sparkSession) as own:
        out = pack(cut(tokenise(docs, tokenizer_file, end_id, limit), "pieces"), limit)
        own.keep_passed()
    return out


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_file: str, end_id: int = 1, limit: int = 4096) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, at most `limit` each."""
    key = ["doc_id", "piece", "length", "ids_crc32"]
    ids = tokenise(docs, tokenizer_file, end_id, limit, ids=True).dropDuplicates(key).select(*key, "ids")
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"i.{k}")) for k in key]
    placed = packed.alias("p").join(ids.alias("i"), on).select("sequence_id", F.struct("offset", "ids").alias("part"))
    return placed.groupBy("sequence_id").agg(F.expr("flatten(transform(array_sort(collect_list(part)), x -> x.ids))").alias("ids"))
