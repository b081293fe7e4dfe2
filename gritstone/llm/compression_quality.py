"""Operator 2: quality rules with compression bands.

zstandard ratios (compressed over plain bytes) of the whole document and of fixed
chunks are held against a band that depends on the length and on whether most characters are
single bytes: text below it repeats itself, text above it is close to random. From 4096 bytes on the
ratio must also stay below the order-0 entropy of the text's own bytes: random text in any alphabet
compresses to that and hardly further, natural text well below it. The last chunk takes in what is left over, so
chunks cover the whole text. Base counts of words, symbols, repeated lines and repeated five-word windows come along.

Edge cases: a null or empty text has no words and fails the base rule. Texts shorter than
the first band's length have no compression verdict: their ratio says nothing. A long text is read whole.
Repeated rows are judged one by one; an empty table has no rows in the result; other columns, whatever their
names, are not read. Below 4096 bytes random words of a small alphabet (letters, hex digits) compress
like prose and stay within the bands; so do random words of two-byte characters at any length, as their
leading bytes repeat.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import documents, map_batches, map_text

#: From so many bytes on: least ratio, most where nine tenths of the bytes are characters, most otherwise, most over the order-0 entropy.
BANDS = ((256, 0.25, 0.88, 0.95, None), (512, 0.25, 0.80, 0.92, None), (1024, 0.25, 0.72, 0.85, None), (2048, 0.24, 0.66, 0.80, None), (4096, 0.22, 0.64, 0.75, 0.995), (8192, 0.20, 0.62, 0.72, 0.975), (16384, 0.18, 0.60, 0.70, 0.95))
#: Chunk bytes, and the share of chunks outside their bands that is too much.
CHUNK, CHUNK_SHARE = 2048, 0.5
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, odd_chunks long, n_chunks long, band string, kept boolean"


@lru_cache(1)
def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=3, write_checksum=False)


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words that lie in an n-word window found twice or more, the first time included."""
    if len(words) <= n:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) > len(words) - 1:
        return 0  # all words differ
    key, width = ids, 1
    while width < n:  # windows of `width` words get dense numbers, so that two of them fit one key
        step = min(width, n - width)
        head, tail = key[: len(key) - step], key[step:]
        key = np.unique(head * (int(key.max()) + 1) + tail, return_inverse=True)[1]
        width += step
    twice = np.flatnonzero(np.bincount(key)[key] > 1)
    if not len(twice):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + n, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, characters in them, symbols, repeated lines with a word, repeated words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    chars = len(text) - sum(map(raw.count, map(bytes, zip(BLANKS, strict=True))))
    symbols = sum(map(raw.count, map(bytes, zip(SYMBOLS, strict=True))))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _entropy(raw: bytes) -> float:
    """Order-0 entropy of bytes, in bytes a byte."""
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    share = share[share > 0]
    return float(-(share * np.log2(share)).sum()) / 8


def _judged(raw: bytes) -> tuple[float, str]:
    """Ratio of some text, and whether it lies in its length's band: ok, repetitive or random."""
    ratio = len(_compressor().compress(raw)) / len(raw)
    _, low, plain, wide, over = next(b for b in reversed(BANDS) if len(raw) >= b[0])
    characters = len(raw) if raw.isascii() else len(raw.decode("utf-8", "ignore"))
    if ratio < low:
        return ratio, "repetitive"
    return ratio, "random" if ratio > (plain if 10 * characters >= 9 * len(raw) else wide) or over is not None and ratio > over * _entropy(raw) else "ok"


def _chunks(raw: bytes) -> list[bytes]:
    """Fixed chunks of all of a text; a rest too short for a band belongs to the last one."""
    starts = list(range(0, len(raw), CHUNK))
    if len(starts) > 1 and len(raw) - starts[-1] < BANDS[0][0]:
        starts.pop()
    return [raw[i:j] for i, j in zip(starts, [*starts[1:], len(raw)], strict=True)]


def compression(text: str | None) -> tuple[float | None, int, int, str]:
    """Ratio of the whole text, chunks outside their bands, chunks, and the verdict: ok, short, repetitive or random."""
    raw = (text or "").encode("utf-8", "replace")
    if len(raw) < BANDS[0][0]:
        return None, 0, 0, "short"
    ratio, verdict = _judged(raw)
    chunks = [_judged(x)[1] for x in _chunks(raw)]
    for odd in ("repetitive", "random"):
        if verdict == "ok" and chunks.count(odd) > CHUNK_SHARE * len(chunks):
            verdict = odd
    return ratio, len(chunks) - chunks.count("ok"), len(chunks), verdict


def assess(docs: DataFrame) -> DataFrame:
    """Counts, ratio and verdict of every row; `kept` is false if the base rule or the band rejects it."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            n, chars, symbols, lines, repeats = (np.array(x, np.int64) for x in zip(*map(base_counts, texts), strict=True))
            ratio, odd, chunks, band = zip(*map(compression, texts), strict=True)
            failed = (n < 10) | (100 * repeats > 20 * n)
            kept = ~failed & np.array([b in ("ok", "short") for b in band])
            return {"doc_id": batch.column("doc_id"), "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeats, "base_failed": failed, "ratio": ratio, "odd_chunks": odd, "n_chunks": chunks, "band": band, "kept": kept}

        return step

    return map_text(documents(docs), make, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep; a row is judged by its own text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        keep = [(b := base_counts(t))[0] >= 10 and 100 * b[4] <= 20 * b[0] and compression(t)[3] in ("ok", "short") for t in texts]
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, lambda: step)
