"""Operator 1: SentencePiece encoding and decoding in numpy.

Method: a batched Viterbi over words of equal length. Position by position, the
polynomial hashes of all substrings that end there probe the sorted hashes of the
pieces; a vectorised maximum stores the back pointer of the best arc.

The public model is a byte-pair model, whose encoding is not the best sum of piece
scores: it is the one segmentation in which no merge across the seam of two
neighbouring pieces would have come before the merges that built them. So an arc
counts here only if it fits the piece that the best path to its start ends with
(`PieceModel.fits`); exactly one arc into each position does, and the result
equals the library's own encoding.

Edge cases: a null or empty text has no ids; characters outside the vocabulary
become byte pieces; a literal U+2581 decodes to a space, as in the library; a long text is
encoded whole; repeated rows are encoded one by one; an empty table has no rows in the result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import documents, held, map_text
from .wordstore import WordStore

MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words above this length are cut where no piece has the two characters side by side.
LONG = 48


class PieceModel:
    """The vocabulary as arrays: sorted hashes, scores, lengths and how each piece is built of two others."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.vocab_size()
        self.texts = [sp.id_to_piece(i) for i in range(size)]
        self.bytes_id = np.full(256, sp.unk_id(), np.int32)
        plain = np.zeros(size, bool)
        for i, text in enumerate(self.texts):
            if sp.is_byte(i):
                self.bytes_id[int(text[3:5], 16)] = i
            else:
                plain[i] = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        self.raw = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else t.replace(MARK, " ").encode() for i, t in enumerate(self.texts)]
        ids = np.flatnonzero(plain)
        self.length = np.array([len(t) for t in self.texts] + [1])  # the last stands for an unknown character
        self.score = np.append(np.array([sp.get_score(i) for i in range(size)]), np.inf)
        self.score[self.length == 1] = np.inf  # single characters are there from the start
        self.unknown = size
        self.run = max(len(t) for t in self.texts if not t.strip(MARK))
        self.longest = int(self.length[ids].max())
        self.power = BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        codes = np.zeros((size, self.longest), np.uint32)
        for i in ids:
            codes[i, : len(self.texts[i])] = np.frombuffer(self.texts[i].encode("utf-32-le"), np.uint32)
        self.codes = codes
        hashes = np.zeros(size + 1, np.uint64)
        for j in range(self.longest):
            inside = self.length[:-1] > j
            hashes[:-1][inside] = hashes[:-1][inside] * BASE + codes[inside, j]
        self.hash = hashes
        order = ids[np.argsort(hashes[ids], kind="stable")]
        self.keys, self.key_ids = hashes[order], order
        self.pairs = {t[k : k + 2] for i in ids if len(t := self.texts[i]) > 1 for k in range(len(t) - 1)}
        self.left = np.full(size + 1, -1)
        self.right = np.full(size + 1, -1)
        self.usable = np.append(plain, True)
        self._build()

    def find(self, hashes: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        ids = self.key_ids[at]
        return np.where((self.keys[at] == hashes) & (self.length[ids] == length), ids, -1)

    def _build(self) -> None:
        """The two parts of each piece, shorter pieces first: the split that fits when only earlier merges count."""
        for n in range(2, self.longest + 1):
            ids = self.key_ids[self.length[self.key_ids] == n]
            open_ = np.ones(len(ids), bool)
            for k in range(1, n):
                head, tail = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
                for j in range(k):
                    head = head * BASE + self.codes[ids, j]
                for j in range(k, n):
                    tail = tail * BASE + self.codes[ids, j]
                a, b = self.find(head, k), self.find(tail, n - k)
                ok = open_ & (a >= 0) & (b >= 0)
                ok[ok] &= self.usable[a[ok]] & self.usable[b[ok]]
                ok[ok] &= self.fits(a[ok], b[ok], self.score[ids[ok]])
                self.left[ids[ok]], self.right[ids[ok]] = a[ok], b[ok]
                open_ &= ~ok
            self.usable[ids[open_]] = False

    def fits(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | float = -np.inf) -> np.ndarray:
        """Whether no merge across the seam of pieces `a` and `b` comes before the merges on its sides.

        Goes back in time from the finished pieces: whichever side was merged last
        is opened next. Of equal scores the left one merges first.
        """
        n = len(a)
        good = np.ones(n, bool)
        live = np.arange(n)
        a, b = a.copy(), b.copy()
        until_a = np.broadcast_to(np.asarray(limit, float), n).copy()
        until_b = until_a.copy()
        while len(live):
            length = self.length[a] + self.length[b]
            joined = np.where(length <= self.longest, self.hash[a] * self.power[np.minimum(self.length[b], self.longest)] + self.hash[b], np.uint64(0))
            both = self.find(joined, length)
            known = (both >= 0) & (a != self.unknown) & (b != self.unknown)
            s = np.where(known, self.score[both], -np.inf)
            crossed = known & (s > until_a) & (s >= until_b)
            good[live[crossed]] = False
            open_a, open_b = self.left[a] >= 0, self.left[b] >= 0
            first_b = open_b & (~open_a | (self.score[b] <= self.score[a]))
            first_a = open_a & ~first_b
            keep = ~crossed & (first_a | first_b)
            until_b = np.where(first_b, self.score[b], until_b)
            until_a = np.where(first_a, self.score[a], until_a)
            a, b = np.where(first_a, self.right[a], a), np.where(first_b, self.left[b], b)
            live, a, b, until_a, until_b = live[keep], a[keep], b[keep], until_a[keep], until_b[keep]
        return good

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length: the length of the last piece on the best path to each position, and the piece."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, size).T.astype(np.uint64)
        last = np.full((size + 1, n), -1)
        back = np.zeros((size + 1, n), np.int32)
        #: hashes[l]: of the l characters before the position
        hashes = np.zeros((self.longest + 1, n), np.uint64)
        for end in range(1, size + 1):
            most = min(self.longest, end)
            hashes[1 : most + 1] = hashes[:most] * BASE + codes[end - 1]
            best = np.ones(n, np.int32)
            single = self.find(hashes[1], 1)
            piece = np.where(single >= 0, single, self.unknown)
            if end > 1:
                probes = self.find(hashes[2 : most + 1], np.arange(2, most + 1)[:, None])
                for length in range(2, most + 1):
                    hit = np.flatnonzero(probes[length - 2] >= 0)
                    hit = hit[self.usable[probes[length - 2][hit]]]
                    if len(hit):
                        arc = probes[length - 2][hit]
                        before = last[end - length, hit]
                        good = before < 0
                        good[~good] = self.fits(before[~good], arc[~good])
                        best[hit[good]] = np.maximum(best[hit[good]], length)
                        piece[hit[good]] = arc[good]
            back[end], last[end] = best, piece
        return back, last

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, flat, and their counts; words of equal length advance together."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        parts = []
        for rows in by_length.values():
            for start in range(0, len(rows), 20_000):
                own = rows[start : start + 20_000]
                parts.append(self._trace([words[i] for i in own], np.array(own)))
        row, end, ids = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((end, row))
        row, ids = row[order], ids[order]
        return ids.astype(np.int32), np.bincount(row, minlength=len(words))

    def _trace(self, words: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and id of each piece on the best paths; unknown characters give one id for each byte."""
        back, last = self.viterbi(words)
        live = np.arange(len(words))
        at = np.full(len(words), len(words[0]))
        steps = []
        while len(live):
            steps.append((live, at, last[at, live]))
            at = at - back[at, live]
            live, at = live[at > 0], at[at > 0]
        row, end, piece = (np.concatenate(x) for x in zip(*steps, strict=True))
        end = end * 4
        strange = np.flatnonzero(piece == self.unknown)
        if len(strange):
            raw = [words[r][e // 4 - 1].encode("utf-8", "replace") for r, e in zip(row[strange].tolist(), end[strange].tolist(), strict=True)]
            more = np.repeat(strange, [len(x) for x in raw])
            places = np.concatenate([end[i] + np.arange(len(x)) for i, x in zip(strange, raw, strict=True)])
            row, end, piece = np.append(np.delete(row, strange), row[more]), np.append(np.delete(end, strange), places), np.append(np.delete(piece, strange), self.bytes_id[list(b"".join(raw))])
        return rows[row], end, piece

    def split(self, text: str) -> list[str]:
        """Words that no piece reaches across: a run of marks and what follows it, line ends alone."""
        words = _WORD.findall(MARK + text.replace(" ", MARK)) if text else []
        if self.run * MARK + MARK in MARK + text.replace(" ", MARK):
            words = [x for w in words for x in self._peel(w)]
        if any(len(w) > LONG for w in words):
            words = [x for w in words for x in (self._shorter(w) if len(w) > LONG else [w])]
        return words

    def _peel(self, word: str) -> list[str]:
        """Full runs of marks go first: all their merges have one score, so the library joins them from the left."""
        n = max(0, len(word) - len(word.lstrip(MARK)) - 1) // self.run
        return [MARK * self.run] * n + [word[n * self.run :]]

    def _shorter(self, word: str) -> list[str]:
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs), len(word)]
        return [word[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the mark that encoding put in front is dropped."""
        raw = b"".join([self.raw[i] for i in ids.tolist()])
        return raw.decode("utf-8", "replace").removeprefix(" ")


_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def model(model_file: str) -> tuple[PieceModel, WordStore]:
    """Kept in a worker process from task to task."""
    return held(("sentencepiece", model_file), lambda: _model(model_file))


def _model(model_file: str) -> tuple[PieceModel, WordStore]:
    found = PieceModel(model_file)
    for piece in found.texts:
        if len(piece) > 1 and not piece.startswith("<") and ("\n" in piece or re.search(f"[^{MARK}]{MARK}", piece)):
            raise ValueError(f"{model_file} has a piece across words: {piece!r}")
    return found, WordStore(found.encode_words)


def encode(docs: DataFrame, model_file: str, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids of each row; with `check`, whether decoding gives the text back.

    Null texts have no ids and count as given back. Rows of one doc_id each stay a row.
    """

    def make():
        pieces_, store = model(model_file)

        def step(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            flat, counts = store.expand([pieces_.split(t) for t in texts])
            ends = np.concatenate([[0], np.cumsum(counts)])
            out = {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}
            if check:
                out["round_trip"] = [pieces_.decode(flat[i:j]) == t.replace(MARK, " ") for t, i, j in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            return out

        return step

    return map_text(documents(docs), make, "doc_id long, n_tokens long, ids array<int>" + ", round_trip boolean" * check)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give an empty text."""

    def run(batches):
        pieces_, _ = model(model_file)
        for batch in batches:
            texts = [pieces_.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
