"""Operator 7: toxicity after noisy-channel deobfuscation.

Words that may be disguised (letters mixed with look-alike signs, repetitions, letters
set apart by blanks or points) become character lattices: each sign may stand for
letters, be noise, or repeat its neighbour; a blank or inner punctuation may also end a word. The Viterbi path under a character trigram
model restores the word. Other words have a lattice of one path and stay.

Learnt here: a lexicon of words whose documents are labelled toxic far above chance, from at
most `SAMPLE` labelled rows; the trigram model, from the words of all documents and the
lexicon; and a logistic score over the lexicon words in a restored text, from the sample again.
Only rows with crc32(doc_id) mod 4 other than 2 teach.

Tokens of any length go through the lattice. Lexicon words have at most `LONGEST` letters, a parameter of
the model; so a token without signs that can be noise or a word's end and with more letters is none of them, and only such a one is passed over.

Edge cases: null and empty texts get the score of a text without lexicon words; a long text is scored whole; without
labelled rows or without documents all scores are 0; repeated labels of a document count as toxic if one says so, and of
its repeated rows the one with the least text teaches; repeated rows are scored one by one; an empty table has no rows
in the result; other columns, whatever their names, are passed on by `keep_clean` and not read elsewhere.
"""

from __future__ import annotations

import math
import re
import string
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import documents, held, map_batches, map_text

SAMPLE, LEXICON = 20_000, 2_000
THRESHOLD = 0.3
#: Signs and the letters they may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
LETTERS = "\0" + string.ascii_lowercase  # 0: word boundary
_INDEX = {c: i for i, c in enumerate(LETTERS)}
N = len(LETTERS)
#: Natural logs of the channel: a letter for itself, a sign for a letter, noise left out, a look-alike left out,
#: a repetition left out where a sign stands three times or more, and where it stands twice.
KEEP, SWAP, SKIP, LOSE, REPEAT, TWICE = math.log(0.9), math.log(0.3), math.log(0.2), math.log(0.0005), math.log(0.3), math.log(0.005)
#: The same of a blank between single signs: left out, left out where it is wider than one, and as a word's end.
JOIN, WIDE, BREAK = math.log(0.5), math.log(0.1), math.log(0.5)
LONGEST = 40  # letters of a lexicon word
_EDGE = string.punctuation + "«»“”„‘’…¡¿"
_TWICE = re.compile(r"(.)\1+", re.S)
_LONG = re.compile(r"(.)\1{3,}", re.S)
_APART = re.compile(r"(?<!\S)\S(?!\S)(?:\s++\S(?!\S)){2,}")
_SIGN = re.compile(r"(\s*)(\S)")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def plain_letters(word: str) -> str:
    """Letters a to z of a word, accents dropped."""
    if not word.isascii():
        word = unicodedata.normalize("NFD", word)
    return "".join([c for c in word if "a" <= c <= "z"])


def trigram_counts(words: dict[str, int]) -> np.ndarray:
    """Counts of letter triples, with two boundaries before each word and one after."""
    out = np.zeros(N**3, np.int64)
    for word, n in words.items():
        a = b = 0
        for c in word + "\0":
            i = _INDEX[c]
            out[(a * N + b) * N + i] += n
            a, b = b, i
    return out


def _readings(sign: str) -> str:
    return sign if sign in _INDEX else LOOKALIKES.get(sign, "")


_READ = {sign: frozenset(_readings(sign)) for sign in (*_INDEX, *LOOKALIKES)}
_NONE: frozenset[str] = frozenset()


def _repetitions(signs: list[str] | str) -> list[float | None]:
    """For each sign, the weight of leaving it out as a repetition: the sign before is the same or may be the same letter."""
    out: list[float | None] = [None] * len(signs)
    # letters that a sign may share with the one before; a sign without letters stands for itself
    pair, last = None, _NONE
    for i, sign in enumerate(signs):
        own = _READ.get(sign) or frozenset((sign,))
        now = own & last if i else None
        if now:
            thrice = bool(pair and now & pair)
            out[i] = REPEAT if thrice else TWICE
            if thrice:
                out[i - 1] = REPEAT
                out[i - 2] = REPEAT if out[i - 2] is not None else None
        pair, last = now, own
    return out


class Channel:
    """Restores disguised words."""

    def __init__(self, counts: np.ndarray, lexicon: dict[str, int] | None = None):
        plain = [p for w in lexicon or () if (p := plain_letters(w))]
        self.whole, self.begun = set(plain), {w[:i] for w in plain for i in range(1, len(w) + 1)}
        self.prior = math.log(0.05 / max(1, len(plain)))  # the lexicon's share of words, as in training
        three = counts.reshape(N, N, N).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        share = lambda x: (x + 0.01) / (x + 0.01).sum(axis=-1, keepdims=True)
        self.log = np.log(0.75 * share(three) + 0.2 * share(two)[None] + 0.05 * share(one)[None, None]).tolist()

    def restore(self, token: str) -> str:
        """The most likely word behind a token, in lower-case letters."""
        # a path is its score and a chain of letters, the last one first
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for sign, again in zip(token, _repetitions(token), strict=True):
            arcs = [(c, KEEP if c == sign else SWAP) for c in _readings(sign)]
            lost = again if again is not None else LOSE if sign in LOOKALIKES else SKIP if sign not in _INDEX else None
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, word) in paths.items():
                row = self.log[a][b]
                for c, weight in arcs:
                    i = _INDEX[c]
                    x = score + weight + row[i]
                    if (b, i) not in after or after[b, i][0] < x:
                        after[b, i] = (x, (word, c))
                if lost is not None and ((a, b) not in after or after[a, b][0] < score + lost):
                    after[a, b] = (score + lost, word)
            paths = after or paths
        return _spelt(max(((score + self.log[a][b][0], word) for (a, b), (score, word) in paths.items()), key=lambda x: x[0])[1])

    def restore_words(self, text: str) -> list[str]:
        """The most likely words behind single signs: a blank or inner punctuation may be noise or the end of a word."""
        signs = [(len(m[1]), m[2]) for m in _SIGN.finditer(text)]
        # a path is its score and a chain of letters, the last one first; a blank ends a word
        # its state is the last two letters, or the beginning of a lexicon word, which counts as a whole
        paths: dict[tuple[int, int] | str, tuple[float, tuple | None]] = {(0, 0): (0.0, None), "": (0.0, None)}

        def end(state: tuple[int, int] | str) -> float:
            if isinstance(state, str):
                return 0.0 if not state else self.prior if state in self.whole else -math.inf
            return self.log[state[0]][state[1]][0] if state != (0, 0) else 0.0

        def broken(ends: dict, weight: float) -> tuple[float, tuple | None]:
            return max(((score + weight + end(state), (word, " ")) for state, (score, word) in ends.items()), key=lambda x: x[0])

        for at, ((gap, sign), again) in enumerate(zip(signs, _repetitions([x for _, x in signs]), strict=True)):
            if gap and at:
                cut = broken(paths, BREAK)
                paths = {k: (score + (JOIN if gap == 1 else WIDE), word) for k, (score, word) in paths.items()}
                if (0, 0) not in paths or paths[0, 0][0] < cut[0]:
                    paths[0, 0] = paths[""] = cut
            arcs = [(c, KEEP if c == sign else SWAP) for c in _readings(sign)]
            noise = LOSE if sign in LOOKALIKES else SKIP if sign not in _INDEX else None
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for state, (score, word) in paths.items():
                for c, weight in arcs:
                    if isinstance(state, str):
                        x, then = score + weight, state + c
                        if then not in self.begun:
                            continue
                    else:
                        i = _INDEX[c]
                        x, then = score + weight + self.log[state[0]][state[1]][i], (state[1], i)
                    if then not in after or after[then][0] < x:
                        after[then] = (x, (word, c))
                lost = again if again is not None and state not in ((0, 0), "") else noise
                if lost is not None and (state not in after or after[state][0] < score + lost):
                    after[state] = (score + lost, word)
            if not sign.isalnum():
                cut = broken(paths, SKIP)
                if (0, 0) not in after or after[0, 0][0] < cut[0]:
                    after[0, 0] = after[""] = cut
            paths = after or paths
        return _spelt(broken(paths, 0.0)[1]).split()


def _spelt(chain: tuple | None) -> str:
    """Letters of a chain, the first one first."""
    letters = []
    while chain:
        chain, c = chain
        letters.append(c)
    return "".join(reversed(letters))


def disguised(token: str) -> bool:
    """Whether a token's lattice has more than one path: look-alikes or noise among letters, or a repetition."""
    if token.isalpha() and not _TWICE.search(token):
        return False
    letters = sum(c in _INDEX for c in token)
    return letters >= 1 and len(token) >= 3


class Words(dict):
    """Lexicon numbers (from 1) of the words in raw tokens, remembered; starts anew at `limit` tokens."""

    limit = 200_000

    def __init__(self, lexicon: dict[str, int], channel: Channel):
        super().__init__()
        self.lexicon, self.channel = lexicon, channel
        self.single = {_TWICE.sub(r"\1", w) for w in lexicon}

    def __missing__(self, raw: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        self[raw] = found = self.numbers(raw)
        return found

    def numbers(self, raw: str) -> tuple[int, ...]:
        if found := self.lexicon.get(raw.strip(_EDGE), 0):
            return (found,)
        if not disguised(raw.strip(",;:.?\"'()")):
            return ()
        token = unicodedata.normalize("NFD", raw) if not raw.isascii() else raw
        token = _LONG.sub(r"\1\1\1", "".join(c for c in token if not unicodedata.combining(c)))
        if token.isalpha():  # only repetitions can be left out, so the word is one of those alike without any
            if _TWICE.sub(r"\1", token) not in self.single:
                return ()
            return self._known([self.channel.restore(token)])
        # letters are left out only as repetitions: with more of them than a lexicon word's, the token as one word is none
        if len(_TWICE.sub(r"\1", "".join(c for c in token if c in _INDEX))) <= LONGEST and (found := self._known([self.channel.restore(token)])):
            return found
        inner = token.strip(_EDGE)
        return self._known(self.channel.restore_words(token)) if inner and not inner.isalnum() else ()

    def _known(self, words: list[str]) -> tuple[int, ...]:
        return tuple(i for w in words if (i := self.lexicon.get(w, 0)))

    def apart(self, run: str) -> tuple[int, ...]:
        """Of the words in a run of single signs between blanks."""
        joined = "".join(run.split())
        if found := self.numbers(joined):
            return found
        plain = run if run.isascii() else "".join(c for c in unicodedata.normalize("NFD", run) if not unicodedata.combining(c))
        return self._known(self.channel.restore_words(plain)) if any(c in _INDEX for c in plain) else ()

    def hits(self, text: str | None) -> tuple[list[int], int]:
        """Lexicon numbers of a restored text's words, and its word count."""
        if not text:
            return [], 0
        lower = text.lower()
        words = lower.split()
        found = [i for x in map(self.__getitem__, words) if x for i in x]
        for m in _APART.finditer(lower):
            found += self.apart(m[0])
        return found, len(words)


def features(found: list[int], n_words: int, weights: np.ndarray) -> tuple[float, float, float]:
    total = float(weights[found].sum()) if found else 0.0
    return math.log1p(total), float(len(set(found))), 100.0 * len(found) / n_words if n_words else 0.0


class Model:
    """Lexicon, channel and logistic weights; small enough to travel with each task."""

    def __init__(self, lexicon: list[tuple[str, float]], counts: np.ndarray):
        self.lexicon = {w: i for i, (w, _) in enumerate(lexicon, 1)}
        self.weights = np.array([0.0, *(x for _, x in lexicon)])
        self.counts = counts
        self.logistic: np.ndarray | None = None

    def words(self) -> Words:
        """A reader of texts; a task makes its own."""
        held(("toxicity",), bool)
        return Words(self.lexicon, Channel(self.counts, self.lexicon))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge-damped Newton steps; without both labels, the share of the label alone."""
        if not len(y):
            return
        x = np.column_stack([np.ones(len(y)), x])
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
            w = w + step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        self.logistic = w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.logistic is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.column_stack([np.ones(len(x)), x]) @ self.logistic))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, toxic of at most `most` labelled documents that may teach, whichever have the least hashes; one row each."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    few = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents(docs).join(F.broadcast(few), "doc_id")  # at most `most` rows of two numbers
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _lexicon(sample: DataFrame) -> list[tuple[str, float]]:
    """Words of toxic documents far above their share elsewhere, with log odds; at most `LEXICON`, strongest first."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            toxic, other = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = {w.strip(_EDGE) for w in (text or "").lower().split()}
                (toxic if label else other).update(w for w in found if 2 < len(w) <= LONGEST)
            words = list(toxic.keys() | other.keys())
            return {"word": ["", *words], "toxic": [sum(batch.column("toxic").to_pylist()), *(toxic[w] for w in words)], "other": [batch.num_rows - sum(batch.column("toxic").to_pylist()), *(other[w] for w in words)]}

        return step

    counted = map_text(sample, make, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    total = counted.where("word = ''").select("a", "b").first()
    if not total or not total.a or not total.b:
        return []
    n_a, n_b = total.a, total.b
    odds = F.log((F.col("a") + 0.5) / (n_a - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n_b - F.col("b") + 0.5))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    strong = counted.where("word <> '' and a >= 3").select("word", odds.alias("odds"), (odds / spread).alias("z")).where("z > 3 and odds > 2.5")
    return [(r.word, r.odds) for r in strong.orderBy(F.desc("z"), "word").limit(LEXICON).collect()]


def letter_triples(docs: DataFrame) -> np.ndarray:
    """Counts of letter triples over all words of all documents; the alphabet bounds their number."""

    def make():

        def step(batch: pa.RecordBatch) -> dict:
            words: Counter = Counter()
            for text in batch.column("text").to_pylist():
                if text:
                    words.update(text.lower().split())
            clean: Counter = Counter()
            for w, n in words.items():
                w = w.strip(_EDGE)
                if w.isalpha():
                    clean[plain_letters(w)] += n
            got = trigram_counts(clean)
            at = np.flatnonzero(got)
            return {"triple": at, "n": got[at]}

        return step

    rows = map_text(documents(docs), make, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    out = np.zeros(N**3, np.int64)
    for r in rows.collect():  # at most N**3 rows
        out[r.triple] = r.n
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Lexicon, letter triples and logistic weights."""
    sample = _sample(docs, labels, most)
    lexicon = _lexicon(sample)
    counts = letter_triples(docs)
    if lexicon:
        share = max(1, int(counts.sum()) // (20 * len(lexicon)))  # disguise is likelier for these words than for others
        counts = counts + trigram_counts({p: share for w, _ in lexicon if (p := plain_letters(w))})
    model = Model(lexicon, counts)

    def make():
        words = model.words()

        def step(batch: pa.RecordBatch) -> dict:
            x = [features(*words.hits(t), model.weights) for t in batch.column("text").to_pylist()]
            return dict(zip(("x0", "x1", "x2"), zip(*x, strict=True), strict=True)) | {"toxic": batch.column("toxic")}

        return step

    got = map_text(sample, make, "x0 double, x1 double, x2 double, toxic int").collect()  # at most `most` rows
    table = np.array([tuple(r) for r in got]).reshape(-1, 4)
    model.fit(table[:, :3], table[:, 3])
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def make():
        words = model.words()

        def step(batch: pa.RecordBatch) -> dict:
            x = np.array([features(*words.hits(t), model.weights) for t in batch.column("text").to_pylist()])
            return {"doc_id": batch.column("doc_id"), "score": model.score(x)}

        return step

    scored = map_text(documents(docs), make, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, that are not predicted toxic."""

    def make():
        words = model.words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(*words.hits(t), model.weights) for t in batch.column("text").to_pylist()])
            return batch.filter(pa.array(model.score(x) < THRESHOLD, pa.bool_()))

        return step

    return map_batches(docs, make)
