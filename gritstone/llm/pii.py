"""Operator 4: personal data with a semi-Markov conditional random field.

Base patterns find emails, IP addresses, card and phone numbers. Around digits and @ the
field then scores candidate segments of up to `MOST` tokens by features of whole spans
(digit count, grouping, checksum, shape, word before) and of neighbouring types; a dynamic
program chooses boundaries and types together. Its spans that no base span overlaps are added: numbers and
addresses in forms that the patterns leave out, and secret tokens. Base spans always stay.

The field learns from generated lines: each type in several written forms, and numbers
that are none of them. Words without digits or @ end a stretch of candidates, lone signs and white space of any
kind and length do not; the program splits there, and most of a text costs one search for digits.
A candidate has at most `MOST` tokens, none of them a sign that no type is written with, and, without @ or letters, at most `MOST_DIGITS` digits, as the longest
card number; so their number grows with the text, however long, also in tables of figures.

Edge cases: null texts are empty; repeated rows are judged one by one; offsets are code points; an empty table
has no rows in the result; other columns, whatever their names, are passed on by `redact` and not read by `annotate`.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import documents, map_batches, map_text

BASE = ("email", "ip", "card", "phone")
#: Types of the field; 0 is no entity.
TYPES = ("none", *BASE, "secret")
MOST = 24
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+@-]+"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain. Runs of the characters that either part may hold are read once each."""
    out = []
    for run in _LOCAL.finditer(text):
        own, base = run[0], run.start()
        at, free = own.find("@"), 0
        while at >= 0:
            local = own.rfind("@", free, at) + 1 or free
            m = _DOMAIN.match(own, at + 1) if at > local else None
            if m:
                out.append((base + local, base + m.end()))
                free = m.end()
            at = own.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind, then place."""
    out = []
    if "@" in text:
        out += [("email", i, j) for i, j in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x) < 4 and int(x) <= 255 or not x.lstrip("0") or len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# The field ------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_CUES = (("email", ("mail", "email", "contact")), ("ip", ("ip", "host", "server", "address")), ("card", ("card", "visa", "mastercard", "credit", "pan")), ("phone", ("phone", "tel", "call", "mobile", "fax")), ("secret", ("token", "key", "secret", "password", "apikey", "bearer")))
_HEX = re.compile(r"[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*")
FEATURES = (
    "bias", "at", "dots", "three dots", "four small numbers", "plus", "bracket", "digits 1-6", "digits 7-8", "digits 9-12", "digits 13-19", "digits 20+", "checksum", "one number", "groups of four", "even groups", "letters and digits",
    "long mixed", "letters only", "ends in letters", "domain end", "cue email", "cue ip", "cue card", "cue phone", "cue secret", "blank inside", "odd sign", "short groups", "joined left", "joined right", "single digits", "four numbers and no cue", "line end and no cue", "begins with 00", "checksum fails", "number beside",
)
K = {name: i for i, name in enumerate(FEATURES)}
_DOMAIN_END = re.compile(r"\.[A-Za-z]{2,6}$")


def span_features(text: str, start: int, end: int, before: str, beside: bool) -> list[int]:
    """Numbers of the features that hold of a whole span. before: the words in front, lower case; beside: a number is next to it, at most a sign between."""
    s = text[start:end]
    numbers = re.findall("[0-9]+", s)
    digits = "".join(numbers)
    n, letters = len(digits), sum(c.isalpha() for c in s)
    on = ["bias", "digits 20+" if n > 19 else "digits 13-19" if n > 12 else "digits 9-12" if n > 8 else "digits 7-8" if n > 6 else "digits 1-6"]
    on += ["at"] * ("@" in s) + ["dots"] * ("." in s) + ["three dots"] * (s.count(".") == 3 and letters == 0) + ["plus"] * (s[0] == "+") + ["bracket"] * ("(" in s)
    on += ["four small numbers"] * (len(numbers) == 4 and letters == 0 and all(len(x) < 4 and int(x) < 256 for x in numbers))
    sums = 12 < n < 20 and luhn(digits)
    on += ["checksum"] * sums + ["checksum fails"] * (12 < n < 20 and not sums) + ["number beside"] * beside + ["one number"] * (s == digits) + ["groups of four"] * (len(numbers) > 2 and letters == 0 and all(len(x) == 4 for x in numbers[:-1]))
    on += ["letters only"] * (n == 0) + ["letters and digits"] * (n > 0 < letters) + ["long mixed"] * (len(s) > 19 and n > 3 and letters > 3 and bool(_HEX.fullmatch(s))) + ["ends in letters"] * s[-1].isalpha()
    on += ["domain end"] * bool(_DOMAIN_END.search(s)) + ["blank inside"] * any(c.isspace() for c in s) + ["odd sign"] * bool(re.search(r"[^\w\s.@+()-]", s)) + ["short groups"] * (len(numbers) > 5) + ["even groups"] * (len(numbers) > 1 and len({len(x) for x in numbers}) == 1)
    cued = [f"cue {kind}" for kind, cues in _CUES if any(c in before for c in cues)]
    on += cued + ["single digits"] * (len(numbers) > 2 and 2 * sum(len(x) == 1 for x in numbers) >= len(numbers)) + ["four numbers and no cue"] * (len(numbers) > 3 and not cued and "+" not in s) + ["line end and no cue"] * ("\n" in s and not cued) + ["begins with 00"] * (s[:2] == "00" and len(numbers) > 2)
    on += ["joined left"] * (start > 0 and text[start - 1].isalnum()) + ["joined right"] * (end < len(text) and text[end].isalnum())
    return [K[x] for x in on]


#: Words with a digit or @, parted by white space and lone signs. A word is tried from its first character only and never twice, so long runs cost their length.
_WORD = r"[^\s0-9@]*+[0-9@]\S*+"
_CHUNK = re.compile(rf"(?<!\S){_WORD}(?:\s++(?:[^\w\s]{{1,3}}\s++)?{_WORD})*+")


def windows(text: str):
    """Stretches with digits or @ in every word; candidates lie inside one."""
    for m in _CHUNK.finditer(text):
        tokens = [(m.start() + t.start(), m.start() + t.end()) for t in _TOKEN.finditer(m[0])]
        front = text[max(0, m.start() - 40) : m.start()]
        yield tokens, re.findall(r"[a-z]+", front.lower())[-3:]


#: Without @, an entity has this many digits at least; without @ and letters, this many at most.
LEAST_DIGITS, MOST_DIGITS = 4, 19
#: No type is written with these signs inside, and a number alone is no entity if it is shorter than a phone number.
APART, LEAST_NUMBER = frozenset(",;:=<>|[]{}#&*?!~^$\"'`\\"), 7


def candidates(text: str, tokens: list[tuple[int, int]], before: list[str]) -> list[tuple[int, int, list[int]]]:
    """Segments (first token, token after the last, features): whole words of signs, from letter, digit, + or ( on, with a digit or @."""
    out = []
    digits_of = [sum(c in "0123456789" for c in text[a:b]) for a, b in tokens]
    letter_in = [any(c.isalpha() for c in text[a:b]) for a, b in tokens]
    figure = [text[a:b].isdigit() for a, b in tokens]

    def number_at(k: int, step: int) -> bool:
        k = k if 0 <= k < len(tokens) and text[tokens[k][0]].isalnum() else k + step
        return 0 <= k < len(tokens) and figure[k]

    near = _near([n > 0 or text[a] == "@" for n, (a, _) in zip(digits_of, tokens, strict=True)])
    for i, (a, _) in enumerate(tokens):
        if not near[i] or not (text[a].isalnum() or text[a] in "+("):
            continue
        inside = re.findall(r"[a-z]+", text[max(tokens[0][0], a - 40) : a].lower())
        front = " ".join([*before, *inside][-3:])
        digits, at, letters = 0, False, False
        for j in range(i + 1, min(i + MOST, len(tokens)) + 1):
            s, b = tokens[j - 1]
            if text[s] in APART:
                break
            digits += digits_of[j - 1]
            at, letters = at or text[s] == "@", letters or letter_in[j - 1]
            if digits > MOST_DIGITS and not at and not letters:
                break
            if (at or digits >= (LEAST_DIGITS if letters else LEAST_NUMBER)) and text[b - 1].isalnum():
                out.append((i, j, span_features(text, a, b, front, number_at(i - 1, -1) or number_at(j, 1))))
    return out


def _near(held: list[bool]) -> list[bool]:
    """Whether one of a token and the MOST - 1 after it is held."""
    out, left = [], 0
    for x in reversed(held):
        left = MOST if x else left - 1
        out.append(left > 0)
    return out[::-1]


def clusters(n: int, segments: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, list[tuple[int, int, list[int]]]]]:
    """(first token, token after the last, segments) of groups of segments that overlap or touch, out of n tokens.

    A token between two groups lies outside on every path, so groups are settled one by one, with the token that follows.
    """
    out: list[list] = []
    for seg in sorted(segments, key=lambda x: x[:2]):
        if out and seg[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], seg[1])
            out[-1][2].append(seg)
        else:
            out.append([seg[0], seg[1], [seg]])
    return [(a, min(b + 1, n), own) for a, b, own in out]


class Field:
    """Weights of span features by type, and of neighbouring types."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def lattice(self, n: int, segments: list[tuple[int, int, list[int]]]) -> list[list[tuple[int, np.ndarray, int]]]:
        """For each end: (start, scores of the types, segment number or -1 for a token outside)."""
        ends: list[list] = [[] for _ in range(n + 1)]
        none = np.full(len(TYPES), -np.inf)
        none[0] = 0.0
        for j in range(1, n + 1):
            ends[j].append((j - 1, none, -1))
        for k, (i, j, on) in enumerate(segments):
            score = self.weights[:, on].sum(axis=1)
            score[0] = -np.inf
            ends[j].append((i, score, k))
        return ends

    def best(self, n: int, segments: list) -> list[tuple[int, int, int]]:
        """(first token, token after the last, type) of the entities on the best path."""
        ends = self.lattice(n, segments)
        top = np.full((n + 1, len(TYPES)), -np.inf)
        top[0, 0] = 0.0
        back: list[list] = [[None] * len(TYPES) for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i, score, _ in ends[j]:
                move = top[i][:, None] + self.moves
                came = move.argmax(axis=0)
                total = move.max(axis=0) + score
                for y in np.flatnonzero(total > top[j]):
                    top[j, y], back[j][y] = total[y], (i, int(came[y]))
        j, y, out = n, int(top[n].argmax()), []
        while j > 0:
            i, x = back[j][y]
            if y:
                out.append((i, j, y))
            j, y = i, x
        return out[::-1]

    def gradient(self, n: int, segments: list, truth: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood of one lattice's true segmentation."""
        ends = self.lattice(n, segments)
        ahead = np.full((n + 1, len(TYPES)), -np.inf)
        ahead[0, 0] = 0.0
        for j in range(1, n + 1):
            for i, score, _ in ends[j]:
                ahead[j] = np.logaddexp(ahead[j], np.logaddexp.reduce(ahead[i][:, None] + self.moves, axis=0) + score)
        behind = np.full((n + 1, len(TYPES)), -np.inf)
        behind[n] = 0.0
        by_start: list[list] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i, score, k in ends[j]:
                by_start[i].append((j, score, k))
        g_weights, g_moves = np.zeros_like(self.weights), np.zeros_like(self.moves)
        total = np.logaddexp.reduce(ahead[n])
        for i in range(n - 1, -1, -1):
            for j, score, k in by_start[i]:
                step = self.moves + (score + behind[j])[None, :]
                behind[i] = np.logaddexp(behind[i], np.logaddexp.reduce(step, axis=1))
                p = np.exp(ahead[i][:, None] + step - total)
                g_moves -= p
                if k >= 0:
                    g_weights[:, segments[k][2]] -= p.sum(axis=0)[:, None]
        place = {(i, j): k for k, (i, j, _) in enumerate(segments)}
        spans = {i: (j, y) for i, j, y in truth}
        i, x = 0, 0
        while i < n:
            j, y = spans.get(i, (i + 1, 0))
            g_moves[x, y] += 1
            if y:
                g_weights[y, segments[place[i, j]][2]] += 1
            i, x = j, y
        return g_weights, g_moves


def _examples(rng: random.Random) -> list[tuple[str, int, int, int]]:
    """Lines with one entity: text, start, end, type (0: none)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeiounrstlhdm") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = rng.choice("3456") + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(s: str, mark: str) -> str:
        return mark.join(s[i : i + 4] for i in range(0, len(s), 4))

    made = []
    for _ in range(40):
        host = f"{word()}.{rng.choice(['com', 'org', 'net', 'de', 'example.com'])}"
        made += [(f"{word()}.{d(2)}@{host}", 1), (f"{word()}@{word()}", 1), (f"{word()}{d(2)}@mail{d(1)}.{host}", 1)]
        made += [(".".join(str(rng.randint(0, 255)) for _ in range(4)), 2)] * 2
        made += [(card(), 3), (grouped(card(), " "), 3), (grouped(card(), "-"), 3), (grouped(card(), "."), 3)]
        pairs = [d(rng.choice([2, 2, 2, 1, 3])) for _ in range(rng.randint(4, 6))]
        made += [(f"{rng.choice(['00 ', ''])}{d(2)} {' '.join(pairs)}", 4), (f"{d(3)} {rng.choice('-/.')} {d(3)} {rng.choice('-/.')} {d(4)}", 4), (f"{d(3)}{rng.choice(['  ', chr(160), chr(10)])}{d(3)}{rng.choice(['  ', chr(160), ' '])}{d(4)}", 4)]
        made += [("  ".join(x[i : i + 4] for x in [card()] for i in range(0, len(x), 4)), 3)]
        made += [(f"+1 ({d(3)}) {d(3)}-{d(4)}", 4), (f"({d(3)}) {d(3)}-{d(4)}", 4), (f"+{d(2)} {d(3)} {d(4)} {d(3)}", 4), (f"{d(3)}-{d(3)}-{d(4)}", 4)]
        made += [("".join(rng.choice("0123456789abcdef") for _ in range(40)), 5)] * 2
        wrong = card()
        made += [(wrong[:-1] + str((int(wrong[-1]) + rng.randint(1, 9)) % 10), 0), (d(14), 0)] if rng.random() < 0.9 else []
        made += [(d(rng.randint(1, 6)), 0), (f"{d(2)}.{d(2)}", 0), (f"{d(4)}-{d(2)}-{d(2)}", 0), (f"{d(2)}:{d(2)}", 0), (f"v{d(1)}.{d(1)}.{d(2)}", 0), (f"{word()}{d(2)}", 0), (f"{d(1)},{d(3)},{d(3)}", 0), (d(9), 0), (d(12), 0), (d(16), 0), (d(rng.randint(13, 19)), 0), (f"{d(2)} {d(2)} {d(3)}", 0), *((" ".join(d(n) for _ in range(rng.randint(3, 14))), 0) for n in (1, 2, 3))]
    for _ in range(60):  # tables of figures
        figure = lambda: rng.choice([d(1), d(2), d(3), d(4), f"{d(1)}.{d(1)}", f"{d(2)},{d(1)}", f"{d(2)}.{d(2)}"])
        made += [("\n".join(rng.choice(" \t").join(figure() for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(2, 5))), 0), (rng.choice(["\n", "  ", " - ", " / "]).join(d(rng.randint(1, 4)) for _ in range(rng.randint(2, 8))), 0)]
    for _ in range(40):  # sums and calls: a sign or bracket right behind a letter or digit
        made += [(f"{d(1)}+{d(rng.randint(4, 5))}", 0), (f"{word()}+{d(rng.randint(4, 9))}", 0), (f"{word()}++{d(4)}", 0), (f"{word()}({d(rng.randint(4, 8))})", 0), (f"{word()}({d(rng.randint(4, 8))}, {d(2)})", 0)]
    for _ in range(40):  # years, pages, versions and tables of four-digit figures
        groups, mark = [rng.choice([d(4), str(rng.randint(1900, 2030)), str(rng.randint(1000, 2000))]) for _ in range(rng.randint(3, 8))], rng.choice([" ", "  ", "\t", "\n", " - ", ". ", " / "])
        made += [(mark.join(groups), 0), (f"{d(2)}.{d(1)}.{d(5)}.{d(4)}", 0), (f"{d(1)}.{d(2)}.{d(4)}.{d(3)}", 0), (f"{d(4)}-{d(2)}-{d(2)} {d(2)}", 0), (f"{d(4)}-{d(2)}-{d(2)}\n{d(4)}-{d(2)}-{d(2)}", 0)]
    cues = {kind: words for kind, words in _CUES}
    out = []
    for s, y in made:
        front = f"{word()} {word()} " + (f"{rng.choice(cues[TYPES[y]])}{rng.choice([' ', ': ', ' = ', ' = ' + chr(34)])}" if y and (y == 5 or " " in s and y == 4 and "(" not in s or rng.random() < 0.4) else "")
        out.append((f"{front}{s}{rng.choice(['', '.', ',', chr(34)])} {word()} {word()}", len(front), len(front) + len(s), y))
    return out


@lru_cache(1)
def field() -> Field:
    """Trained once per process: Adagrad steps on the likelihood of the generated lines, always alike."""
    rng, data = random.Random(7), []
    for text, start, end, y in _examples(rng):
        for tokens, before in windows(text):
            segments = candidates(text, tokens, before)
            first = next((i for i, t in enumerate(tokens) if t[0] == start), None)
            after = next((j for j, t in enumerate(tokens, 1) if t[1] == end), None)
            known = first is not None and any((i, j) == (first, after) for i, j, _ in segments)
            if not y or known:
                data.append((len(tokens), segments, [(first, after, y)] if y else []))
    weights, moves = np.zeros((len(TYPES), len(FEATURES))), np.zeros((len(TYPES),) * 2)
    sums = [np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)]
    found = Field(weights, moves)
    for _ in range(6):
        rng.shuffle(data)
        for start in range(0, len(data), 20):
            grads = [sum(x) for x in zip(*(found.gradient(*row) for row in data[start : start + 20]), strict=True)]
            for value, grad, total in zip((weights, moves), grads, sums, strict=True):
                grad = grad - 0.02 * value
                total += grad**2
                value += 0.5 * grad / np.sqrt(total)
    return found


def _covered(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order; overlapping spans are one stretch."""
    starts, ends = [], []
    for i, j in sorted((i, j) for _, i, j in spans):
        if ends and i < ends[-1]:
            ends[-1] = max(ends[-1], j)
        else:
            starts.append(i)
            ends.append(j)
    return starts, ends


def added_spans(text: str, base: list[tuple[str, int, int]], model: Field) -> list[tuple[str, int, int]]:
    """Spans of the field that overlap no base span."""
    starts, ends = _covered(base)

    def settled(start: int, end: int) -> bool:
        k = bisect_right(ends, start)
        return k < len(ends) and starts[k] < end

    out = []
    for tokens, before in windows(text):
        # what base spans cover is settled; the program runs on what lies between them
        free: list[list[tuple[int, int]]] = [[]]
        for t in tokens:
            if settled(*t):
                free.append([])
            else:
                free[-1].append(t)
        for part in free:
            if part and re.search("[0-9@]", text[part[0][0] : part[-1][1]]):
                for a, b, own in clusters(len(part), candidates(text, part, before)):
                    out += [(TYPES[y], part[a + i][0], part[a + j - 1][1]) for i, j, y in model.best(b - a, [(i - a, j - a, on) for i, j, on in own])]
    return out


def find(text: str | None, model: Field) -> tuple[list, list]:
    """Base spans and added spans of a text."""
    if not text or not ("@" in text or _DIGIT.search(text)):
        return [], []
    base = base_spans(text)
    return base, added_spans(text, base, model)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in sorted(spans, key=lambda s: (TYPES.index(s[0]), s[1], s[2])))


def annotate(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, spans of the base patterns by kind, their digest, and all spans."""
    model = field()

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = [find(t, model) for t in batch.column("text").to_pylist()]
            out = {f"n_{kind}": [sum(s[0] == kind for s in base) for base, _ in found] for kind in BASE}
            return {"doc_id": batch.column("doc_id"), **out, "n_added": [len(more) for _, more in found], "base_sha256": [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], "spans": [_joined([*base, *more]) for base, more in found]}

        return step

    return map_text(documents(docs), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span's text replaced by its kind in angle brackets; n_chars follows where a text changes."""
    model = field()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        new = [_redacted(t, [s for part in find(t, model) for s in part]) for t in texts]
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
        if (at := batch.schema.get_field_index("n_chars")) >= 0:
            counts = [len(b) if a != b else n for a, b, n in zip(texts, new, batch.column(at).to_pylist(), strict=True)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(counts, batch.schema.field(at).type))
        return batch

    return map_batches(docs, lambda: step)


def _redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    out, at = [], 0
    for kind, i, j in sorted(spans, key=lambda s: (s[1], -s[2])):
        if i >= at:
            out += [text[at:i], f"<{kind}>"]
        at = max(at, j)
    return "".join([*out, text[at:]]) if spans else text
