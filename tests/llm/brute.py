"""Plain versions of the contracts, for small tables."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {k for i, g in enumerate(grams) if g in twice for k in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def shingle_set(text, n=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def near_duplicates(rows, words=3, share=85):
    """(doc_id, n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {}
    for ids in by.values():
        for x in range(len(ids)):
            for y in range(x):
                k = (ids[y], ids[x])
                pairs[k] = pairs.get(k, 0) + 1
    for (a, b), n in pairs.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c in "0123456789"]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def private(text):
    text = text or ""
    n = lambda m: sum(c in "0123456789" for c in m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= n(m) <= 19 and luhn(m[0])]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= n(m) <= 15]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns(rows):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of (turn, role, text) rows."""
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda x: (*x[:2], digest(x[2])))
    loss = "".join(x for _, r, x in rows if r == "assistant")
    return len(rows), digest("".join(f"{r}\n{x}\n" for _, r, x in rows)), len(loss), digest(loss)


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())
