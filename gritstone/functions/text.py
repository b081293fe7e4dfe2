"""Text: scripts, words, templates, markdown chunks, literals."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed ranges of Unicode blocks.
SCRIPTS = (("devanagari", "[\\u0900-\\u097F]"), ("tamil", "[\\u0B80-\\u0BFF]"), ("latin accents", "[\\u00C0-\\u00FF]"))


def script(text: Column) -> Column:
    """The first of the known scripts that a text has a character of."""
    out = F.when(text.rlike(SCRIPTS[0][1]), SCRIPTS[0][0])
    for name, pattern in SCRIPTS[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("plain")


def words(text: Column) -> Column:
    """Distinct lower-case words of letters a to z."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)))


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    """Compatibility form without case; no built-in function has it."""
    return texts.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def question_key(text: Column) -> Column:
    """A question as a key: no case, no signs but hyphens, fault codes in one spelling (E365, e 365: e-365), single blanks."""
    coded = F.regexp_replace(_folded(text), r"\be\s*-?\s*(\d{3})\b", "e-$1")
    return F.trim(F.regexp_replace(coded, r"[^\p{L}\p{M}\p{N}-]+", " "))


def overlap(a: Column, b: Column) -> Column:
    """How many words two sets share."""
    return F.size(F.array_intersect(a, b))


def template(pattern: str, *values: Column) -> Column:
    """A text with `{}` for values; NULL shows as a question mark."""
    parts = pattern.split("{}")
    items = [F.lit(parts[0])]
    for v, tail in zip(values, parts[1:], strict=True):
        items += [F.coalesce(v.cast("string"), F.lit("?")), F.lit(tail)]
    return F.concat(*items)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def listing(items: Column) -> Column:
    """'a, b and c' of an array of texts."""
    n = F.size(items)
    return F.when(n < 2, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def brace_literal(items: Column) -> Column:
    """{a,"b c"}: items with blanks, commas, quotes or braces are quoted."""
    quoted = F.transform(items, lambda x: F.when(x.rlike('[\\s,"{}\\\\]') | (x == ""), F.concat(F.lit('"'), F.regexp_replace(x, '(["\\\\])', "\\\\$1"), F.lit('"'))).otherwise(x))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def read_brace_literal(text: Column) -> Column:
    """The array of a brace literal."""
    items = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"|([^,{}"]+)'), F.lit(0))
    return F.transform(items, lambda x: F.when(x.startswith('"'), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")).otherwise(x))


def sources(text: Column) -> Column:
    """Distinct numbers of the last line that begins with SOURCES:."""
    line = F.regexp_extract(text, r"(?s).*(?:^|\n)SOURCES:([^\n]*)", 1)
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int")))


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section number, heading and body of each markdown section; text before a heading has heading ''."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=#{1,3} )")
    each = docs.select(key, F.posexplode(parts).alias("section", "_p"))
    heading = F.regexp_extract("_p", r"^#{1,3} +([^\n]*)", 1)
    body = F.trim(F.regexp_replace("_p", r"^#{1,3} +[^\n]*\n?", ""))
    return each.select(key, "section", heading.alias("heading"), F.regexp_replace(body, r"^\n+|\n+$", "").alias("body")).where("body <> ''")


def chunks(docs: DataFrame, key: str, text: str, size: int = 2400, overlap_chars: int = 400) -> DataFrame:
    """key, chunk_index, content: paragraphs packed up to `size` characters.

    A chunk begins with the last paragraphs of the one before, up to `overlap_chars`; longer
    paragraphs are cut. Packing is a fold over one text, so it runs as a batched Python function.
    """

    def pack(body: str) -> list[str]:
        pieces = [p[i : i + size] for p in body.split("\n\n") if p.strip() for i in range(0, len(p), size)]
        out: list[str] = []
        held: list[str] = []
        for p in pieces:
            if held and sum(map(len, held)) + 2 * len(held) + len(p) > size:
                out.append("\n\n".join(held))
                tail: list[str] = []
                for q in reversed(held):
                    if sum(map(len, tail)) + len(q) > overlap_chars or sum(map(len, tail)) + len(q) + len(p) + 2 > size:
                        break
                    tail.insert(0, q)
                held = tail
            held.append(p)
        return [*out, "\n\n".join(held)] if held else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b[key], b[text], strict=True) if t for i, c in enumerate(pack(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "content"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, content string")


#: Characters of a piece of a section, and how many of its last ones begin the next.
MOST_CHARS, CARRIED_CHARS = 2400, 400
_EDGES = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"


def packed(body: Column, most: int = MOST_CHARS, carried: int = CARRIED_CHARS) -> Column:
    """Pieces of a text: paragraphs joined until the next would make more than `most` characters; the next piece begins with the last `carried` ones.

    A paragraph is never cut, so a long one makes a long piece.
    """
    glue = F.lit("\n\n")
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        open_ = acc["open"]
        full = (open_ != "") & (F.length(open_) + F.length(p) + 2 > most)
        return F.struct(F.when(full, F.array_append(acc["done"], open_)).otherwise(acc["done"]).alias("done"), F.when(full, F.concat(F.right(open_, F.lit(carried)), glue, p)).when(open_ != "", F.concat(open_, glue, p)).otherwise(p).alias("open"))

    pieces = F.aggregate(F.split(body, r"\n[ \t\n\r\f\x0B]*\n"), begin, step, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    return F.when(F.length(body) <= most, F.array(body)).otherwise(pieces)


def markdown_chunks(docs: DataFrame, key: str, text: str, untitled: Column) -> DataFrame:
    """key, chunk_index, heading, content of markdown texts, all as columns.

    The first line that begins with one # is the title, `untitled` stands for it where there is none; lines with one # are no body. Sections
    begin at lines with two #, what comes before them belongs to the title. Each piece of a section is headed by title and heading. Null texts have no chunks.
    """
    lines = F.concat(F.lit("\n"), F.regexp_replace(F.col(text), "\r\n?", "\n"))
    title = F.when(lines.rlike("\n# "), F.trim(F.regexp_extract(lines, "\n# ([^\n]*)", 1))).otherwise(untitled)
    parts = F.split(F.regexp_replace(lines, "\n# [^\n]*", ""), "\n## ")
    each = docs.where(F.col(text).isNotNull()).select(F.col(key), title.alias("_title"), F.posexplode(parts).alias("_section", "_part"))
    first = F.col("_section") == 0
    heading = F.when(first, F.col("_title")).otherwise(F.trim(F.regexp_extract("_part", "^([^\n]*)", 1)))
    body = F.regexp_replace(F.when(first, F.col("_part")).otherwise(F.regexp_replace("_part", "^[^\n]*", "")), _EDGES, "")
    pieces = each.select(key, "_title", "_section", heading.alias("heading"), body.alias("_body")).where("_body <> ''").select(key, "_title", "_section", "heading", F.posexplode(packed(F.col("_body"))).alias("_piece", "_text"))
    header = F.concat(F.lit("# "), F.col("_title"), F.when(F.col("heading") == F.col("_title"), "").otherwise(F.concat(F.lit("\n## "), F.col("heading"))))
    # numbered within the text it was cut from
    place = F.row_number().over(Window.partitionBy(key).orderBy("_section", "_piece")) - 1
    return pieces.select(key, place.alias("chunk_index"), "heading", F.concat(header, F.lit("\n\n"), F.col("_text")).alias("content"))


#: What a shared fault code adds to a match, or only other codes take from it; the least score of an answer.
CODE_BONUS, LEAST_SCORE = 5, 2


#: Questions of a group, characters of its questions' or answers' texts, answers of a group, and matches that a step of a task adds up at once.
QUESTIONS, CHARS, ANSWERS, STEP = 4096, 4 << 20, 256, 1 << 21


def _groups(df: DataFrame, text: str, most: int) -> int:
    rows, chars = df.agg(F.count(F.lit(1)), F.sum(F.length(text))).first()
    return max(1, -(-rows // most), -(-(chars or 0) // CHARS))


def _places(lists: pa.ChunkedArray, rows: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place in a vocabulary of each token of the lists that is in it."""
    flat = lists.combine_chunks()
    at = pc.index_in(flat.flatten(), value_set=vocabulary)
    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
    return rows[flat.value_parent_indices().to_numpy()][known], at.drop_null().to_numpy()


def _numbered(ids: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct ids in rising order, NULL last, and each row's place among them."""
    found = pc.unique(ids)
    found = found.take(pc.array_sort_indices(found))
    return found, pc.index_in(ids, value_set=found, skip_nulls=False).to_numpy()


def _matches(q: pa.Table, a: pa.Table, tokens: str, q_at: np.ndarray, a_at: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many times answers hold tokens that each question has, repeats in the answer included."""
    vocabulary = pc.unique(a[tokens].combine_chunks().flatten())
    item, token = _places(a[tokens], a_at, vocabulary)
    order = np.argsort(token, kind="stable")
    item, begins = item[order], np.searchsorted(token[order], np.arange(len(vocabulary) + 1))
    question, token = _places(q[tokens], q_at, vocabulary)
    size = np.diff(begins)[token]
    out = np.zeros(shape[0] * shape[1], np.int64)
    upto = np.concatenate([[0], np.cumsum(size)])
    start = 0
    while start < len(token):
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + STEP, side="right")) - 1)
        n = size[start:end]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cell = np.repeat(question[start:end] * shape[1], n) + item[np.repeat(begins[token[start:end]], n) + inner]
        lowest, span = int(cell.min(initial=0)), int(cell.max(initial=0)) + 1
        out[lowest:span] += np.bincount(cell - lowest, minlength=span - lowest)[: span - lowest]
        start = end
    return out.reshape(shape)


def best_matches(questions: DataFrame, answers: DataFrame, q_id: str, a_id: str, text: str, q_words: Column, a_words: Column, q_codes: Column, a_codes: Column, least: int) -> DataFrame:
    """_q, _a, score: for each question's id the best answer that reaches the least score, of equals the smallest id; both frames have a column `text`.

    Questions lie in groups by their id, answers in groups by theirs, and each group of questions meets each group of answers in one task, where matches
    are counted in arrays of a size that the tables don't change. Pairs of words are never rows, so common words cost no shuffle. Rows of one id count as one
    question or answer with the words of all.
    """
    q_groups, a_groups = _groups(questions, text, QUESTIONS), _groups(answers, text, ANSWERS)
    dealt = lambda k, n: F.pmod(F.xxhash64(k), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = questions.select(dealt(q_id, q_groups).alias("_g"), F.col(q_id).alias("_q"), q_words.alias("words"), q_codes.alias("codes")).select("*", every(a_groups).alias("_h"))
    a = answers.select(dealt(a_id, a_groups).alias("_h"), F.col(a_id).alias("_a"), a_words.alias("words"), a_codes.alias("codes")).select("*", every(q_groups).alias("_g"))
    kinds = f"_q {questions.schema[q_id].dataType.simpleString()}, _a {answers.schema[a_id].dataType.simpleString()}, score long"

    def best(q: pa.Table, a: pa.Table) -> pa.Table:
        (q_ids, q_at), (a_ids, a_at) = _numbered(q["_q"]), _numbered(a["_a"])
        shape = (len(q_ids), len(a_ids))
        score = _matches(q, a, "words", q_at, a_at, shape)
        same = _matches(q, a, "codes", q_at, a_at, shape) > 0
        asks, has = np.zeros(shape[0], bool), np.zeros(shape[1], bool)
        for marks, at, t in ((asks, q_at, q), (has, a_at, a)):
            marks[at[pc.greater(pc.list_value_length(t["codes"]), 0).to_numpy()]] = True
        score += CODE_BONUS * np.where(same, 1, -(asks[:, None] & has[None, :]).astype(np.int64))
        if not score.size:
            score = np.full((shape[0], 1), least - 1)
        top = score.argmax(axis=1)  # of equals the first, which has the smallest id
        rows = np.flatnonzero(score[np.arange(shape[0]), top] >= least)
        return pa.table({"_q": q_ids.take(rows), "_a": a_ids.take(top[rows]), "score": pa.array(score[rows, top[rows]], pa.int64())})

    found = q.groupBy("_g", "_h").cogroup(a.groupBy("_g", "_h")).applyInArrow(best, kinds)
    return found.groupBy("_q").agg(F.min_by("_a", F.struct(-F.col("score"), F.col("_a").isNull(), "_a")).alias("_a"), F.max("score").alias("score"))


def best_answers(questions: DataFrame, answers: DataFrame, q_id: str, q_text: str, a_id: str, a_text: str) -> DataFrame:
    """Each question's id with the id and score of its best answer, both NULL if none reaches the least score; of equals the smallest id.

    A score is the number of words of the answer, repeats included, that the question has too: words of three or more letters a to z, digits or
    Devanagari signs. If the question names fault codes (E-123), an answer with one of them gains, one with others alone loses. NULL and
    empty texts have no words or codes.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9ऀ-ॿ\s]", " "), r"\s+"), lambda w: F.length(w) > 2)
    codes = lambda c: F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(r"(E-\d{3})"), 1))
    asked, given = F.coalesce(F.col(q_text), F.lit("")), F.coalesce(F.col(a_text), F.lit(""))
    q, a = questions.select(F.col(q_id), asked.alias("_text")), answers.select(F.col(a_id), given.alias("_text"))
    text = F.col("_text")
    best = best_matches(q, a, q_id, a_id, "_text", F.array_distinct(words(text)), words(text), codes(text), codes(text), LEAST_SCORE)
    return questions.select(F.col(q_id).alias("_q")).join(best, "_q", "left").select(F.col("_q").alias(q_id), F.col("_a").alias(a_id), F.col("score").cast("long").alias("score"))
