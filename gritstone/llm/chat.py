"""Operator 6: chat formatting in budgeted windows.

Running sums of turn tokens cut a conversation into spans of whole turns. Each span is
formatted as a window: the system turn, all turns before the span that begin within the
history budget of its beginning, whatever spans they are from, then the span's own turns. The loss
mask covers an assistant's text in its own span only; system and history turns that are repeated stay unmasked.

The running sum has two levels, within runs of `RUN` turn numbers and over the runs'
totals, so a very long conversation is summed in many tasks. A window stays within its
budget, of which parts are set aside for history and system turn, unless the system turn
is longer than its part or a single turn longer than what is left.

Template: `<s>` and `</s>` delimit the window, `[INST] ` role ` [/INST]` opens a turn. Inside
roles and texts, `[` and `<` that begin a control string, and the escape sign `\\`, get
the sign in front; so no text can end its turn, and removing one sign gives the text back.

Edge cases: null texts and roles are empty; null conversation ids are a conversation of
their own; null turn numbers come first; equal turn numbers follow in the order of role and of a sha256 of the whole
text, so the order of rows in the table has no say; repeated rows are turns each; a text is never cut; an empty
table has no windows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import cut, keep, scratched

BUDGET, HISTORY, SYSTEM, RUN = 2048, 512, 256, 256
HEAD, TAIL, OPEN, CLOSE = "<s>", "</s>", "[INST] ", " [/INST]"
_ESCAPE = r"(\\|<(?=/?s>)|\[(?=/?INST\]))"
ROLE_SYSTEM, ROLE_TARGET = "system", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


@lru_cache(2)
def _tokenizer(file: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(file)
    found.encode_special_tokens = True
    return found


def with_tokens(turns: DataFrame, tokenizer_file: str) -> DataFrame:
    """Adds n_tokens, the tokens of `body`."""

    def run(batches):
        tokenizer = _tokenizer(tokenizer_file)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                n = [len(x.ids) for x in tokenizer.encode_batch_fast(part.column("body").to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], [*part.schema.names, "n_tokens"])

    return turns.mapInArrow(run, T.StructType([*turns.schema.fields, T.StructField("n_tokens", T.LongType())]))


@scratched
def format_windows(conversations: DataFrame, tokenizer_file: str, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM) -> DataFrame:
    """One row a window: conv_id, window, n_turns, n_repeated, text, loss (spans of code points, end exclusive)."""
    base = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    body = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE), escape(F.col("text")))
    numbered = base.select("conv_id", "turn", "role", body.alias("body"), F.unhex(F.sha2("text", 256)).alias("whole"), F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 40))).alias("run"))
    turns = cut(with_tokens(numbered, tokenizer_file).withColumn("id", F.monotonically_increasing_id()), "turns")
    # spans are chosen on lengths alone; the texts join them once, when all is placed
    order = [F.col("turn").asc_nulls_first(), "role", "whole", "id"]
    run = Window.partitionBy("conv_id", "run").orderBy(*order)
    inner = turns.drop("body").withColumns({"in_run": F.sum("n_tokens").over(run.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(run)})
    runs = turns.groupBy("conv_id", "run").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy("conv_id").orderBy("run")
    runs = runs.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), (F.sum("n").over(earlier) - F.col("n")).alias("before"), (F.sum("k").over(earlier) - F.col("k")).alias("k_before"))
    placed = inner.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r"))).select(
        "id", "conv_id", "role", (F.col("in_run") + F.col("before") - F.col("n_tokens")).alias("begin"), (F.col("in_run") + F.col("before")).alias("upto"), (F.col("nth") + F.col("k_before")).alias("place")
    )
    # the running sum is ruled into stretches; a span holds the turns inside one, or the single turn that crosses its end
    stretch = max(1, budget - history - system)
    begins, ends = F.floor(F.col("begin") / stretch), F.floor((F.col("upto") - 1) / stretch)
    placed = cut(placed.withColumn("window", (2 * begins + (ends > begins).cast("long")).cast("long")), "placed")
    head = (F.col("place") == 1) & (F.col("role") == ROLE_SYSTEM)
    starts = placed.groupBy("conv_id", "window").agg(F.min("begin").alias("start"))
    rows = placed.select("id", "conv_id", "window", "place", F.lit(True).alias("own"))
    rows = rows.unionByName(_history(placed.where(~head), starts, history)).unionByName(_systems(placed.where(head), starts))
    keep(turns, placed)
    return _format(rows.join(turns.select("id", "role", "body"), "id"))


def _history(placed: DataFrame, starts: DataFrame, history: int) -> DataFrame:
    """Turns in later windows: those that begin at most `history` tokens before a window that starts at or after their end.

    Both sides meet by stretches of `history` tokens; a turn looks into the two that its windows can start in.
    """
    if history <= 0:
        return placed.limit(0).select("id", "conv_id", "window", "place", F.lit(False).alias("own"))
    part = lambda x: F.floor(x / history)
    near = placed.where(F.col("upto") <= F.col("begin") + history).select("id", "conv_id", "place", "begin", "upto", F.explode(F.array_distinct(F.array(part(F.col("begin")), part(F.col("begin") + history)))).alias("part"))
    to = starts.select(F.col("conv_id").alias("c"), "window", "start", part(F.col("start")).alias("p"))
    meets = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    inside = (F.col("start") >= F.col("upto")) & (F.col("start") <= F.col("begin") + history)
    return near.join(to, meets).where(inside).select("id", "conv_id", "window", "place", F.lit(False).alias("own"))


def _systems(systems: DataFrame, starts: DataFrame) -> DataFrame:
    """The system turn in every window after the first."""
    later = starts.where("start > 0").select(F.col("conv_id").alias("c"), "window")
    return systems.select("id", "conv_id", "place").join(later, F.col("conv_id").eqNullSafe(F.col("c"))).select("id", "conv_id", "window", "place", F.lit(False).alias("own"))


def _format(rows: DataFrame) -> DataFrame:
    """Turns of each window, in order, to its text and loss spans."""
    part = F.struct("place", "own", "role", "body")
    windows = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    ends = F.aggregate("parts", F.array(F.lit(len(HEAD))), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(x["body"]))))
    windows = windows.withColumn("ends", ends)
    spans = F.filter(F.transform("parts", lambda x, i: F.struct((x["own"] & (x["role"] == ROLE_TARGET)).alias("target"), (F.element_at("ends", i + 1) + len(OPEN) + len(ROLE_TARGET) + len(CLOSE)).cast("long").alias("start"), F.element_at("ends", i + 2).cast("long").alias("end"))), lambda x: x["target"])
    return windows.select(
        "conv_id", "window", F.size("parts").cast("long").alias("n_turns"), F.size(F.filter("parts", lambda x: ~x["own"])).cast("long").alias("n_repeated"),
        F.concat(F.lit(HEAD), F.array_join(F.transform("parts", lambda x: x["body"]), ""), F.lit(TAIL)).alias("text"), F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss"),
    )


def _openings(text: str) -> list[int]:
    """Ends of the signs that open a turn: those with an even number of escape signs in front."""
    out, at = [], text.find(OPEN)
    while at >= 0:
        k = at
        while k and text[k - 1] == "\\":
            k -= 1
        if (at - k) % 2 == 0:
            out.append(at + len(OPEN))
        at = text.find(OPEN, at + 1)
    return out


def parse_window(text: str) -> list[tuple[str, str]]:
    """Roles and texts, unescaped, of a formatted window."""
    inside = text.removeprefix(HEAD).removesuffix(TAIL)
    starts = _openings(inside)
    stops = [s - len(OPEN) for s in starts[1:]] + [len(inside)]
    turns = [inside[i:j].split(CLOSE, 1) for i, j in zip(starts, stops, strict=True)]  # in a role the sign parts blank and bracket
    return [(unescape(role), unescape(body)) for role, body in turns]


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations from their windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Windows arrive sorted and are hashed one after another, so a task holds one window at a time.
    """

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list[tuple] = []
        now: list = []

        def close():
            if now:
                done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            for row in batch.to_pylist():
                if not now or now[0] != row["conv_id"]:
                    close()
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["text"]
                for role, body in parse_window(text)[row["n_repeated"] :]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode("utf-8", "replace"))
                for span in row["loss"]:
                    target = unescape(text[span["start"] : span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode("utf-8", "replace"))
                now[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)

    dealt = windows.select("conv_id", "window", "n_repeated", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
