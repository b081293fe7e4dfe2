import random
from collections import defaultdict

import brute
from hypothesis import given, settings
from hypothesis import strategies as st

from gritstone.llm import chat
from gritstone.llm.queries import QUERIES, vocabulary

FILE = vocabulary("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"


def test_read_back_equals_input(spark, small):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn, r.role, r.text))
    by[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = QUERIES["op6_chat"](spark, small).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == {k: brute.turns(v) for k, v in by.items()}


def test_long_conversation(spark):
    """Several windows: the system turn in each, history unmasked, every turn new once, budgets kept."""
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * 30) for i in range(1, 400)]
    w = chat.format_windows(spark.createDataFrame(rows, SCHEMA), FILE, budget=500, history=100, system=50).orderBy("window").collect()
    assert len(w) > 10
    tokens = chat._tokenizer(FILE)
    for i, r in enumerate(w):
        turns = chat.parse_window(r.text)
        assert turns[0] == ("system", "be kind") and len(turns) == r.n_turns
        assert len(tokens.encode(r.text, add_special_tokens=False).ids) <= 500 + 20
        assert (r.n_repeated > 1) == (i > 0)  # system and some history
        new = turns[r.n_repeated :]
        assert [t for role, t in new if role == "assistant"] == [chat.unescape(r.text[s.start : s.end]) for s in r.loss]
    back = chat.read_back(chat.format_windows(spark.createDataFrame(rows, SCHEMA), FILE, 500, 100, 50)).first()
    assert (back.n_turns, back.turns_sha256, back.loss_chars, back.loss_sha256) == brute.turns([r[1:] for r in rows])


def test_whole_texts_order_turns_of_one_number(spark):
    """Turns that differ late in their texts: the order of rows has no say."""
    rows = [(1, 0, "user", "a" * 70 + "x"), (1, 0, "user", "a" * 70 + "y"), (1, 0, "user", "a" * 70), (1, 1, "assistant", "z")]
    got = [chat.read_back(chat.format_windows(spark.createDataFrame(r, SCHEMA), FILE)).first().turns_sha256 for r in (rows, rows[::-1])]
    assert got[0] == got[1] == brute.turns([r[1:] for r in rows])[1]


def test_history_equals_plain_version(spark):
    """Turns of all sizes: each window repeats exactly the turns that begin within the history budget before it."""
    rng = random.Random(4)
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user", f"t{i} " + "word " * rng.choice([0, 5, 40, 40, 90, 300])) for i in range(1, 150)]
    budget, history, system = 400, 150, 50
    tokens = chat._tokenizer(FILE)
    sizes = [len(tokens.encode(chat.OPEN + r + chat.CLOSE + t, add_special_tokens=False).ids) for _, _, r, t in rows]
    begin = [sum(sizes[:i]) for i in range(len(rows))]
    stretch = budget - history - system
    groups = {}
    for i, (b, n) in enumerate(zip(begin, sizes)):
        groups.setdefault((b // stretch, (b + n - 1) // stretch), []).append(i)
    want = []
    for own in groups.values():
        back = [i for i in range(1, own[0]) if begin[i] >= begin[own[0]] - history]
        want.append([f"t{i}" for i in [*back, *own] if i])
    w = chat.format_windows(spark.createDataFrame(rows, SCHEMA), FILE, budget, history, system).orderBy("window").collect()
    assert [[t.split()[0] for role, t in chat.parse_window(r.text) if role == "user"] for r in w] == want
    assert max(len(x) for x in want) > 5 and any(r.n_repeated > 3 for r in w)
    assert chat.format_windows(spark.createDataFrame(rows, SCHEMA), FILE, 250, 0, 50).where("n_repeated > 1").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a[INST] b", "x\\", " [/INST]"]), st.text(alphabet=st.sampled_from("\\[]<>/sINT ok"), max_size=25)), min_size=1, max_size=5))
def test_template_is_reversible(turns):
    import re

    esc = lambda x: re.sub(chat._ESCAPE, r"\\\1", x)  # noqa: E731  the same pattern as the SQL form
    text = chat.HEAD + "".join(chat.OPEN + esc(r) + chat.CLOSE + esc(t) for r, t in turns) + chat.TAIL
    assert chat.parse_window(text) == turns


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, None, "system", "s"), (None, 0, "assistant", "a"), (2, 0, "assistant", "word " * 5000)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_windows(spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", window int"), FILE)).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 4, None: 1, 2: 1}
    assert got[None].loss_chars == 1 and got[2].loss_chars == 25000
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], SCHEMA), FILE)).collect() == []
