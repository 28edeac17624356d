"""Chat formatting (operator 11): exact round trips, brute force over odd conversations, conversations over many blocks and tasks."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafpress.llm import bpe, chat

PIECES = ["\\", "\\\\", "### ", "### User: ", "### Assistant: ", "### Role: ", "</turn>", "</role>", "</", "turn>", "x", " ", "\n", "é", "🎉", "#", "<"]
texts = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "\\", "</role>"]), texts), max_size=4))
def test_escaping_is_reversible(turns):
    heads = lambda r: chat.HEADS.get(r) or chat.OTHER + chat.escape(r) + chat.NAME_END
    formatted = "".join(heads(r) + chat.escape(t) + chat.TURN_END for r, t in turns)
    assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)
    assert chat.parse(formatted) == turns


def test_long_runs_of_backslashes_take_linear_time():
    long = "\\" * 2_000_000 + "x" + "\\" * 2_000_000
    assert chat.unescape(chat.escape(long)) == long


def test_reserved_ids_and_mask():
    c = bpe.codec()
    ids, lo, hi = chat.segments(c, "assistant", chat.HOSTILE)
    assert ids[0] == len(c.bytes_of) + 2 and ids[-1] == len(c.bytes_of) + 5 and max(ids[1:-1]) < len(c.bytes_of)
    assert chat.unescape(c.decode(ids[lo:hi]).decode()) == chat.HOSTILE
    assert chat.loss_mask([1, 5], [3, 6], 8).tolist() == [False, True, True, False, False, True, False, False]


def expected(rows):
    """The query's digests by definition."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode())
    for conv in {r[0] for r in rows}:
        turns = [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == conv), key=key)]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        shown = "".join((chat.HEADS.get(r) or chat.OTHER + chat.escape(r) + chat.NAME_END) + chat.escape(t) + chat.TURN_END for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(shown))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    say = lambda: rng.choice([None, "", "".join(rng.choices(PIECES, k=rng.randrange(12)))])
    out = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", "tool", None, ""]), say()) for _ in range(150)]
    out += [(9, k // 2, "assistant" if k % 2 else "user", f"turn {k} " + "word " * (k % 7)) for k in range(400)]  # a hot conversation
    out += [(9, 1, "user", "turn 2 word word "), (8, 0, "assistant", "long \\" * 60_000)]
    return out


@pytest.mark.parametrize("block_rows", [1, 7, 1024])
def test_equals_brute_force(spark, rows, block_rows):
    # repartition() spreads the rows so that the ranges, and the conversations in them, cross tasks.
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    made = chat.format_conversations(df, block_rows=block_rows)
    got = {r.conv: tuple(r)[1:] for r in chat.digests(made).select("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    assert got == expected(rows)
    c = bpe.codec()
    for conv in (9, None):
        turns = made.where(F.col("conv").eqNullSafe(F.lit(conv))).orderBy("turn_no").collect()
        assert [r.turn_no for r in turns] == list(range(len(turns)))
        ids = [i for r in turns for i in r.ids]
        assert [r.start for r in turns] == [sum(len(x.ids) for x in turns[:k]) for k in range(0, len(turns))]
        mask = chat.loss_mask([r.loss_from for r in turns if r.loss_from is not None], [r.loss_to for r in turns if r.loss_to is not None], len(ids))
        learnt = c.decode([i for i, m in zip(ids, mask) if m])
        plain = [x for x in rows if x[0] == conv and x[2] == "assistant"]
        assert len(learnt) == sum(len(chat.escape(x[3] or "").encode()) for x in plain)


def test_a_hot_conversation_lies_in_several_tasks(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = chat.format_conversations(df)
        assert made.where("conv = 9").select(F.shiftright("block", 33)).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_clashing_names_and_empty_tables(spark):
    names = ["conv", "block", "turn_no", "start", "ids", "loss", "chars", "part", "pos", "rows", "_turns", "_more"]
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string").select("*", *(F.lit("x").alias(c) for c in names))
    assert chat.digests(chat.format_conversations(df)).count() == 1
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0


def test_query_on_a_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected([*rows, (-7, 0, "user", chat.HOSTILE), (-7, 1, "assistant", chat.HOSTILE)])
    got = {r.conv_id: tuple(r)[1:] for r in chat.op11_chat_format(spark, sf).collect()}
    assert got == want
