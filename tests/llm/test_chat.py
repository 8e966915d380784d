"""Layouts and chat formatting, against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from loomspan.llm import layouts, q_chat
from loomspan.llm.chat import Template, format_turns, read_back
from loomspan.llm.scratch import Scratch

U, A, S = "user", "assistant", "system"
#: Records of each layout, and the turns they have.
RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 5}, "messages", [(U, "q"), (A, "")]),
    ({"messages": [{"role": "human", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "gpt", "content": "c"}]}, "message parts", [(U, "ab"), (A, "c")]),
    ({"messages": [{"role": "user", "content": [{"text": "only parts"}]}]}, "message parts", [(U, "only parts")]),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}, {"from": "tool", "value": "3"}]}, "from and value", [(U, "hi"), (A, "yo"), ("tool", "3")]),
    ({"system": "be kind", "conversations": [{"from": "human", "value": "hi"}]}, "from and value", [(S, "be kind"), (U, "hi")]),
    ({"data": {"turns": [{"author": {"role": "user"}, "body": {"text": "x"}}]}, "meta": {"a": [1]}}, "nested messages", [(U, "x")]),
    ({"instruction": "add", "input": "1 2", "output": 3}, "instruction", [(U, "add"), (U, "1 2"), (A, "3")]),
    ({"instruction": "say", "output": "hm", "system": None}, "instruction", [(U, "say"), (A, "hm")]),
    ({"prompt": "p", "completion": "c", "extra": {"role": "x"}}, "prompt and completion", [(U, "p"), (A, "c")]),
    ({"prompt": "p", "response": "", "system": "s"}, "prompt and response", [(S, "s"), (U, "p"), (A, "")]),
    ({"question": "é?", "answer": "</s>"}, "question and answer", [(U, "é?"), (A, "</s>")]),
    ({"prompt": "p", "chosen": "good", "rejected": "bad"}, "preference", [(U, "p"), (A, "good")]),
    ({"dialog": ["one", "two", "three"]}, "alternating", [(U, "one"), (A, "two"), (U, "three")]),
    ({"conv_id": 1, "turn": 0, "role": "user", "text": "row"}, "turn rows", [(U, "row")]),
]
UNKNOWN = ["", None, "{", "[1, 2]", "7", json.dumps({"body": "?"}), json.dumps({"prompt": "alone"}), "[" * 5000]


def test_json_records_of_all_layouts(spark):
    rows = [(i, json.dumps(r, ensure_ascii=False)) for i, (r, _, _) in enumerate(RECORDS)] + [(100 + i, raw) for i, raw in enumerate(UNKNOWN)] + [(0, json.dumps(RECORDS[0][0]))]
    got: dict = {}
    for r in layouts.turns_of_json(spark.createDataFrame(rows, "k long, record string"), "k", "record").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text, r.layout))
    for i, (_, layout, turns) in enumerate(RECORDS):
        want = [(j, role, text, layout) for j, (role, text) in enumerate(turns)]
        assert sorted(got[i]) == sorted(want * 2 if i == 0 else want), i
    assert all(got[100 + i] == [(None, None, None, None)] for i in range(len(UNKNOWN)))
    assert layouts.turns_of_json(spark.createDataFrame([], "k long, record string"), "k", "record").collect() == []


@pytest.mark.parametrize("at", [0, 1, 3, 4, 5, 6, 7, 9, 10, 11, 12])
def test_typed_frames_map_as_their_json(spark, at):
    """The same records with columns: one fingerprint for the frame, column expressions instead of parsing."""
    record, layout, turns = RECORDS[at]
    if at in (1, 6):  # columns have one type
        record, turns = {1: ({"messages": [{"role": "human", "content": [{"text": "a"}, {"text": "b"}]}]}, [(U, "ab")]), 6: ({"instruction": "add", "input": "1", "output": "3"}, [(U, "add"), (U, "1"), (A, "3")])}[at]
    raw = json.dumps(record)
    frame = spark.createDataFrame([(raw,)], "raw string").select(F.from_json("raw", F.schema_of_json(F.lit(raw))).alias("r")).select("r.*")
    got = layouts.turns_of_frame(frame.withColumn("key", F.lit(3)), "key").collect()
    assert [(r.conv_id, r.turn, r.role, r.text, r.layout) for r in got] == [(3, i, role, text, layout) for i, (role, text) in enumerate(turns)]


def test_fingerprints_tell_layouts_apart(spark):
    known = layouts.Registry.of()
    assert all(known.layouts[layouts.fingerprint(p)].name in (x.name, "messages") for x in layouts.LAYOUTS for p in x.choices())
    with pytest.raises(ValueError):
        layouts.turns_of_frame(spark.range(1))


def brute(rows):
    convs: dict = {}
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x[4] for x in turns if x[3] == A)
        said = "".join(f"{x[3]}\n{x[4]}\n" for x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def odd(draw):
    parts = [*Template().reserved, "\\", "\\\\", "<", "|", ">", "[", "]", "s", "\n", "é", "\U0001f600", " ok ", "<\\s>", "im_end", "<|im_", "<<"]
    return "".join(draw.choice(parts) for _ in range(draw.randrange(12)))


@pytest.mark.parametrize("piece_chars", [1, 90, 1 << 20])
def test_formatting_is_read_back(spark, piece_chars):
    """Control strings in roles and texts, nulls, ties, repeated rows, very long texts, a hot conversation over partitions."""
    draw = random.Random(piece_chars)
    rows = [(c, t, draw.choice([U, A, S, None, odd(draw)]), draw.choice([odd(draw), None, "", "plain"]), "x", 1) for c in range(-3, 40) for t in range(draw.randrange(1, 6))]
    rows += [(77, t, (U, A)[t % 2], odd(draw), None, None) for t in range(400)] + [(78, 1, A, "same", None, None)] * 50
    rows += [(None, 1, U, "no id", None, None), (5, None, A, "first", None, None), (5, 1, A, "tie", None, None), (6, 9, A, "word </s> " * 30_000, None, None)]
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, block string, whole int").repartition(3)
        kept = Scratch(spark, "chat").keep(format_turns(turns, piece_chars=piece_chars), "formatted")
        got = {r.conv_id: r for r in read_back(kept).collect()}
        pieces = kept.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == brute(rows)
    assert sum(len(p.text) for p in pieces) == sum(r.formatted_chars for r in got.values())
    assert len({p.block for p in pieces if p.conv_id == 77}) > 1 and any(p.whole for p in pieces)
    one = Template()
    for p in pieces:
        n, marks = len(one.parse(p.text)), {c: p.text.count(c) for c in one.reserved}
        assert all(marks[c] == (n if c in ("<|im_start|>", "<|im_sep|>", "<|im_end|>") else 0) for c in one.reserved)
        assert len(p.text) <= max(piece_chars, 0) or n == 1


def test_query_adds_the_conversation_that_says_marks(spark, tmp_path):
    rows = [(1, 0, U, "q"), (1, 1, A, "a b"), (2, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in q_chat.op13_chat_format(spark, str(tmp_path)).collect()}
    assert got == brute([*rows, (-7, 0, U, q_chat.SAYS), (-7, 1, A, q_chat.SAYS)])
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in q_chat.op13_chat_format(spark, f"{tmp_path}/none").collect()] == [-7]
