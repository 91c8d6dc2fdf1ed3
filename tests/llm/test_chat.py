"""Chat formatting: layouts by fingerprint, reversible escapes, mask."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from panelwise.llm import chat

ODD = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user", "\\", "<\\|", "a\\[INST]", "", "<", "\U0001f600 é\n\n", "x" * 50000]


def test_layouts(spark):
    rows = [
        ({"prompt": "a", "response": "b"}, "prompt", [("user", "a"), ("assistant", "b")]),
        ({"instruction": "s", "input": "u", "output": None}, "instruction", [("system", "s"), ("user", "u"), ("assistant", "")]),
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}, "messages", [("user", "q"), ("assistant", "r")]),
        ({"dialogue": [{"from": "user", "value": "q"}]}, "dialogue", [("user", "q")]),
        ({"data": {"turns": [{"speaker": "user", "utterance": "q"}]}}, "nested", [("user", "q")]),
        ({"prompt": "a"}, None, []), ({}, None, []),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(rows)] + [(7, "no json"), (8, None)], "conv_id long, record string")
    got = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical(df).collect()}
    assert got == {i: (name, turns) for i, (_, name, turns) in enumerate(rows)} | {7: (None, []), 8: (None, [])}


def test_round_trip_and_mask(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(ODD)]
    rows += [(2, 0, "user", None), (2, 0, "user", None), (3, None, None, "only"), (None, 1, "assistant", "x"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.formatted(chat.canonical(chat.records(df)))
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t"),
                                             chat.under_mask(F.col("formatted"), F.col("loss")).alias("m")).collect()}
    want = {1: [(r, t) for _, _, r, t in rows[:len(ODD)]], 2: [("user", "")] * 2, 3: [("", "only")], None: [("assistant", "x")],
            4: [("assistant", "a"), ("assistant", "b")]}
    assert {k: [tuple(t) for t in r.t] for k, r in got.items()} == want
    assert {k: r.m for k, r in got.items()} == {k: "".join(t for r, t in v if r == "assistant") for k, v in want.items()}
    body = got[1].formatted
    assert body.count("<|") == 2 * len(ODD) and "</s>" not in body and "[INST]" not in body


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(chat.canonical(chat.records(df)))).collect() == []
