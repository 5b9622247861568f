"""Golden prefixes and packing, written by hand from the blueprint's format, and the path from a file to packed rows."""

import json

import pytest
from parlance import build
from parlance.config import SYSTEM_PROMPT, Config
from parlance.operators import examples, transcripts
from pyspark.sql import functions as F

TURNS = "array<struct<speaker:string,index:int,text:string>>"


def test_golden_prefixes(spark):
    turns = [("agent", 1, "hello"), ("customer", 2, "hi"), ("agent", 3, "how are you")]
    rows = spark.createDataFrame([("c", turns)], f"conversation_id string, turns {TURNS}")
    got = {r["target_turn_index"]: r for r in examples.examples(rows, 4, 1, 0.0, "S").collect()}
    head = "<|system|>S<|/system|>\n<|context|><|/context|>\n<|conversation|>\n"
    assert got[1]["prefix"] == head + "\n<|/conversation|>\n<|agent|>"
    assert got[3]["prefix"] == head + "<|agent|>hello\n<|customer|>hi\n<|/conversation|>\n<|agent|>"
    assert got[3]["full_text"] == got[3]["prefix"] + "how are you"
    empty = spark.range(1).select(examples.prompt("S", F.lit("C"), F.lit(""), blank_line_on_empty=False).alias("p")).first()["p"]
    assert empty == "<|system|>S<|/system|>\n<|context|>C<|/context|>\n<|conversation|>\n<|/conversation|>\n<|agent|>"


def test_truncation_follows_the_markers(spark):
    """Budgets by hand: head `<s> a <c>`, conversation of five words, tail `</c> <agent>`, target of one and its end."""
    prefix = "<|system|>a<|conversation|>b1 b2 b3 b4 b5<|/conversation|><|agent|>"
    open_one = "<|system|>a<|conversation|>b1 b2 b3 b4 b5<|agent|>"
    rows = spark.createDataFrame([(prefix, "t"), (open_one, "t")], "prefix string, target string")

    def kinds(limit):
        return [(r["trunc_kind"], r["n_real"]) for r in examples.pack(rows, limit).collect()]

    assert kinds(12) == [("none", 12), ("none", 11)]
    assert kinds(11) == [("conv", 11), ("none", 11)]
    assert kinds(10) == [("conv", 10), ("head", 10)]  # without an end marker the oldest tokens of all go
    assert kinds(7) == [("conv", 7), ("head", 7)]
    assert kinds(6) == [("head", 6), ("head", 6)]


def test_unknown_roles_raise(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "tool", "b")], "conv_id long, turn int, role string, text string")
    with pytest.raises(Exception, match="unknown speaker: tool"):
        transcripts.from_messages(rows).collect()
    null = spark.createDataFrame([(1, 0, None, "a")], "conv_id long, turn int, role string, text string")
    with pytest.raises(Exception, match="unknown speaker"):
        transcripts.from_messages(null).collect()
    good = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "assistant", "b\nc"), (1, 2, "user", " d ")], "conv_id long, turn int, role string, text string")
    assert [tuple(r) for r in transcripts.from_messages(good).orderBy("pos").collect()] == [(1, 0, "agent", "b c"), (1, 1, "customer", "d")]


def test_from_a_file(spark, tmp_path):
    text = "\n".join(f"{'agent' if i % 2 else 'customer'}(u{i}): " + " ".join(["word"] * 16) for i in range(1, 7))
    lines = [{"conversation_id": "a", "label": 1, "transcript": text}, {"conversation_id": "b", "label": 0, "transcript": text}, {"conversation_id": "c", "label": 1, "transcript": "agent(u1): hi"}]
    (tmp_path / "raw.json").write_text("\n".join(map(json.dumps, lines)))
    build.main(["--data-file", f"file://{tmp_path}/raw.json", "--output-dir", f"file://{tmp_path}/out", "--max-seq-len", "64"])
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert [(r["conversation_id"], r["target_turn_index"]) for r in sorted(rows, key=lambda r: r["target_turn_index"])] == [("a", 1), ("a", 3), ("a", 5)]
    assert all(len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"]) == 64 for r in rows)
    assert SYSTEM_PROMPT == Config().system_prompt
    (tmp_path / "none.json").write_text("")
    with pytest.raises(ValueError, match="no rows"):
        build.packed(spark, f"file://{tmp_path}/none.json")
