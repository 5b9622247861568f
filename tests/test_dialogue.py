import json
import os

from parlance.streaming import dialogue

ROWS = [("a", 1, "hi"), ("a", 2, " more "), ("a", 3, " QUIT "), ("a", 4, "late"), ("b", 1, "quit"), ("c", 1, "x"), ("c", 2, "y")]
EXPECTED = {("a", 1, "hi"), ("a", 2, "more"), ("c", 1, "x"), ("c", 2, "y")}


def test_replay(spark):
    assert {tuple(r) for r in dialogue.replay(spark.createDataFrame(ROWS, "session string, seq long, text string")).collect()} == EXPECTED


def test_stream_over_several_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("session string, seq long, text string").option("maxFilesPerTrigger", 1).json(f"file://{source}")
    for i, seqs in enumerate(([1], [2], [3], [4])):
        part = source / f"{i}.json"
        part.write_text("\n".join(json.dumps({"session": s, "seq": n, "text": t}) for s, n, t in ROWS if n in seqs))
        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by their times
    q = dialogue.stream(stream).writeStream.format("memory").queryName("dialogues").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/check").start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.sql("select * from dialogues").collect()} == EXPECTED
    finally:
        q.stop()
