import random
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.orc
import pytest
from parlance.llm import packing, token_counts, token_files
from parlance.llm.queries import vocabulary
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def encode(name, texts):
    return [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module", params=["documents", "edge"])
def table(request):
    return request.getfixturevalue(request.param)


def test_counts(table):
    rows = table.select("doc_id", "text").collect()
    got = token_counts.token_counts(table, vocabulary(WORD)).collect()
    expected = [(r["doc_id"], len((r["text"] or "").encode()), len(i), len(i) > 2048) for r, i in zip(rows, encode(WORD, [r["text"] for r in rows]), strict=True)]
    assert [tuple(r) for r in got] == expected


def test_counts_of_odd_texts():
    texts = ["aaaaaaaaaaaaaaaaaaaa", "<|endoftext|>x<|startoftext|>", "İstanbul ΣΑΣ ς ſ ﬁ", "été", "it's we'll I'M don't''s", "1234567890 a1b2", "​﻿\x00\x1f\x85", "漢字かな交じり文🙂👨‍👩‍👧", "à́̂" * 5, " \n\t ", "ß ẞ Ǆ ǅ", "<|ENDOFTEXT|>", "x" * 5000]
    assert token_counts.merger(vocabulary(WORD)).counts(texts) == [len(i) for i in encode(WORD, texts)]


def test_ids_of_odd_texts():
    from parlance.llm.bpe import encoder

    texts = ["<|endoftext|>x<|endoftext|><|endoftext|>", " a  b   c\n\n\td ", "it's we'll I'M", "  　x", "漢字🙂", "a" * 3000, " " * 3000, "\r\n\r\n", "ſ's ’s"]
    got = [np.frombuffer(encoder(vocabulary(BYTE)).ids(t), "<u4").tolist() for t in texts]
    assert got == encode(BYTE, texts)


def test_ids_of_long_white_space():
    from parlance.llm.bpe import encoder

    n = 1_200_000
    runs = [" " * n, "\n" * n, "\r\n" * (n // 2), "　\xa0" * 6000, "\x1c" * 12_000, " " * 9999, " " * 10_000, " " * 10_001]
    texts = [a + run + b for run in runs for a, b in (("", ""), ("ab", ""), ("ab's", "cd"), ("", "'s"), ("<|endoftext|>", "\x1cx"), ("a", "<|endoftext|> b"), ("1", "\n2"))]
    texts.append("a" + " " * n + "b" + "\n" * n + "c")
    got = [np.frombuffer(encoder(vocabulary(BYTE)).ids(t), "<u4").tolist() for t in texts]
    assert got == encode(BYTE, texts)


def test_ids_however_texts_are_grouped():
    """A cache of a few pieces, a long text between short ones, and a file whose special token may not be cut around."""
    import json

    from tokenizers import Tokenizer

    from parlance.llm.bpe import GROUP, ByteBpe

    r = random.Random(5)
    words = ["the", "cat.", "Dog's", "(x)", "é.a", "a1!b", "<|endoftext|>", "\n", " ", '"q"', "z" * 70]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (0, 1, 50, GROUP, 3, 200)]
    expected = [np.array(i, "<u4").tobytes() for i in encode(BYTE, texts)]
    for cap in (3, 400_000):
        coder = ByteBpe(vocabulary(BYTE), cap)
        assert list(coder.each(texts)) == list(coder.each(texts)) == expected
        assert len(coder._known) <= cap and max(map(len, coder._known)) <= 64
    assert list(coder.each([])) == []
    with open(vocabulary(BYTE), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["rstrip"] = True
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        json.dump(spec, f)
        f.flush()
        stripped = [e.ids for e in Tokenizer.from_file(f.name).encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in ByteBpe(f.name).each(texts)] == stripped


def test_files(spark, table, tmp_path):
    path = f"file://{tmp_path}/ids"
    got = [tuple(r) for r in token_files.token_files(table, vocabulary(BYTE), path).collect()]
    rows = table.select("doc_id", "text").collect()
    ids = [(r["doc_id"], [*i, 0]) for r, i in zip(rows, encode(BYTE, [r["text"] for r in rows]), strict=True)]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), crc(x[1])))
    expected, start = [], 0
    for i, x in ids:
        expected.append((i, start, len(x), crc(x)))
        start += len(x)
    assert sorted(got, key=lambda r: r[1]) == expected
    files = sorted(p for p in (tmp_path / "ids").iterdir() if p.suffix == ".orc")
    written = [x for f in files for x in pyarrow.orc.read_table(f)["doc_id"].to_pylist()]
    assert sorted(written, key=lambda i: (i is not None, i or 0)) == written
    some = next(i for i, _ in ids if i is not None)
    plan = token_files.read(spark, path).where(f"doc_id = {some}")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in plan


def test_packing(table):
    rows = table.select("doc_id", "text").collect()
    ids = defaultdict(list)
    for r, i in zip(rows, encode(BYTE, [r["text"] for r in rows]), strict=True):
        ids[r["doc_id"]].append([*i, 0])
    got = packing.pack_documents(table, vocabulary(BYTE)).collect()
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        same = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"] and crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]]
        assert same and r["length"] > 0
        seen[(r["doc_id"], r["doc_tokens"])].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (i, n), pieces in seen.items():
        copies = sum(len(x) == n for x in ids[i])
        assert sorted(p for s, k in pieces for p in range(s, s + k)) == sorted(list(range(n)) * copies)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 1024) * 1.05 + 2


def test_limits_in_every_dimension(spark):
    r = np.random.default_rng(4)
    rows = [(i, int(a), 1, int(b)) for i, (a, b) in enumerate(zip(r.integers(1, 900, 500), r.integers(0, 300, 500), strict=True))]
    items = spark.createDataFrame(rows, "id long, tokens long, segments long, loss long")
    limits = {"tokens": 1000, "segments": 5, "loss": 400}
    got = packing.pack(items, ["id"], limits, group_rows=100).toPandas()
    assert sorted(got.id) == list(range(500))
    sums = got.groupby("sequence_id")[list(limits)].sum()
    assert all((sums[k] <= v).all() for k, v in limits.items())
    assert len(sums) <= 1.25 * max(got.tokens.sum() / 1000, got.segments.sum() / 5, got.loss.sum() / 400)
    for _, group in got.sort_values("position").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *group.tokens.cumsum()[:-1]]
    with pytest.raises(Exception, match="larger than a bin"):
        packing.pack(items, ["id"], {"tokens": 10}, group_rows=100).collect()


def test_empty_tables(empty):
    assert token_counts.token_counts(empty, vocabulary(WORD)).count() == 0
    assert token_files.token_files(empty, vocabulary(BYTE)).count() == 0
    assert packing.pack_documents(empty, vocabulary(BYTE)).count() == 0


def odd_texts():
    r = random.Random(7)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    r.shuffle(points)
    marks = [" ", "\n", "\t", "a", "Z", "'", "'s", "'LL", "1", "²", "é", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "​", "　", "!", "…", "漢", "́", "Σ", "İ", "ß", "<|endoftext|>"]
    texts = ["".join(r.choice([*marks, r.choice(points)]) for _ in range(r.randint(1, 30))) for _ in range(8_000)]
    # every code point of all planes, next to a letter, a digit and white space
    return texts + [" ".join(points[i : i + 20]) + "a".join(points[i + 20 : i + 40]) + "'s 1 " + "  ".join(points[i : i + 40]) for i in range(0, len(points), 40)]


def test_fuzzed_texts_of_all_planes():
    from parlance.llm.bpe import encoder

    texts = odd_texts()
    assert [np.frombuffer(encoder(vocabulary(BYTE)).ids(t), "<u4").tolist() for t in texts] == encode(BYTE, texts)
    assert token_counts.merger(vocabulary(WORD)).counts(texts) == [len(i) for i in encode(WORD, texts)]


def test_long_words():
    from parlance.llm.bpe import encoder

    r = random.Random(3)
    texts = ["a" * 1_000_000, "ab" * 30_000, "!" * 300_000, "漢é" * 50_000, "".join(r.choice("etaoinshr") for _ in range(60_000)), "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF") for _ in range(300_000))]
    texts += [c * n for c in ("a", "e", "lo", "=") for n in range(250, 262)] + [" ".join(r.choice("etaoinshr") * r.randint(1, 900) for _ in range(300))]
    assert token_counts.merger(vocabulary(WORD)).counts(texts) == [len(i) for i in encode(WORD, texts)]
    assert [np.frombuffer(encoder(vocabulary(BYTE)).ids(t), "<u4").tolist() for t in texts] == encode(BYTE, texts)


def test_orc_has_what_it_promises(spark, tmp_path):
    """Opened with the format's own reader: run-length version 2, row indexes, Bloom filters; and rows that pruning saves."""
    docs = spark.range(12_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    path = f"file://{tmp_path}/ids"
    token_files.write(docs, vocabulary(BYTE), path, partitions=1)
    jvm = spark.sparkContext._jvm
    conf = spark._jsc.hadoopConfiguration()
    file = next(str(p) for p in (tmp_path / "ids").iterdir() if p.suffix == ".orc")
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{file}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getNumberOfRows() == 12_000 and reader.getRowIndexStride() == 2000 and reader.getCompressionKind().toString() == "ZSTD"
    rows, stripe = reader.rows(), reader.getStripes().get(0)
    kinds = [str(c.getKind()) for c in rows.readStripeFooter(stripe).getColumnsList()]
    assert kinds[1] == "DIRECT_V2" and kinds[3] in ("DIRECT_V2", "DICTIONARY_V2")  # doc_id, and the ids in their lists
    every = spark.sparkContext._gateway.new_array(jvm.boolean, 4)
    for i in range(4):
        every[i] = True
    index = rows.readRowIndex(0, None, every)
    assert index.getRowGroupIndex()[1].getEntryCount() == -(-min(12_000, stripe.getNumberOfRows()) // 2000)
    assert index.getBloomFilterIndex()[1] is not None and index.getBloomFilterIndex()[1].getBloomFilterCount() > 0
    rows.close()

    def rows_read(wanted: int) -> int:
        found = token_files.read(spark, path).where(f"doc_id = {wanted}")
        plan = found._jdf.queryExecution().executedPlan()
        found._jdf.queryExecution().toRdd().count()
        return plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    assert 1 <= rows_read(4444) <= 4000  # one row group, perhaps a second by a false positive
    assert rows_read(4445) <= 4000  # within the range of ids but absent: the Bloom filter drops its row group
