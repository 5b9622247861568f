"""The pipeline's stages and run() against plain Python, each on its own input."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from parlance.llm import mixing, secrets
from parlance.llm.queries import vocabulary
from test_similar import groups
from tokenizers import Tokenizer


def stages(spark, docs, sf, path):
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"file://{path}/{k}")
        seen.append(spark.read.parquet(f"file://{path}/{k}"))
    return seen


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def redact(text, spans):
    out, at = "", 0
    for s, e in spans:
        if e > at:
            if s >= at:
                out += text[at:s] + "[REDACTED]"
            at = e
    return out + text[at:]


def verify(seen, clean_share):
    docs, told, unique, safe, mixed, packed = ([r.asDict() for r in x.collect()] for x in seen)
    assert all(x.columns == seen[0].columns for x in seen[1:5])
    text = {r["doc_id"]: r["text"] for r in docs}
    assert {r["doc_id"] for r in told} <= set(text) and all(r["text"] == text[r["doc_id"]] and any(c.isalpha() for c in r["text"]) for r in told)
    assert len(told) >= clean_share * len(docs)

    component = groups([(r["doc_id"], r["text"]) for r in told])  # five-word shingles, similarity 0.8
    assert sorted(r["doc_id"] for r in unique) == sorted(set(component.values()))

    spans = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x] for r in secrets.secret_scan(seen[2]).collect()}
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in safe) == sorted((r["doc_id"], t := redact(r["text"], spans[r["doc_id"]]), len(t) if spans[r["doc_id"]] else r["n_chars"]) for r in unique)

    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(seen[3]).collect()}
    copies = Counter(r["doc_id"] for r in mixed)
    for r in safe:
        t, n = taken[r["doc_id"]]
        assert n == words(r["text"]) and abs(copies.get(r["doc_id"], 0) - (t / n if n else 1)) <= 0.5

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0] for r in safe}
    pieces = Counter()
    for r in packed:
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and len(own) == r["doc_tokens"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]] += r["length"]
    assert pieces == Counter({i: n * len(ids[i]) for i, n in copies.items()})
    room = Counter()
    for r in packed:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values(), default=0) <= 1024


def test_stages(spark, documents, sf, tmp_path):
    verify(stages(spark, documents, sf, tmp_path), 0.97)


def test_run_is_its_stages(spark, documents, sf, tmp_path):
    key = lambda df: sorted(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(stages(spark, documents, sf, tmp_path)[-1])


def test_edges_and_extra_columns(spark, edge, sf, tmp_path):
    seen = stages(spark, edge, sf, tmp_path)
    kept = [r["doc_id"] for r in seen[1].collect()]
    assert not {1, 2, 3, 11} & set(kept) and {4, 5, 6, 7, 9, 12} <= set(kept)
    unique = [r["doc_id"] for r in seen[2].collect()]
    assert 4 in unique and not {5, 6} & set(unique) and unique.count(7) == 1 and unique.count(None) == kept.count(None)
    assert seen[3].count() == seen[2].count()
    assert {r["doc_id"] for r in seen[5].collect()} == {r["doc_id"] for r in seen[4].collect()}


def test_empty(spark, empty, sf, tmp_path):
    assert [x.count() for x in stages(spark, empty, sf, tmp_path)] == [0] * 6


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "source_mix", "sequence_packing"]
    assert corpus_pipeline.ORACLE_SQL is None
