import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from conftest import WORDS
from parlance.llm import _common, golay, similar, simhash
from test_simhash import components


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    return components([(i, j) for i, j in combinations(sorted(sets), 2) if alike(sets[i], sets[j])], sorted(sets))


def made():
    """A chain of 60 copies each three words from the last, 50 near copies of one text, pairs, strangers, short texts."""
    r = random.Random(8)
    text = lambda n: [f"{r.choice(WORDS)}{r.randrange(50)}" for _ in range(n)]
    rows, chain, star = [], text(300), text(200)
    for _ in range(60):
        chain = [f"x{r.randrange(10**6)}" if i in (a := set(r.sample(range(300), 3))) else w for i, w in enumerate(chain)]
        rows.append(chain)
    for _ in range(50):
        rows.append([*star[: (at := r.randrange(200))], f"y{r.randrange(10**6)}", *star[at + 1 :]])
    for _ in range(40):
        one = text(100)
        rows += [one, [*one[:50], "z", *one[51:]], text(100)]
    rows += [["one", "two"], ["One", "two"], [], []]
    r.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_groups_are_those_of_all_pairs(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs).collect()} == groups(rows)


def test_pipeline_drops_what_op3_keeps(spark, sf):
    docs = spark.createDataFrame(made(), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    assert kept == set(groups(made()).values()) and simhash.keep_one(docs).count() > len(kept)


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert {r["doc_id"]: r["component_id"] for r in similar.near_copies(documents).collect()} == groups(rows)


def test_edges(edge, empty):
    by = {}
    for r in (rows := similar.near_copies(edge).collect()):
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert len(rows) == edge.count() and similar.near_copies(empty).count() == 0
    assert by[1] == by[2] == by[3] == {1} and by[4] == by[5] == by[6] == {4} and by[7] == {7}


def test_values_are_majorities_of_bits():
    hashes = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 700, np.uint64))
    bits = [[int(w) >> b & 1 for w in row for b in range(64)] for row in similar._mixed(hashes)]
    found = similar.margins(hashes)
    assert found.tolist() == [2 * sum(c) - len(hashes) for c in zip(*bits, strict=True)]
    assert int.from_bytes(similar.value(found), "little") == sum(1 << i for i, m in enumerate(found) if m > 0)


def test_soft_keys_are_the_best_pairs_of_code_words():
    margins = np.random.default_rng(2).normal(size=(20, 2, golay.BITS)).astype(np.float32)
    for row, found in zip(margins, golay.soft_keys(margins, 6), strict=True):
        one, two = (m @ golay.code_words() for m in row)
        best = sorted(((one[i] + two[j], i << 12 | j) for i in np.argsort(-one)[:40] for j in np.argsort(-two)[:40]), reverse=True)[:6]
        assert found.tolist() == [k for _, k in best]
    for word in golay.code_words().T[[0, 5, 4095]]:  # sure of 16 bits of a code word, in doubt of seven wrong ones
        assert (golay.likeliest(np.where(np.arange(23) < 7, -0.1, 1) * word[None, :], 1)[0][0, 0] << 11 ^ sum(1 << i for i in range(23) if word[i] > 0)) < 1 << 11


@pytest.mark.parametrize(("shared", "a", "b"), [(4, 0, 1), (8, 1, 1), (16, 0, 4), (40, 5, 5), (80, 0, 20), (400, 50, 50)])
def test_pairs_at_the_limit_meet(shared, a, b):
    r, n = np.random.default_rng(shared), 1000
    sets = [r.integers(0, 1 << 63, shared + a + b, np.uint64) for _ in range(n)]
    x, y = (np.array([similar.margins(h) for h in part]) for part in ([h[: shared + a] for h in sets], [np.delete(h, np.s_[shared : shared + a]) for h in sets]))
    keys = [similar.table_keys(m).astype(np.int64) for m in (x, y)]
    met = [similar.first_shared(*k, shared + a, shared + b) >= 0 for k in zip(*keys, strict=True)]
    near = ((x > 0) != (y > 0)).sum(axis=1) <= similar.FAR
    assert np.mean(met & near) >= 0.996


def test_bucket_keys(spark, documents):
    rows = similar.signatures(documents.limit(50)).dropDuplicates(["s"]).cache()
    found = {}
    for r in similar.bucket_keys(rows).collect():
        found.setdefault(r["s"], set()).add(r["key"])
    sized = {r["s"]: (r["size"], r["keys"]) for r in rows.collect()}
    classes = lambda n: {n.bit_length(), (n * 5 // 4).bit_length()}
    assert found == {s: {c << 28 | k // similar.KEYS << 24 | code for c in classes(n) for k, code in enumerate(keys)} for s, (n, keys) in sized.items() if n >= similar.LEAST}


def test_the_stage_goes_through_golay_keys(spark, sf):
    first = len(_common.WRITTEN)
    docs = spark.createDataFrame(made()[:40], "doc_id long, text string")
    corpus_pipeline.drop_near_duplicates(spark, docs, sf).count()
    assert any("golay-buckets" in path for path in _common.WRITTEN[first:])


def test_a_stranger_meets_no_large_group(spark):
    r = np.random.default_rng(4)
    base = r.integers(0, 256, similar.WORDS * 8, np.uint8)
    group = [(1, s, 10, bytes(base ^ (np.arange(len(base)) == s % len(base)))) for s in range(100, 150)]
    near, far = (1, 5, 5, bytes(base)), (2, 6, 6, bytes(~base))
    rows = [*group, near, *((2, *x[1:]) for x in group), far]  # the strangers' ids are the least of their buckets
    sigs = spark.createDataFrame(sorted({(x[1], x[3]) for x in rows}), "s long, sig binary")
    members = spark.createDataFrame([x[:3] for x in rows], "key long, s long, part long")
    found = similar.in_reach(_common.materialise(similar.led_by_most(members, sigs), "led")).collect()
    assert sorted((x["key"], x["s"], x["led"]) for x in found) == [(1, 5, False), *((1, s, True) for s in range(100, 150)), (2, 6, False)]


def test_rows_of_a_group_grow_with_its_members(spark, monkeypatch):
    r, measured = random.Random(5), similar.measured
    base = [f"{r.choice(WORDS)}{r.randrange(50)}" for _ in range(150)]
    rows = [(i, " ".join(f"x{r.randrange(10**6)}" if k in at else w for k, w in enumerate(base))) for i in range(200) for at in [r.sample(range(150), r.randrange(1, 5))]]
    counts = []
    monkeypatch.setattr(similar, "measured", lambda pairs: counts.append(pairs.count()) or measured(pairs))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in similar.near_copies(docs).collect()} == groups(rows)
    assert sum(counts) <= 6 * len(rows), counts


def test_first_here_is_first_shared():
    r = np.random.default_rng(6)
    a, b = (r.integers(0, 90, (400, similar.TABLES * similar.KEYS)) for _ in range(2))
    sizes = r.integers(4, 40, (400, 2))
    first = [similar.first_shared(x, y, *n) for x, y, n in zip(a, b, sizes.tolist(), strict=True)]
    for key in {k for k in first if k >= 0} | {9 << 28}:
        assert similar.first_here(key, a, b, sizes.max(axis=1)).tolist() == [i for i, k in enumerate(first) if k == key]
