import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from parlance.llm import golay, simhash
from parlance.llm.components import connected_components


def brute_fingerprint(text, n=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def brute(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    pairs = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    least = components(pairs, sorted(fps))
    return {(i, f"{fps[i]:016x}", least[i]) for i in fps}


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {tuple(r) for r in simhash.near_duplicates(documents).collect()}
    assert got == brute(rows)


def test_chains_and_crowds(spark):
    """Fingerprints made by hand: chains, cliques in one bucket, and strangers."""
    r = random.Random(5)
    fps = []
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(6):
            fps.append(f)
            for b in r.sample(range(64), r.choice([1, 2, 2, 3])):
                f ^= 1 << b
    base = r.getrandbits(64)
    fps += [base ^ 1 << a ^ 1 << b for a, b in combinations(range(12), 2)] + [r.getrandbits(64) for _ in range(200)]
    signed = sorted({int(np.uint64(f).astype(np.int64)) for f in fps})
    pairs = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    parts = {x["node"]: x["component"] for x in connected_components(links).collect()}
    expected = components(pairs, signed)
    sizes = {}
    for root in expected.values():
        sizes[root] = sizes.get(root, 0) + 1
    assert parts == {f: root for f, root in expected.items() if sizes[root] > 1}


def test_golay_keys_meet_at_two_errors():
    r = np.random.default_rng(1)
    for _ in range(300):
        u = int(r.integers(0, 1 << 23))
        v = u
        for b in r.choice(23, 2, replace=False):
            v ^= 1 << int(b)
        one, two = (set(golay.keys(np.array([x]))[1].tolist()) for x in (u, v))
        assert one & two and max(len(one), len(two)) <= 6


@pytest.mark.parametrize("flips", [(), (3,), (0, 63), (21, 22), (42, 43), (22, 30)])
def test_fuzzy_keys(flips):
    r = random.Random(9)
    for _ in range(50):
        a = r.getrandbits(64)
        b = a
        for x in flips:
            b ^= 1 << x
        _, ka = golay.fuzzy_keys(np.array([a], np.uint64).view(np.int64))
        _, kb = golay.fuzzy_keys(np.array([b], np.uint64).view(np.int64))
        assert set(ka.tolist()) & set(kb.tolist())


def test_edges(edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["fingerprint"] for r in by[1] + by[2] + by[3]] == ["0" * 16] * 3
    assert {r["component_id"] for i in (1, 2, 3, None) for r in by[i] if r["fingerprint"] == "0" * 16} == {1}
    assert by[4][0]["component_id"] == by[5][0]["component_id"] == by[6][0]["component_id"] == 4
    assert len(by[7]) == 2 and {r["component_id"] for r in by[7]} == {7}
    for r in edge.select("text").collect():
        assert simhash.fingerprint(r["text"]) == brute_fingerprint(r["text"])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(edge)
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert kept.columns == edge.columns and ids == sorted({r["component_id"] for r in rows if r["doc_id"] is not None and r["doc_id"] == r["component_id"]})


def test_components(spark):
    r = random.Random(2)
    edges = [(a, r.randrange(max(0, a - 3), a + 1)) for a in range(1, 200) if a % 23] + [(300 + i, 300) for i in range(50)] + [(i, i + 1) for i in range(400, 460)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {k: v for k, v in components(edges, sorted({x for e in edges for x in e})).items() if k in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
