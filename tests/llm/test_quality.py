import re
from collections import Counter

import pytest
from parlance.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, c in Counter(windows).items() if c > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 8)}
    n, k = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), k, n < 20 or 100 * k > 30 * n


@pytest.fixture(scope="module", params=["documents", "edge"])
def table(request):
    return request.getfixturevalue(request.param)


def test_measures(table):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    got = sorted((tuple(r)[:7] for r in quality.quality_rules(table).collect()), key=key)
    assert got == sorted(((r["doc_id"], *brute(r["text"])) for r in table.collect()), key=key)


def test_overlapping_repeats(spark):
    a = "a b c d e f g h i j k l"
    texts = [f"{a} {a}", "x " * 30, f"{a} q {a} r {a}", "a b c d e f g h " * 3 + "tail", " ".join(map(str, range(100)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r)[:7] for r in quality.quality_rules(docs).collect()) == [(i, *brute(t)) for i, t in enumerate(texts)]


def test_verdict(documents, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    rows = quality.quality_rules(documents).join(labels, "doc_id").toPandas()
    assert not (rows.kept & rows.base_failed).any()
    fair = rows[~rows.base_failed]
    assert (fair[fair.label == 1].kept).mean() > 0.99
    assert (fair[fair.label == 0].kept).mean() < 0.2


def test_estimate_recovers_known_rules():
    import itertools

    good, share = [(0.05, 0.15, 0.8), (0.02, 0.28, 0.7), (0.1, 0.1, 0.8), (0.05, 0.05, 0.9)], 0.8
    bad = [(0.8, 0.1, 0.1), (0.7, 0.2, 0.1), (0.6, 0.2, 0.2), (0.7, 0.1, 0.2)]
    patterns = {}
    for votes in itertools.product((-1, 0, 1), repeat=4):
        p = share
        q = 1 - share
        for v, g, b in zip(votes, good, bad, strict=True):
            p, q = p * g[v + 1], q * b[v + 1]
        patterns[votes] = round(1_000_000 * (p + q))
    got, shares = quality.estimate(patterns, 300, prior=1e-5)
    assert abs(got - share) < 0.02
    for (g, b), eg, eb in zip(shares, good, bad, strict=True):
        assert all(abs(x - y) < 0.02 for x, y in zip((*g, *b), (*eg, *eb), strict=True))


def test_empty(empty):
    assert quality.quality_rules(empty).count() == 0


def test_no_python_in_the_plan(documents):
    plan = quality.quality_rules(documents)._jdf.queryExecution().toString() + quality.measures(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
