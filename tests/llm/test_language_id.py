import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from parlance.llm import langid


def naive(counts: Counter, order: int, alphabet: int):
    """Interpolated Kneser-Ney in dictionaries: a function from word to log probability."""
    raw, first = [Counter() for _ in range(order + 1)], set()
    for w, c in counts.items():
        s = f" {w} "
        for i in range(1, len(s)):
            for n in range(1, min(order, i + 1) + 1):
                raw[n][s[i - n + 1 : i + 1]] += c
                if i == n - 1:
                    first.add(s[i - n + 1 : i + 1])
    table, back, discounts = {}, {}, {}
    for n in range(1, order + 1):
        before = defaultdict(set)
        if n < order:
            for g in raw[n + 1]:
                before[g[1:]].add(g[0])
        a = {g: (c if n == order or (n > 1 and g in first) else max(1, len(before[g]))) for g, c in raw[n].items()}
        ones, twos = sum(x == 1 for x in a.values()), sum(x == 2 for x in a.values())
        d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        total, types = Counter(), Counter()
        for g, x in a.items():
            total[g[:-1]] += x
            types[g[:-1]] += 1
        back |= {(n, c): d * types[c] / total[c] for c in total}
        for g, x in a.items():
            lower = table[g[1:]] if n > 1 else 1 / alphabet
            table[g] = max(x - d, 0) / total[g[:-1]] + back[(n, g[:-1])] * lower
        discounts[n] = d

    def p(s: str, i: int, n: int) -> float:
        if n == 0:
            return back[(1, "")] / alphabet
        g = s[i - n + 1 : i + 1]
        if g in table:
            return table[g]
        return (back.get((n, g[:-1]), 1.0) if n > 1 else 1.0) * p(s, i, n - 1)

    return lambda w: sum(math.log(p(f" {w} ", i, min(order, i + 1))) for i in range(1, len(w) + 2))


def test_scores_are_those_of_a_dictionary_model():
    counts = Counter({"the": 9, "then": 3, "them": 2, "a": 5, "at": 4, "hat": 2, "tea": 1, "eat": 1, "theme": 1})
    p = langid.Params()
    model = langid.Model(["x"], [langid.fit_language(counts, p)], p)
    words = ["the", "then", "that", "a", "zebra", "heath", "ététhe", "eat"]
    expected = naive(counts, p.order, p.alphabet)
    assert np.allclose(model.score_words(words)[:, 0], [expected(w) for w in words], rtol=1e-4)


def test_a_word_is_one_outcome_among_many():
    counts = Counter({"ab": 3, "ba": 2, "aab": 1})
    p = langid.Params()
    model = langid.Model(["x"], [langid.fit_language(counts, p)], p)
    seen = [w for n in range(1, 7) for w in map("".join, __import__("itertools").product("ab", repeat=n))]
    assert 0.5 < np.exp(model.score_words(seen)[:, 0]).sum() <= 1.0001


def test_held_out_accuracy(spark, documents):
    got = langid.language_id(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_held_out_rows_teach_nothing(spark, documents):
    from pyspark.sql import functions as F

    other = documents.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    assert langid.language_id(other).orderBy("doc_id").collect() == langid.language_id(documents).orderBy("doc_id").collect()


def test_edges(edge, empty):
    got = langid.language_id(edge)
    rows = got.toPandas()
    assert len(rows) == edge.count()
    by = dict(zip(rows.doc_id, rows.lang_pred, strict=True))
    assert by[1] == by[2] == by[3] == by[11] == "und" and by[4] in ("en", "fr")
    assert langid.language_id(empty).count() == 0
    kept = langid.accepted_only(edge)
    assert kept.columns == edge.columns and set(kept.toPandas().lang_pred) <= {"x"}
    assert langid.accepted_only(empty).count() == 0


def test_rejects_another_script(spark, documents):
    foreign = spark.createDataFrame([(10**9, "漢字仮名交文 " * 40)], "doc_id long, text string")
    model = langid.train(documents)
    row = langid.predict(foreign, model).first()
    assert not row["accepted"]
    clean = langid.predict(documents, model).where("not accepted").count()
    assert clean <= documents.count() * 0.01


@pytest.mark.parametrize("text", ["²²²² ² ² ² ²", "12 34 56 78 90", "_ _ _ _ _"])
def test_no_letter(text):
    assert not langid.has_letter(text)
    p = langid.Params()
    model = langid.Model(["x"], [langid.fit_language(Counter({"the": 2, "a": 1}), p)], p)
    assert langid.Scorer(model).texts([text]) == [None]
