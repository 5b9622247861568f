import re
from collections import Counter, defaultdict

import duckdb
import pytest
from parlance.llm import mixing


def filled(sizes, weights, share, cap):
    """Targets by repeated resharing of the excess."""
    target, free, left = {}, set(sizes), share * sum(sizes.values())
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: weights[s] * level for s in free}
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return target


def check(docs, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in docs:
        sizes[r["source"]] += size(r["text"])
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    target = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    assert Counter((r["doc_id"], size(r["text"]), sizes[r["source"]], round(target[r["source"]], 4)) for r in docs) == Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 4)) for r in rows)
    source = {(r["doc_id"], size(r["text"])): r["source"] for r in docs}
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[(r["doc_id"], r["size"])]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1


def test_documents(documents):
    rows = mixing.mix(documents).collect()
    check(documents.collect(), rows)
    assert sorted(rows) == sorted(mixing.mix(documents.repartition(7)).collect())


def test_sql(documents, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    expected = sorted((r[0], r[1], r[2], round(r[3], 5), r[4]) for r in con.sql(mixing.ORACLE_SQL).fetchall())
    assert sorted((r[0], r[1], r[2], round(r[3], 5), r[4]) for r in mixing.mix(documents).drop("draw").collect()) == expected


def test_edges(edge, empty):
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count()
    check(edge.collect(), rows)
    assert mixing.mix(empty).count() == 0 and mixing.sampled(empty).count() == 0
    out = mixing.sampled(edge)
    assert out.columns == edge.columns and set(out.toPandas()["taken"]) == {"x"}


def test_hot_source(spark):
    rows = [(i, "w " * (i % 7 + 1), "hot" if i % 3 else f"s{i % 4}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(docs.collect(), mixing.mix(docs).collect())


def test_sampled_follows_the_mix(documents):
    taken = {r["doc_id"]: r for r in mixing.mix(documents).collect()}
    copies = Counter(r["doc_id"] for r in mixing.sampled(documents).collect())
    for i, r in taken.items():
        assert copies.get(i, 0) == (round(r["taken"] / r["size"]) if r["size"] else 1) or abs(copies.get(i, 0) - r["taken"] / r["size"]) <= 0.5


@pytest.mark.parametrize("share", [0.5, 1.0, 2.0])
def test_water_fill(spark, share):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, "e": 1}
    got = mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [3, 1, 2], share, 2)
    expected = filled(sizes, dict(zip("abcde", (3, 1, 2, 3, 1), strict=True)), share, 2)
    assert {r["source"]: round(r["target"], 6) for r in got.collect()} == {k: round(v, 6) for k, v in expected.items()}


def test_no_python_in_the_plan(documents):
    plan = mixing.mix(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
