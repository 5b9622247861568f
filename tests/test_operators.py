"""Golden rows, properties and failures of the conversation operators."""

import re

import numpy as np
import pytest
from parlance.config import MARKERS, WINDOWS
from parlance.functions.text import rating, rounded, strip, trim_response
from parlance.operators import examples, providers, ratings, reports, sampling, states, transcripts, vectors
from parlance.sources import io
from pyspark.sql import functions as F

T = {
    "t1": "agent(u1): a one\ncustomer(u2): c two\nagent(u3): a three\ncustomer(u4): c four\nagent(u5): a five\ncustomer(u6): c six\nagent(u7): a seven",
    "t2": "agent(u1): hi\nagent(u2): still me\ncustomer(u3): ok\nagent(u9): bye",
    "t3": "agent(u1): hi\ncustomer(u2):\nagent(u3): z",
    "t6": "no turns here",
    "t7": "agent(u1): l1\nl2\ncustomer(u2): x",
    "t8": "agent(u1): hi\ncustomer(u2): bye",
    "t9": None,
    "t10": "",
}
PATTERN = re.compile(r"^(agent|customer)\(u(\d+)\):\s*(.+)$", re.M)
ODD = ["agent(u1):\xa0x", "agent(u1): a\r\ncustomer(u2): b", "agent(u1): a\x85b", "agent(u1): a b", " agent(u1): x", "x agent(u1): y", "agent(u١): z", "agent(u1):\x1cz", "agent(u1):x ", "AGENT(u1): x", "agent(u1): ", "customer(u12): 🙂 ok", "agent(u1):\n\n\ncustomer(u2): y"]


@pytest.fixture(scope="module")
def texts(spark):
    return transcripts.parse(spark.createDataFrame(list(T.items()), "conv_id string, transcript string"))


def parsed_by_re(text):
    return [(s, int(n), t.strip()) for s, n, t in PATTERN.findall(text or "")]


def test_parse(texts, spark):
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in texts.collect()}
    assert got == {k: parsed_by_re(v) for k, v in T.items()}
    odd = transcripts.parse(spark.createDataFrame([(t,) for t in ODD], "transcript string")).collect()
    assert [[tuple(t) for t in r["turns"]] for r in odd] == [parsed_by_re(t) for t in ODD]


def test_validate_and_repair(texts, spark):
    got = {r["conv_id"]: r for r in transcripts.validate(texts).collect()}
    assert got["t1"]["status"] == "OK" and got["t2"]["status"] == got["t6"]["status"] == "WARN"
    assert got["t6"]["preview"] == got["t9"]["preview"] == "N/A" and got["t1"]["preview"] == "a one"
    fixed = transcripts.repair(texts).select("conv_id", "repaired")
    by = {r["conv_id"]: r["repaired"] for r in fixed.collect()}
    assert by["t2"] == "agent(u1): hi\ncustomer(u2): still me\nagent(u3): ok\ncustomer(u4): bye" and by["t6"] == T["t6"] and by["t9"] is None
    again = transcripts.repair(transcripts.parse(fixed, "repaired").withColumnRenamed("repaired", "transcript")).collect()
    assert {r["conv_id"]: r["repaired"] for r in again} == by
    left = transcripts.violations(transcripts.parse(fixed, "repaired")).select("conv_id").collect()
    assert {r[0] for r in left} == {"t3", "t6", "t7", "t8", "t9", "t10"}


def test_states_and_windows(texts):
    rows = {(r["conv_id"], r["state_turn_idx"]): r for r in states.states(texts).collect()}
    assert set(rows) == {("t1", 1), ("t1", 3), ("t1", 5), ("t2", 2)}
    r = rows[("t1", 3)]
    assert (r["state_index"], r["n_turns_available"], r["agent_response"], r["agent_response_turn_idx"]) == (1, 4, "a five", 5)
    assert r["w_0_text"] == "c four" and r["w1_text"] == "<|agent|>a three\n<|customer|>c four"
    full = "<|agent|>a one\n<|customer|>c two\n<|agent|>a three\n<|customer|>c four"
    assert {r[f"{w}_text"] for w in ("w2", "w3", "w5", "w10", "w_full")} == {full}
    assert rows[("t2", 2)]["agent_response_turn_idx"] == 9
    for r in rows.values():
        nested = [r["w_0_text"], *[r[f"{w}_text"] for w in WINDOWS], r["w_full_text"]]
        assert all(b.endswith(a) for a, b in zip(nested, nested[1:], strict=False))


@pytest.mark.parametrize(("n", "expected"), [(0, ""), (1, "a"), (4, "abcd"), (5, "abde"), (6, "abef")])
def test_history(spark, n, expected):
    df = spark.createDataFrame([(list("abcdef"), n)], "turns array<string>, pos int").withColumn("h", examples.history("turns", "pos", 4))
    assert "".join(df.first()["h"]) == expected
    with pytest.raises(ValueError):
        examples.history("turns", "pos", 2)


PACKS = [(14, "none", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 0]), (12, "none", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 0]), (10, "conv", [1, 2, 3, 6, 7, 8, 9, 10, 11, 0]), (7, "conv", [1, 2, 3, 9, 10, 11, 0]), (6, "head", [2, 3, 9, 10, 11, 0]), (3, "over", [9, 10, 11])]


@pytest.mark.parametrize(("limit", "kind", "ids"), PACKS)
def test_packing(spark, limit, kind, ids):
    df = spark.createDataFrame([([1, 2, 3], [4, 5, 6, 7, 8], [9, 10], [11, 0])], "head array<int>, conv array<int>, tail array<int>, t array<int>")
    r = examples._fit(df, limit, -100, 7).first()
    assert r["trunc_kind"] == kind and r["n_real"] == len(ids)
    assert r["input_ids"] == ids + [7] * (limit - len(ids)) and r["attention_mask"] == [1] * len(ids) + [0] * (limit - len(ids))
    assert len(r["labels"]) == limit
    if kind != "over":
        assert r["labels"] == [-100] * (len(ids) - 2) + [11, 0] + [-100] * (limit - len(ids))


def test_packed_rows_have_the_length(spark, texts):
    rows = examples.examples(texts, min_tokens=1, id_column="conv_id")
    for limit in (4, 16, 64, 512):
        for r in examples.boundaries(examples.pack(rows, limit)).collect():
            assert len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"]) == limit
            assert r["n_attended"] == r["n_real"] and all(a or x == -100 for a, x in zip(r["attention_mask"], r["labels"], strict=True))


def test_no_marker_is_split(spark):
    from parlance.functions.text import tokens

    text = "".join(f"<|{m}|>x" for m in MARKERS)
    assert [t for t in spark.range(1).select(tokens(F.lit(text)).alias("t")).first()["t"] if t != "x"] == [f"<|{m}|>" for m in MARKERS]


def test_rating_and_trim(spark):
    answers = {"4": 4, " 4\n": 4, "+4": 4, "9": 5, "0": 1, "4.0": 3, "4/5": 3, "": 3}
    df = spark.createDataFrame([(a,) for a in answers], "a string").withColumn("r", rating(F.col("a")))
    assert {r["a"]: r["r"] for r in df.collect()} == answers
    replies = {"Hi there<|customer|>no<|agent|>x": "Hi there", "  plain  ": "plain", "a<eos>b<|/conversation|>": "a", "<|agent|>zz": ""}
    df = spark.createDataFrame([(a,) for a in replies], "a string").withColumn("r", trim_response(F.col("a"), "<eos>"))
    assert {r["a"]: r["r"] for r in df.collect()} == replies
    for s in [" x ", "\xa0x　", "\x1cx\x1f", "\n\t", ""]:
        assert spark.createDataFrame([(s,)], "s string").select(strip(F.col("s"))).first()[0] == s.strip()


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    values = [i / 10**6 for i in range(-99950, 100000, 100)] + [0.32985, 0.329849, 0.0015625, -0.00004, 0.00005, 0.0, 4.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(rounded(F.col("v"), 4).cast("decimal(9,4)").cast("string")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 4)::DECIMAL(9, 4)::VARCHAR", [v]).fetchall()[0][0] for v in values]


VECTORS = [(0, "A", [1.0, 0.0, 0.0, 1.0]), (1, "A", [1.0, 0.0, 1.0, 0.0]), (2, "B", [1.0, 0.0, 0.0, 1.0]), (3, "B", [0.0, 1.0, 0.0, 1.0]), (4, "C", [0.6, 0.8, 1.0, 0.0])]


def top(spark, weights, **options):
    df = spark.createDataFrame(VECTORS, "vec_id long, label string, embedding array<float>")
    return [(r["cand_id"], round(r["score"], 5)) for r in vectors.topk(df.where("vec_id = 0"), df, weights, ["p", "q"], 5, **options).orderBy("rank").collect()]


def test_composite_scores(spark):
    assert top(spark, {"p": 0.5, "q": 0.5}) == [(2, 1.0), (3, 0.5), (4, 0.3)]
    assert top(spark, {"p": 0.9, "q": 0.1}) == [(2, 1.0), (4, 0.54), (3, 0.1)] == top(spark, {"p": 9.0, "q": 1.0})
    masked = top(spark, {"p": 0.5, "q": 0.5}, same_group="mask")
    assert masked[:3] == [(2, 1.0), (3, 0.5), (4, 0.3)] and masked[3:] == [(0, float("-inf")), (1, float("-inf"))]
    assert len(top(spark, {"p": 1.0}, same_group="keep")) == 5
    assert vectors.normalise_weights({"p": 2, "z": 5}, ["p", "q"]) == {"p": 1.0}
    for bad in ({"z": 5}, {"p": 1, "q": -1}):
        with pytest.raises(ValueError):
            vectors.normalise_weights(bad, ["p", "q"])


def test_blocks_and_expressions_agree(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    names, w = [f"p{i}" for i in range(8)], {f"p{i}": i + 1.0 for i in range(8)}
    asked = e.where("vec_id % 20 = 0")
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "CHUNK", 13)
    fast = {tuple(r) for r in vectors.topk(asked, e, w, names).collect()}
    assert fast == {tuple(r) for r in vectors.topk_expressions(asked, e, w, names).collect()}
    nulls = spark.createDataFrame([(None, 1, [1.0] * 64), (10**6, None, [1.0] * 64), (10**6 + 1, 3, None)], "vec_id long, label int, embedding array<float>")
    some = e.select("vec_id", F.col("label").cast("int"), "embedding").unionByName(nulls)
    found = vectors.topk(some.where("vec_id = 1000000"), some, w, names, 600)
    assert found.count() == e.count() + 1
    assert vectors.topk(e.limit(0), e, w, names).count() == vectors.topk(asked, e.limit(0), w, names).count() == 0


def test_normalised_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(vectors.l2_normalise("v").alias("u")).collect()
    assert np.allclose(df[0]["u"], [0.6, 0.8]) and df[1]["u"] == [0.0, 0.0]


def test_bins_and_samples(spark):
    rows = [(c, i) for c, n in enumerate([1, 2, 3, 4, 6, 9] * 8) for i in range(n)]
    binned = sampling.bins(sampling.several_states(spark.createDataFrame(rows, "conv_id long, state_index int")))
    by = {(r["conv_id"], r["state_index"]): r for r in binned.collect()}
    assert not any(c % 6 == 0 for c, _ in by)
    assert all(r["position_bin"] == ("early" if r["position"] <= 0.33 else "mid" if r["position"] <= 0.67 else "late") for r in by.values())
    key = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("state_index").cast("string"))
    chosen = sampling.sample(binned, 30, 42, key)
    again = sampling.sample(binned.repartition(5), 30, 42, key)
    assert chosen.count() == 30 and {tuple(r) for r in chosen.select("conv_id", "state_index").collect()} == {tuple(r) for r in again.select("conv_id", "state_index").collect()}
    rest = sampling.holdout(binned, chosen, 30, 99, key)
    assert rest.count() <= 30 and rest.join(chosen, ["conv_id", "state_index"], "left_semi").isEmpty()
    assert sampling.sample(binned, 10_000, 1, key).count() == len(by)


def test_percentiles(spark):
    df = spark.createDataFrame([(x,) for x in (3, 9, 27, 81, 1)], "x int")
    assert [r["value"] for r in reports.percentiles(df, "x").orderBy("percentile").collect()] == [9, 27, 59, 70, 78, 81]


def test_weights_of_trials_sum_to_one(spark):
    w = ratings.trial_weights(spark.range(20).select(F.col("id").cast("int").alias("trial")), ["a", "b", "c"]).groupBy("trial").agg(F.sum("weight").alias("s"))
    assert all(abs(r["s"] - 1) < 2e-4 for r in w.collect())


def test_caches(spark):
    rows = spark.createDataFrame([("k1", 2, 0), ("k2", 5, 1), ("k1", 4, 2)], "key string, rating int, seq long")
    assert {r["key"]: r["rating"] for r in ratings.latest(rows, "key", "rating").collect()} == {"k1": 4, "k2": 5}


def test_embedder(spark):
    rows = spark.createDataFrame([(1, "a", "The cat"), (2, "a", "the  CAT"), (3, "b", ""), (4, "b", None)], "id int, window string, text string")
    got = {r["id"]: r["vec"] for r in providers.embed_distinct(rows, 16).collect()}
    assert got[1] == got[2] and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and not any(got[3]) and 4 not in got


def test_failures(spark, tmp_path):
    df = spark.createDataFrame([("x", "robot")], "conv_id string, speaker string")
    with pytest.raises(Exception, match="unknown speaker"):
        transcripts.check_speakers(df).collect()
    with pytest.raises(ValueError):
        transcripts.require_columns(df, "transcript")
    with pytest.raises(ValueError):
        transcripts.require_rows(df.limit(0))
    (tmp_path / "bad.json").write_text('{"conversation_id": "a"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        io.read_jsonl(spark, f"file://{tmp_path}/bad.json").collect()
    (tmp_path / "few.json").write_text('{"prefix": "p", "cleaned_target": "c", "target": "t"}\n')
    assert io.read_examples(spark, f"file://{tmp_path}/few.json").first()["target"] == "c"
    (tmp_path / "none.json").write_text('{"prefix": "p"}\n')
    with pytest.raises(ValueError):
        io.read_examples(spark, f"file://{tmp_path}/none.json")


def test_index_checks(spark, tmp_path):
    vec = spark.createDataFrame([(1, "w1", [1.0, 0.0]), (1, "w_0", [0.0, 1.0]), (2, "w1", [1.0, 0.0])], "state_id long, window string, vec array<double>")
    meta = spark.createDataFrame([(1, "x"), (2, "y")], "state_id long, conversation_id string")
    io.write_index(vec, meta, f"file://{tmp_path}/a")
    assert io.read_index(spark, f"file://{tmp_path}/a", states.ORDER, 2)[2] == ["w_0", "w1"]
    io.write_index(vec, meta.limit(1), f"file://{tmp_path}/b")
    for path, known, dims in (("a", ("other",), 2), ("a", states.ORDER, 3), ("b", states.ORDER, 2)):
        with pytest.raises(ValueError):
            io.read_index(spark, f"file://{tmp_path}/{path}", known, dims)
    io.write_weights({"w1": 0.25, "w2": 0.75}, f"file://{tmp_path}/w", spark)
    assert io.read_weights(f"file://{tmp_path}/w", spark) == {"w1": 0.25, "w2": 0.75}


def test_non_ascii_and_nulls_in_json_lines(spark, tmp_path):
    io.write_jsonl(spark.createDataFrame([("é🙂", None, "x")], io.RAW), f"file://{tmp_path}/j")
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert "é🙂" in text and '"label":null' in text


def test_empty_tables(spark):
    none = transcripts.parse(spark.createDataFrame([], "conv_id string, transcript string"))
    assert states.states(none).count() == examples.examples(none, id_column="conv_id").count() == transcripts.repair(none).count() == 0


@pytest.mark.parametrize("same_group", ["drop", "keep"])
def test_all_trials_meet_a_candidate_in_one_pass(spark, monkeypatch, same_group):
    rng = np.random.default_rng(5)
    made = rng.normal(size=(700, 16))
    made[300:500] = made[:200]  # exact copies: equal scores, ties by id
    made[600:] = np.round(made[600:])
    made[650:] = 0
    df = spark.createDataFrame([(i, str(i % 3) if i % 50 else None, v.tolist()) for i, v in enumerate(made)], "vec_id long, label string, embedding array<double>").repartition(3)
    names, trials = list("abcd"), {t: dict(zip("abcd", w, strict=True)) for t, w in enumerate(rng.uniform(0.01, 10, (30, 4)).tolist())}
    trials[30] = {"a": 3.0, "b": -1.0, "c": 0.5, "d": 0.1}
    for name, n in (("CHUNK", 64), ("FIRST", 16), ("TILE", 32), ("PAIRS", 100), ("GATHERED", 500)):
        monkeypatch.setattr(vectors, name, n)
    found = vectors.topk_trials(df.where("vec_id < 200"), df, trials, names, 5, same_group=same_group)
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    got = {}
    for r in found.orderBy("trial", "query_id", "rank").collect():
        got.setdefault((r["trial"], r["query_id"]), []).append((r["cand_id"], r["score"]))
    unit = vectors.unit_windows(made, 4)
    label = np.array([i % 3 if i % 50 else -1 for i in range(700)])  # no group: nothing is left out
    cosines = np.einsum("qwd,cwd->qcw", unit[:200], unit)
    for t, w in trials.items():
        total = sum(w.values())
        scores = np.round(cosines @ np.array([x / total for x in w.values()]), 6) + 0.0
        for q in range(200):
            best = sorted((-scores[q, c], c) for c in range(700) if same_group == "keep" or label[q] < 0 or label[q] != label[c])[:5]
            assert [c for c, _ in got[t, q]] == [c for _, c in best] and np.allclose([s for _, s in got[t, q]], [-s for s, _ in best], atol=2e-6)


def test_memory_of_search_and_embedder_is_bounded(spark):
    import tracemalloc

    import pyarrow as pa

    class Rows:
        """A table whose function runs here; its session hands a broadcast value back."""

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    rng, at_once = np.random.default_rng(1), 4000
    block = [(i, None, v) for i, v in enumerate(rng.normal(size=(4096, 64)))]
    rows = Rows()
    rows.sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda x: type("B", (), {"value": x}))})})
    unit = vectors._shared(rows, block, {0: np.full(8, 0.125)})
    made = rng.normal(size=(at_once, 64))
    batch = pa.record_batch([pa.array(range(at_once)), pa.array([None] * at_once, pa.string()), pa.array(list(made))], ["vec_id", "g", "embedding"])
    run = vectors._against(unit, rows, 5, "drop")
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter([batch]))) == 4096 * 5
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 2**20  # a block against a chunk in doubles is 32 MB, and was there several times

    def provider():
        def embed(texts):
            assert len(texts) <= 512
            return np.ones((len(texts), 4))

        return embed

    df = spark.range(3000).select(F.col("id").cast("string").alias("text")).coalesce(1)
    assert providers.embed_distinct(df, 4, provider).count() == 3000
