"""Conversations of over 100 states, next to each other."""

from parlance.plans import vector_queries

STATES = 130


def test_state_ids_do_not_meet(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"word{c} about thing{t % 7} number{t}") for c in (1, 2, 3) for t in range(2 * STATES)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    n = 3 * STATES
    stored = vector_queries.index_round_trip(spark, str(tmp_path)).collect()
    assert len(stored) == len({r["state_id"] for r in stored}) == n and {r["n_windows"] for r in stored} == {8}
    assert vector_queries.window_embeddings(spark, str(tmp_path)).select("vec_id").distinct().count() == n
    found = vector_queries.text_retrieval(spark, str(tmp_path)).collect()
    asked = [i for c in (1, 2, 3) for s in range(STATES) if (i := c * 2**31 + s) % vector_queries.EVERY == 0]
    assert sorted((r["query_id"], r["rank"]) for r in found) == [(i, k) for i in asked for k in range(1, 6)]
