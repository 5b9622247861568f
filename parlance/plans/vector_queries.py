"""Queries over vectors and ratings: similarity search, samples, caches, weight search, hold-out comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.config import Config
from parlance.functions.text import rating, rounded
from parlance.operators import compliance, providers, ratings, reports, sampling, states, vectors
from parlance.plans.inputs import HASH, PARTS, STATES, state_rows, table
from parlance.sources import io

FOUND: dict = {}
SQL: dict[str, str] = {}
DEFAULTS = Config()
#: Query sets are the rows whose id is divisible by this.
EVERY = 20
UNIFORM = vectors.uniform(PARTS)
WEIGHTED = {p: float(j + 1) for j, p in enumerate(PARTS)}


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL pieces -------------------------------------------------------------------------------------------------------
_NORMED = "list_transform({v}, lambda x: x / (sqrt(list_sum(list_transform({v}, lambda y: y * y))) + 1e-8))"
UNITS = f"""raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
cut AS (SELECT vec_id, label, {", ".join(f"e[{8 * j + 1}:{8 * j + 8}] AS s{j}" for j in range(8))} FROM raw),
units AS (SELECT vec_id, label, {", ".join(f"{_NORMED.format(v=f's{j}')} AS n{j}" for j in range(8))} FROM cut)"""


def score_sql(weights: dict[str, float], sims: str = "list_inner_product(q.n{j}, c.n{j})") -> str:
    total = sum(weights.values())
    return "round(" + " + ".join(f"{w / total!r} * {sims.format(j=PARTS.index(p))}" for p, w in weights.items()) + ", 6) + 0.0"


def topk_sql(weights: dict[str, float], where: str = "q.label <> c.label", asked: str = f"q.vec_id % {EVERY} = 0", k: int = 5) -> str:
    return f"""{UNITS}, top AS (
  SELECT q.vec_id AS query_id, c.vec_id AS cand_id, {score_sql(weights)} AS score FROM units q, units c WHERE {asked} AND {where}
), best AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id)::INT AS rank, cand_id, score FROM top QUALIFY rank <= {k}
)"""


def asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("vec_id") % EVERY == 0)


# --- similarity search ------------------------------------------------------------------------------------------------
@query(f"WITH raw AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, {_NORMED.format(v='e')} AS u FROM raw) SELECT vec_id, i::INT AS dim, round(u[i + 1], 6) + 0.0 AS value FROM n, unnest(range(64)) AS t(i)")
def l2_normalize(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalise("embedding")).alias("dim", "value")).select("vec_id", "dim", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query(f"WITH {UNITS} SELECT q.vec_id, w.p AS part, round(CASE w.p " + " ".join(f"WHEN '{p}' THEN list_inner_product(q.n{j}, c.n{j})" for j, p in enumerate(PARTS)) + f" END, 6) + 0.0 AS cosine FROM units q JOIN units c ON c.vec_id = q.vec_id + 1, unnest({PARTS!r}) AS w(p)")
def window_cosine(spark, sf):
    """The cosine in each window of every vector with the next one."""
    unit = vectors.split_windows(table(spark, sf, "embeddings"), "embedding", PARTS)
    nxt = unit.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(f"n_{p}").alias(f"c_{p}") for p in PARTS])
    both = unit.join(nxt, "vec_id")
    pairs = ", ".join(f"'{p}', {'cos_' + p}" for p in PARTS)
    cosines = both.select("vec_id", *[(F.round(vectors.dot(f"n_{p}", f"c_{p}"), 6) + F.lit(0.0)).alias(f"cos_{p}") for p in PARTS])
    return cosines.select("vec_id", F.expr(f"stack({len(PARTS)}, {pairs}) as (part, cosine)"))


def _topk(spark, sf, weights, **options) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.topk(asked(e), e, weights, PARTS, DEFAULTS.top_k, **options)


@query(f"WITH {topk_sql(UNIFORM)} SELECT * FROM best")
def composite_topk(spark, sf):
    return _topk(spark, sf, UNIFORM)


@query(f"WITH {topk_sql(WEIGHTED)} SELECT * FROM best")
def composite_topk_weighted(spark, sf):
    return _topk(spark, sf, WEIGHTED)


@query(f"WITH {topk_sql({p: w for p, w in WEIGHTED.items() if p in PARTS[:3]}, 'true')} SELECT * FROM best")
def adhoc_topk(spark, sf):
    """Three windows only, nothing excluded: a query finds itself."""
    return _topk(spark, sf, {p: WEIGHTED[p] for p in PARTS[:3]} | {"absent": 9.0}, same_group="keep")


@query(f"""WITH {UNITS}, top AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, q.label = c.label AS own, {score_sql(UNIFORM)} AS score FROM units q, units c WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY own, score DESC, cand_id)::INT AS rank, cand_id, CASE WHEN own THEN '-inf' ELSE round(score, 4)::DECIMAL(9, 4)::VARCHAR END AS score FROM (SELECT query_id, cand_id, own, CASE WHEN own THEN 0 ELSE score END AS score FROM top) QUALIFY rank <= 28""")
def masked_topk(spark, sf):
    """Candidates of the own group stay, with a score of minus infinity: they come where others run out."""
    e = table(spark, sf, "embeddings")
    found = vectors.topk(asked(e), e, UNIFORM, PARTS, 28, same_group="mask")
    shown = F.when(F.col("score") == float("-inf"), "-inf").otherwise(rounded(F.col("score"), 4).cast("decimal(9,4)").cast("string"))
    return found.withColumn("score", shown)


@query(f"WITH {topk_sql(UNIFORM)} SELECT b.*, " + ", ".join(f"round(list_inner_product(q.n{j}, c.n{j}), 6) + 0.0 AS sim_{p}" for j, p in enumerate(PARTS)) + " FROM best b JOIN units q ON q.vec_id = query_id JOIN units c ON c.vec_id = cand_id")
def similarity_breakdown(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.breakdown(composite_topk(spark, sf), asked(e), e, PARTS)


@query(f"WITH {topk_sql(UNIFORM, 'c.label = 0', f'q.label = 1 AND q.vec_id % {EVERY} = 0')} SELECT * FROM best")
def cross_outcome_pairs(spark, sf):
    """The nearest states of the other outcome: chosen against rejected."""
    e = table(spark, sf, "embeddings")
    return vectors.topk(asked(e).where("label = 1"), e.where("label = 0"), UNIFORM, PARTS, DEFAULTS.top_k)


@query(f"WITH {topk_sql(UNIFORM)} SELECT query_id, cand_id, score FROM best WHERE score >= 0.3")
def divergent_neighbours(spark, sf):
    """Very similar states of another outcome."""
    return composite_topk(spark, sf).where("score >= 0.3").select("query_id", "cand_id", "score")


# --- text: embed, index, retrieve -------------------------------------------------------------------------------------
_NAMES = list(states.ORDER)
#: A state's id: a conversation has under 2^31 turns, so no two states share one.
STATE_ID = "conv_id * 2147483648 + state_index"
SUMMARY = "'Turns: ' || len(string_split({t}, chr(10))) || '; begins: ' || left({t}, 60)"
_VECTOR = "list_transform(range(64), lambda d: coalesce(list_sum(list_transform(list_filter({h}, lambda h: h % 64 = d), lambda h: CASE WHEN (h // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END)), 0.0::DOUBLE))"
_WORDS = "list_filter(string_split_regex(lower({t}), '\\s+'), lambda w: w <> '')"
SUMMARISED = f"""{STATES}, full_states AS (SELECT *, {STATE_ID} AS vec_id, {SUMMARY.format(t="w_full_text")} AS w_summary_text FROM states)"""
EMBEDDED = f"""{SUMMARISED}, long AS (
  SELECT conv_id, vec_id, w."window", CASE w."window" {" ".join(f"WHEN '{w}' THEN {w}_text" for w in _NAMES)} END AS text FROM full_states, unnest({_NAMES!r}) AS w("window")
), hashed AS (
  SELECT *, list_transform({_WORDS.format(t="text")}, lambda w: {HASH.format("w")}) AS h FROM long
), vectored AS (
  SELECT conv_id, vec_id, "window", {_VECTOR.format(h="h")} AS v FROM hashed
), normed AS (
  SELECT conv_id, vec_id, "window", {_NORMED.format(v="v")} AS u FROM vectored
)"""


def summarised(spark, sf) -> DataFrame:
    """States with their id and a summary as eighth window."""
    return state_rows(spark, sf).withColumn("vec_id", F.expr(STATE_ID)).withColumn("w_summary_text", providers.summary_of(F.col("w_full_text")))


def embedded(spark, sf) -> DataFrame:
    """(conv_id, vec_id, window, text, vec): each distinct text is embedded once."""
    return providers.embed_distinct(states.windows_long(summarised(spark, sf), tuple(_NAMES), ("conv_id", "vec_id")))


@query(f'WITH {EMBEDDED} SELECT vec_id, "window", i::INT AS dim, round(u[i + 1], 6) + 0.0 AS value FROM normed, unnest(range(64)) AS t(i) WHERE u[i + 1] <> 0')
def window_embeddings(spark, sf):
    rows = embedded(spark, sf).select("vec_id", "window", F.posexplode("vec").alias("dim", "value")).where("value <> 0")
    return rows.withColumn("value", F.round("value", 6) + F.lit(0.0))


def _index(rows: DataFrame) -> DataFrame:
    """(conv_id, vec_id, embedding): a state's windows end to end, in the order of their names."""
    wide = rows.groupBy("conv_id", "vec_id").agg(*[F.first(F.when(F.col("window") == w, F.col("vec")), ignorenulls=True).alias(f"v_{w}") for w in _NAMES])
    return wide.select("conv_id", "vec_id", F.concat(*[f"v_{w}" for w in _NAMES]).alias("embedding"))


_TEXT_WEIGHTS = {"w_0": 3.0, "w1": 1.0, "w2": 2.0, "w3": 1.0, "w5": 1.0, "w10": 1.0, "w_full": 1.0, "w_summary": 2.0}
_TEXT_SCORE = " + ".join(f"{w / sum(_TEXT_WEIGHTS.values())!r} * list_inner_product(q.n{j}, c.n{j})" for j, w in enumerate(_TEXT_WEIGHTS.values()))
STORED = f"""{EMBEDDED}, wide AS (SELECT conv_id, vec_id, {", ".join(f"first(u) FILTER (\"window\" = '{w}') AS u{j}" for j, w in enumerate(_NAMES))} FROM normed GROUP BY ALL),
stored AS (SELECT conv_id, vec_id, {", ".join(f"{_NORMED.format(v=f'u{j}')} AS n{j}" for j in range(len(_NAMES)))} FROM wide)"""


def retrieved_sql(asked: str) -> str:
    return f"""top AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, round({_TEXT_SCORE}, 6) + 0.0 AS score FROM stored q, stored c WHERE {asked} AND q.conv_id <> c.conv_id),
best AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id)::INT AS rank, cand_id, score FROM top QUALIFY rank <= 5)"""


def retrieved(spark, sf, chosen: DataFrame | None = None) -> DataFrame:
    """The best matches of other conversations for the states in ``chosen`` (vec_id), else for every 20th id."""
    index = _index(embedded(spark, sf))
    rows = asked(index) if chosen is None else index.join(chosen.select("vec_id"), "vec_id", "left_semi")
    return vectors.topk(rows, index, _TEXT_WEIGHTS, _NAMES, DEFAULTS.top_k, group="conv_id")


@query(f"WITH {STORED}, {retrieved_sql(f'q.vec_id % {EVERY} = 0')} SELECT * FROM best")
def text_retrieval(spark, sf):
    """Transcripts to states to embeddings of all eight windows to the ranked matches in other conversations."""
    return retrieved(spark, sf)


@query(f"""WITH {STORED}, {retrieved_sql(f'q.vec_id % {EVERY} = 0')}
SELECT query_id, rank, score, q.conv_id AS query_conv, q.state_index AS query_state, q.n_turns_available AS query_turns, left(q.w_0_text, 200) AS customer, left(q.agent_response, 200) AS response, left(q.w_summary_text, 200) AS summary,
  c.conv_id AS match_conv, c.state_index AS match_state, left(c.w_0_text, 150) AS match_customer, left(c.agent_response, 150) AS match_response
FROM best JOIN full_states q ON q.vec_id = query_id JOIN full_states c ON c.vec_id = cand_id""")
def retrieval_display(spark, sf):
    """Ranked matches with what a reader is shown of the query and of the match."""
    rows = summarised(spark, sf)
    show = lambda c, n: F.substring(c, 1, n)
    q = rows.select(F.col("vec_id").alias("query_id"), F.col("conv_id").alias("query_conv"), F.col("state_index").alias("query_state"), F.col("n_turns_available").alias("query_turns"), show("w_0_text", 200).alias("customer"), show("agent_response", 200).alias("response"), show("w_summary_text", 200).alias("summary"))
    c = rows.select(F.col("vec_id").alias("cand_id"), F.col("conv_id").alias("match_conv"), F.col("state_index").alias("match_state"), show("w_0_text", 150).alias("match_customer"), show("agent_response", 150).alias("match_response"))
    return retrieved(spark, sf).join(q, "query_id").join(c, "cand_id").drop("cand_id")


_CONTEXT = "'Recent turns:' || chr(10) || {s}.w3_text || chr(10) || chr(10) || 'Summary:' || chr(10) || {s}.w_summary_text"


@query(f"""WITH {STORED}, {retrieved_sql(f'q.vec_id % {EVERY} = 0')}
SELECT query_id, cand_id, 'Would the same reply of the agent serve both of these states? Answer with one number from 1 (not at all) to 5 (fully).' || chr(10) || chr(10) || 'First state:' || chr(10)
  || {_CONTEXT.format(s="q")} || chr(10) || chr(10) || 'Second state:' || chr(10) || {_CONTEXT.format(s="c")} AS prompt
FROM best JOIN full_states q ON q.vec_id = query_id JOIN full_states c ON c.vec_id = cand_id""")
def judge_prompts(spark, sf):
    """What a judge is asked about each retrieved pair."""
    rows = states.judge_context(summarised(spark, sf)).select("vec_id", "judge_context")
    pairs = retrieved(spark, sf).join(rows.toDF("query_id", "a"), "query_id").join(rows.toDF("cand_id", "b"), "cand_id")
    return pairs.select("query_id", "cand_id", states.pair_prompt("a", "b").alias("prompt"))


@query(f'WITH {SUMMARISED} SELECT vec_id AS state_id, {len(_NAMES)} AS n_windows, agent_response, label FROM full_states LEFT JOIN (SELECT doc_id, quality::INT AS label FROM labels) ON doc_id = conv_id')
def index_round_trip(spark, sf):
    """The index written, read again, held against its metadata and joined to it."""
    path = io.scratch(spark, "index")
    rows = embedded(spark, sf).withColumnRenamed("vec_id", "state_id")
    label = table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"), F.col("quality").cast("int").alias("label"))
    meta = summarised(spark, sf).withColumnRenamed("vec_id", "state_id").join(label, "conv_id", "left")
    io.write_index(rows.select("state_id", "window", "vec"), meta, path)
    stored, metadata, _ = io.read_index(spark, path, states.ORDER, 64)
    counted = stored.groupBy("state_id").agg(F.count_distinct("window").cast("int").alias("n_windows"))
    return counted.join(metadata, "state_id").select("state_id", "n_windows", "agent_response", "label")


@query(f"WITH {STATES} SELECT conv_id, state_index, 'Summarise the conversation in six fields (need, product, objections, promises, mood, next step).' || chr(10) || chr(10) || w_full_text AS summary_prompt FROM states")
def summary_prompts(spark, sf):
    return states.summary_prompt(state_rows(spark, sf)).select("conv_id", "state_index", "summary_prompt")


@query(f"WITH {SUMMARISED} SELECT conv_id, state_index, CASE WHEN conv_id % 3 = 0 AND state_index = 0 THEN 'kept ' || conv_id || '|' || state_index ELSE w_summary_text END AS summary FROM full_states")
def summary_cache(spark, sf):
    """Summaries from an append-only cache; those that it lacks are made, appended and found on the next read."""
    path = io.scratch(spark, "summaries")
    rows = state_rows(spark, sf).select("conv_id", "state_index", ratings.state_key(F.col("conv_id"), F.col("state_index")).alias("key"), "w_full_text")
    kept = rows.where("conv_id % 3 = 0 and state_index = 0").select("key", F.concat(F.lit("kept "), "key").alias("summary"), F.lit(0).cast("long").alias("seq"))
    io.append_cache(kept, path)
    missing = ratings.misses(rows, io.read_cache(spark, path, "summary", io.SUMMARIES), ["key"])
    io.append_cache(missing.select("key", providers.summary_of(F.col("w_full_text")).alias("summary"), F.lit(1).cast("long").alias("seq")), path)
    return rows.join(io.read_cache(spark, path, "summary", io.SUMMARIES), "key").select("conv_id", "state_index", "summary")


@query(f"""WITH {STATES}, asked AS (SELECT conv_id, arg_max(w2_text, state_index) AS text FROM states GROUP BY conv_id),
texts AS (SELECT 0 AS kind, conv_id AS id, text FROM asked UNION ALL SELECT 1, item_id, text FROM benchmark),
hashed AS (SELECT kind, id, text, list_transform({_WORDS.format(t="text")}, lambda w: {HASH.format("w")}) AS h FROM texts),
vectored AS (SELECT kind, id, text, {_VECTOR.format(h="h")} AS v FROM hashed), once AS (SELECT kind, id, text, {_NORMED.format(v="v")} AS u FROM vectored), normed AS (SELECT kind, id, text, {_NORMED.format(v="u")} AS n FROM once),
top AS (SELECT q.id AS query_id, c.id AS cand_id, c.text, round(list_inner_product(q.n, c.n), 6) + 0.0 AS score FROM normed q, normed c WHERE q.kind = 0 AND c.kind = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM top QUALIFY rank <= 2)
SELECT query_id AS conv_id, string_agg(left(text, 80), chr(10) ORDER BY rank) AS context FROM best GROUP BY query_id""")
def context_documents(spark, sf):
    """The texts nearest to a conversation's recent turns, for the context block of its prompt."""
    last = state_rows(spark, sf).groupBy("conv_id").agg(F.max_by("w2_text", "state_index").alias("text"))
    texts = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("vec_id"), "text")
    vectored = lambda df: providers.embed_distinct(df).select("vec_id", F.lit(None).cast("string").alias("label"), F.col("vec").alias("embedding"))
    found = vectors.topk(vectored(last.withColumnRenamed("conv_id", "vec_id")), vectored(texts), {"text": 1.0}, ["text"], 2, same_group="keep")
    return compliance.context_of(found, texts.withColumnRenamed("vec_id", "cand_id")).withColumnRenamed("query_id", "conv_id")


# --- samples ----------------------------------------------------------------------------------------------------------
def state_key():
    return F.concat_ws("|", F.col("conv_id").cast("string"), F.col("state_index").cast("string"))


BINNED = f"""{STATES}, sized AS (SELECT conv_id, state_index, count(*) OVER (PARTITION BY conv_id) AS n_states, max(state_index) OVER (PARTITION BY conv_id) AS last FROM states),
several AS (SELECT *, state_index / greatest(last, 1) AS position FROM sized WHERE n_states > 1),
edges AS (SELECT quantile_cont(n_states, 1 / 3) AS low, quantile_cont(n_states, 2 / 3) AS high FROM several),
binned AS (SELECT conv_id, state_index, CASE WHEN position <= 0.33 THEN 'early' WHEN position <= 0.67 THEN 'mid' ELSE 'late' END || '_' || CASE WHEN n_states <= low THEN 'short' WHEN n_states <= high THEN 'medium' ELSE 'long' END AS stratum FROM several, edges)"""


def sampled_sql(name: str, n: int, seed: int) -> str:
    return f"""{name} AS (SELECT conv_id, state_index, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY draw, conv_id, state_index) AS nth FROM (SELECT *, {HASH.format(f"'{seed}|' || conv_id || '|' || state_index")} AS draw FROM binned)),
  (SELECT greatest(1, {n} // greatest(count(DISTINCT stratum), 1)) AS per FROM binned) ORDER BY nth <= per DESC, draw, conv_id, state_index LIMIT {n})"""


SAMPLED = f"{BINNED}, {sampled_sql('sampled', 80, 42)}"
HELD = f"{SAMPLED}, {sampled_sql('drawn_held', 30, 99)}, held AS (SELECT conv_id, state_index FROM drawn_held ANTI JOIN sampled USING (conv_id, state_index))"


def binned(spark, sf) -> DataFrame:
    return sampling.bins(sampling.several_states(state_rows(spark, sf).select("conv_id", "state_index")), DEFAULTS.position_cuts)


@query(f"WITH {BINNED} SELECT stratum, count(*) AS n FROM binned GROUP BY 1")
def strata_counts(spark, sf):
    return binned(spark, sf).groupBy("stratum").agg(F.count("*").alias("n"))


@query(f"WITH {SAMPLED} SELECT * FROM sampled")
def stratified_sample(spark, sf):
    return sampling.sample(binned(spark, sf), DEFAULTS.eval_states, DEFAULTS.eval_seed, state_key()).select("conv_id", "state_index", "stratum")


def held_out(spark, sf) -> DataFrame:
    """(conv_id, state_index) of the hold-out: a stratified sample under its own seed, less the evaluation states."""
    rows = binned(spark, sf)
    chosen = sampling.sample(rows, DEFAULTS.eval_states, DEFAULTS.eval_seed, state_key())
    return sampling.holdout(rows, chosen, DEFAULTS.holdout, DEFAULTS.holdout_seed, state_key()).select("conv_id", "state_index")


@query(f"WITH {HELD} SELECT * FROM held")
def holdout_split(spark, sf):
    return held_out(spark, sf)


@query(f"""WITH {SAMPLED}, v AS (SELECT n_turns_available::DOUBLE AS v FROM states JOIN sampled USING (conv_id, state_index)),
e AS (SELECT list_sort(list_distinct([quantile_cont(v, 0), quantile_cont(v, 1 / 3), quantile_cont(v, 2 / 3), quantile_cont(v, 1)])) AS e FROM v),
placed AS (SELECT e, least(greatest(len(e) - 1, 1), greatest(1, len(list_filter(e, lambda x: x < v)))) AS i FROM v, e)
SELECT '(' || (CASE WHEN i = 1 THEN e[1] - 0.001 ELSE e[i] END)::DECIMAL(18, 3)::VARCHAR || ', ' || coalesce(e[i + 1], e[1])::DECIMAL(18, 3)::VARCHAR || ']' AS "interval", count(*) AS n FROM placed GROUP BY 1""")
def turns_terciles(spark, sf):
    """How the sampled states spread over terciles of the turns before them."""
    chosen = sampling.sample(binned(spark, sf), DEFAULTS.eval_states, DEFAULTS.eval_seed, state_key()).select("conv_id", "state_index")
    rows = state_rows(spark, sf).select("conv_id", "state_index", "n_turns_available").join(chosen, ["conv_id", "state_index"], "left_semi")
    return reports.tercile_intervals(rows, "n_turns_available")


@query(f"""WITH {HELD.replace(STATES, STORED, 1)}, {retrieved_sql("q.vec_id IN (SELECT " + STATE_ID + " FROM held)")},
rated AS (SELECT *, (1 + floor(4 * greatest(0, least(1, score))))::INT AS rating FROM best), few AS (SELECT * FROM rated WHERE rating <= 2 ORDER BY query_id, rank LIMIT 5)
SELECT query_id, rank, cand_id, rating, {", ".join(f"{t}.{c} AS {n}_{c}" for t, n in (("q", "query"), ("c", "cand")) for c in ("conv_id", "state_index", "n_turns_available"))},
  {", ".join(f"left({t}.w1_text, 120) AS {n}_w1, 'summary: ' || left({t}.w_summary_text, 120) AS {n}_context" for t, n in (("q", "query"), ("c", "cand")))}
FROM few JOIN full_states q ON q.vec_id = query_id JOIN full_states c ON c.vec_id = cand_id""")
def failure_report(spark, sf):
    """The first five poorly rated matches of held-out states, with both states' contexts (a report of five rows)."""
    held = held_out(spark, sf).select(F.expr(STATE_ID).alias("vec_id"))
    rated = retrieved(spark, sf, held).withColumn("rating", rating(providers.judge_of(F.col("score"))))
    metadata = states.judge_context(summarised(spark, sf)).withColumnRenamed("vec_id", "state_id")
    return ratings.failures(rated, metadata, DEFAULTS.failures_shown, DEFAULTS.poor_rating)


@query(f"WITH {STATES}, numbered AS (SELECT conv_id, state_index, row_number() OVER (ORDER BY conv_id, state_index) - 1 AS i, count(*) OVER () AS n FROM states) SELECT conv_id, state_index FROM numbered WHERE i IN (n // 10, n // 2, (n * 9) // 10)")
def positional_picks(spark, sf):
    """The states a tenth, a half and nine tenths through the index, by selection and not by numbering all rows in one task."""
    keys = state_rows(spark, sf).select("conv_id", "state_index")
    sizes = keys.groupBy("conv_id").agg(F.count("*").alias("n"))
    bands = sizes.withColumn("band", F.floor(F.col("conv_id") / 1024)).groupBy("band").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = bands.select("band", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rows = keys.withColumn("band", F.floor(F.col("conv_id") / 1024))
    within = F.row_number().over(Window.partitionBy("band").orderBy("conv_id", "state_index")) - 1
    rows = rows.withColumn("within", within).join(starts, "band").withColumn("i", F.col("before") + F.col("within"))
    n = F.col("total")
    return rows.where((F.col("i") == F.floor(n / 10)) | (F.col("i") == F.floor(n / 2)) | (F.col("i") == F.floor(n * 9 / 10))).select("conv_id", "state_index")


# --- ratings and caches -----------------------------------------------------------------------------------------------
_ANSWERS = ["4", " 4\n", "+4", "9", "0", "-3", "4/5", "", "five", "1", "2", "3", "5", "4 5"]


@query("SELECT answer, CASE WHEN regexp_matches(answer, '^\\s*[-+]?[0-9]+\\s*$') THEN greatest(1, least(5, trim(answer, ' ' || chr(10))::INT)) ELSE 3 END::INT AS rating FROM (VALUES " + ", ".join("('" + a.replace("\n", "' || chr(10) || '") + "')" for a in _ANSWERS) + ") AS t(answer)")
def judge_parse(spark, sf):
    return spark.createDataFrame([(a,) for a in _ANSWERS], "answer string").withColumn("rating", rating(F.col("answer")))


_CACHE = "SELECT (conv_id % 37)::VARCHAR AS key, (turn % 5 + 1)::INT AS rating, conv_id * 100 + turn AS seq FROM conversations"


def cache(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select((F.col("conv_id") % 37).cast("string").alias("key"), (F.col("turn") % 5 + 1).cast("int").alias("rating"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"))


@query(f"WITH c AS ({_CACHE}) SELECT key, arg_max(rating, seq) AS rating FROM c GROUP BY 1")
def cache_dedupe(spark, sf):
    return ratings.latest(cache(spark, sf), "key", "rating")


@query(f"WITH c AS ({_CACHE}) SELECT key, arg_max(rating, seq) AS rating FROM c GROUP BY 1")
def cache_round_trip(spark, sf):
    """An append-only cache written in two appends and read again; the last write of a key wins."""
    path, rows = io.scratch(spark, "cache"), cache(spark, sf)
    io.append_cache(rows.where("seq % 2 = 0"), path)
    io.append_cache(rows.where("seq % 2 = 1"), path)
    return io.read_cache(spark, path, "rating", "key string, rating int, seq long")


@query(f"WITH c AS ({_CACHE}) SELECT DISTINCT (conv_id % 50)::VARCHAR AS key FROM conversations WHERE (conv_id % 50)::VARCHAR NOT IN (SELECT key FROM c)")
def cache_misses(spark, sf):
    wanted = table(spark, sf, "conversations").select((F.col("conv_id") % 50).cast("string").alias("key")).distinct()
    return ratings.misses(wanted, cache(spark, sf), ["key"])


@query(f"WITH c AS (SELECT key, arg_max(rating, seq) AS rating FROM ({_CACHE}) GROUP BY 1), w AS (SELECT DISTINCT (conv_id % 50)::VARCHAR AS key FROM conversations) SELECT key, coalesce(rating, length(key))::INT AS rating FROM w LEFT JOIN c USING (key)")
def cache_fill(spark, sf):
    """Cached ratings, and a provider's for the misses."""
    wanted = table(spark, sf, "conversations").select((F.col("conv_id") % 50).cast("string").alias("key")).distinct()
    known = ratings.latest(cache(spark, sf), "key", "rating")
    return ratings.fill(wanted, known, ["key"], lambda misses: misses.withColumn("rating", F.length("key")))


# --- weight search ----------------------------------------------------------------------------------------------------
_SHARE = HASH.format("'42|' || trial || '|' || \"window\"") + " / 4294967296.0::DOUBLE"
TRIALS = f"""drawn AS (SELECT trial::INT AS trial, w."window", round(0.01::DOUBLE + {_SHARE} * 9.99::DOUBLE, 6) AS raw FROM range({{n}}) t(trial), unnest({PARTS!r}) AS w("window")),
weights AS (SELECT *, round(raw / sum(raw) OVER (PARTITION BY trial), 4) AS weight FROM drawn)"""


def sims_sql(at: int, name: str = "rated") -> str:
    """A table of rated pairs: queries whose id leaves ``at``, against all rows of other labels."""
    sims = ", ".join(f"list_inner_product(q.n{j}, c.n{j}) AS sim_{p}" for j, p in enumerate(PARTS))
    mean = " + ".join(f"round(sim_{p}, 6)" for p in PARTS)
    return f"""{name} AS (SELECT *, (1 + floor(4 * greatest(0, least(1, ({mean}) / 8 + 0.3))))::INT AS rating FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS cand_id, {sims} FROM units q, units c WHERE q.vec_id % {EVERY} = {at} AND q.label <> c.label))"""


def results_sql(name: str, pairs: str, weights: str) -> str:
    total = " + ".join(f"w_{p}" for p in PARTS)
    score = " + ".join(f"(w_{p} / ({total})) * sim_{p}" for p in PARTS)
    return f"""{name} AS (SELECT trial, query_id, row_number() OVER (PARTITION BY trial, query_id ORDER BY score DESC, cand_id)::INT AS rank, cand_id, score, rating
  FROM (SELECT trial, query_id, cand_id, rating, round({score}, 6) AS score FROM {pairs}, {weights}) QUALIFY rank <= 5)"""


_WIDE = "wide AS (SELECT trial, " + ", ".join(f"first(weight) FILTER (\"window\" = '{p}') AS w_{p}" for p in PARTS) + " FROM weights GROUP BY trial)"
N_TRIALS = 50
SEARCH = f"{UNITS}, {sims_sql(0)}, {TRIALS.format(n=N_TRIALS)}, {_WIDE}, {results_sql('results', 'rated', 'wide')}, vals AS (SELECT trial, round(avg(rating), 6) AS value, count(*) AS n_ratings FROM results GROUP BY trial)"


def judge():
    """The stand-in judge's answer to a pair, as text, parsed."""
    mean = sum((F.col(f"sim_{p}") for p in PARTS), F.lit(0.0)) / len(PARTS) + F.lit(0.3)
    return rating(providers.judge_of(mean))


def trials(spark, n: int = N_TRIALS) -> DataFrame:
    return ratings.trial_weights(spark.range(n).select(F.col("id").cast("int").alias("trial")), PARTS, DEFAULTS.eval_seed, *DEFAULTS.weight_range)


def searched(spark, sf, at: int = 0, weights: DataFrame | None = None, cache: str | None = None) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return ratings.search(e.where(F.col("vec_id") % EVERY == at), e, trials(spark) if weights is None else weights, PARTS, judge(), DEFAULTS.top_k, cache)


@query(f"WITH {TRIALS.format(n=N_TRIALS)} SELECT * FROM weights")
def weight_trials(spark, sf):
    return trials(spark)


@query(f"WITH {SEARCH} SELECT * FROM vals")
def weight_search(spark, sf):
    return ratings.trial_values(searched(spark, sf))


@query(f"WITH {SEARCH}, pairs AS (SELECT count(*) AS cache_size FROM (SELECT DISTINCT query_id, cand_id FROM results)) SELECT * FROM vals, pairs")
def weight_search_cached(spark, sf):
    """The search in two sessions over one rating cache: the judge sees only pairs that the cache lacks."""
    path = io.scratch(spark, "ratings")
    searched(spark, sf, weights=trials(spark, 10), cache=path)
    values = ratings.trial_values(searched(spark, sf, cache=path))
    return values.withColumn("cache_size", F.lit(ratings.cached(spark, path).count()).cast("long"))


@query(f"WITH {SEARCH}, top AS (SELECT trial FROM vals ORDER BY value DESC, trial LIMIT 1) SELECT \"window\", weight, repeat('#', floor(weight * 50)::INT) AS bar FROM weights JOIN top USING (trial)")
def best_weights(spark, sf):
    best = ratings.best_trial(ratings.trial_values(searched(spark, sf)))
    chosen = trials(spark).join(best.select("trial"), "trial", "left_semi").select("window", "weight")
    return reports.bars(chosen).orderBy(F.col("weight").desc(), "window")


@query(f"WITH {SEARCH} SELECT rating, count(*) AS n FROM results GROUP BY 1")
def rating_histogram(spark, sf):
    return searched(spark, sf).groupBy("rating").agg(F.count("*").alias("n"))


@query(f"WITH {SEARCH} SELECT trial, query_id, rank, cand_id, rating FROM results WHERE rating <= 2 ORDER BY trial, query_id, rank LIMIT 5")
def poor_matches(spark, sf):
    """The first few of the matches that were rated low (a report of five rows)."""
    return ratings.poor(searched(spark, sf), DEFAULTS.poor_rating, DEFAULTS.failures_shown).select("trial", "query_id", "rank", "cand_id", "rating")


@query(f"WITH {SEARCH} SELECT CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'hard_negative' END AS pair, count(DISTINCT query_id * 1000000 + cand_id) AS n FROM results WHERE rating <> 3 GROUP BY 1")
def training_pairs(spark, sf):
    pairs = ratings.training_pairs(searched(spark, sf)).select("pair", "query_id", "cand_id").distinct()
    return pairs.groupBy("pair").agg(F.count("*").alias("n"))


@query(f"""WITH {SEARCH}, top AS (SELECT trial FROM vals ORDER BY value DESC, trial LIMIT 1), {sims_sql(10, "judged")},
pair AS (SELECT 1 AS trial, {", ".join(f"w_{p}" for p in PARTS)} FROM wide JOIN top USING (trial) UNION ALL SELECT 0 AS trial, {", ".join("0.125::DOUBLE" for _ in PARTS)}),
{results_sql("compared", "judged", "pair")}
SELECT query_id, round(avg(rating) FILTER (trial = 1), 6) AS optimised, round(avg(rating) FILTER (trial = 0), 6) AS uniform, round(avg(rating) FILTER (trial = 1) - avg(rating) FILTER (trial = 0), 6) AS delta FROM compared GROUP BY 1""")
def holdout_compare(spark, sf):
    """Mean ratings of held-out queries under the best weights and under uniform ones."""
    best = ratings.best_trial(ratings.trial_values(searched(spark, sf))).select("trial")
    chosen = trials(spark).join(best, "trial", "left_semi").select(F.lit(1).alias("trial"), "window", "weight")
    flat = spark.createDataFrame([(0, p, 1 / len(PARTS)) for p in PARTS], "trial int, window string, weight double")
    rows = searched(spark, sf, 10, chosen.unionByName(flat))
    mean = lambda t: F.avg(F.when(F.col("trial") == t, F.col("rating")))
    return rows.groupBy("query_id").agg(F.round(mean(1), 6).alias("optimised"), F.round(mean(0), 6).alias("uniform"), F.round(mean(1) - mean(0), 6).alias("delta"))


@query(f"WITH {TRIALS.format(n=12)} SELECT trial, max(weight) AS value, count(*) AS n_ratings, 38 AS n_remaining FROM weights GROUP BY trial")
def study_resume(spark, sf):
    """Trials appended to a study in two sessions and read again, with how many of fifty are left."""
    path = io.scratch(spark, "study")
    rows = trials(spark, 12).groupBy("trial").agg(F.max("weight").alias("value"), F.count("*").alias("n_ratings"))
    io.append_trials(rows.where("trial < 5"), path)
    io.append_trials(rows.where("trial >= 5"), path)
    done = spark.read.schema(io.TRIALS).parquet(path)
    return done.withColumn("n_remaining", F.lit(ratings.remaining(done, DEFAULTS.trials)))
