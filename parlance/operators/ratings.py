"""Ratings: append-only caches, weight search in one pass over all trials, hold-out comparison, failures, pairs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import hash32, rounded
from parlance.operators.vectors import breakdown, topk_trials


def latest(cache: DataFrame, key: str, value: str, order: str = "seq") -> DataFrame:
    """Last write per key wins."""
    return cache.groupBy(key).agg(F.max_by(value, order).alias(value))


def misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(cache, keys, "left_anti")


def fill(wanted: DataFrame, cache: DataFrame, keys: list[str], provider) -> DataFrame:
    """Cached rows for ``wanted`` and what ``provider`` gives for the distinct misses."""
    made = provider(misses(wanted.select(keys).distinct(), cache, keys))
    return wanted.join(cache.unionByName(made), keys, "left")


def trial_weights(trials: DataFrame, names: list[str], seed: int = 42, low: float = 0.01, high: float = 10.0) -> DataFrame:
    """(trial, window, raw, weight): uniform raw weights by hash, normalised per trial and rounded to 4 places."""
    windows = F.explode(F.array(*map(F.lit, names))).alias("window")
    rows = trials.select("trial", windows)
    share = hash32(F.concat_ws("|", F.lit(str(seed)), F.col("trial").cast("string"), F.col("window"))) / F.lit(4294967296.0)
    rows = rows.withColumn("raw", F.round(F.lit(low) + share * F.lit(high - low), 6))
    return rows.withColumn("weight", F.round(F.col("raw") / F.sum("raw").over(Window.partitionBy("trial")), 4))


def search(queries: DataFrame, candidates: DataFrame, weights: DataFrame, names: list[str], judge: Column, k: int = 5, cache: str | None = None, **options) -> DataFrame:
    """(trial, query_id, rank, cand_id, score, rating) of every trial.

    With a ``cache`` (a path of appended ratings) the judge sees only the pairs that it lacks, and their ratings are
    appended; the next search finds them there.

    All trials' retrievals are one job, in which each partition keeps its best k of a trial and query; the judge sees
    every distinct pair once. ``weights`` (trial, window, weight) is a bounded table of stated trials; ``judge`` reads
    the columns sim_<window> of a pair.
    """
    trials: dict[int, dict[str, float]] = {}
    for r in weights.select("trial", "window", "weight").collect():
        trials.setdefault(r["trial"], {})[r["window"]] = r["weight"]
    best = topk_trials(queries, candidates, trials, names, k, **options)
    wanted = best.select("query_id", "cand_id").distinct()
    if cache:
        wanted = wanted.join(cached(best.sparkSession, cache), ["query_id", "cand_id"], "left_anti")
    rated = breakdown(wanted, queries, candidates, names).select("query_id", "cand_id", judge.alias("rating"))
    if cache:
        keys = [pair_key(F.col("query_id"), F.col("cand_id")).alias("key"), "rating", F.col("query_id").alias("query_idx"), F.col("cand_id").alias("candidate_idx")]
        rated.select(*keys, F.lit(0).cast("long").alias("seq")).write.mode("append").option("ignoreNullFields", "false").json(cache)
        rated = cached(best.sparkSession, cache)
    return best.join(rated, ["query_id", "cand_id"]).select(F.col("trial").cast("int").alias("trial"), "query_id", "rank", "cand_id", "score", "rating")


RATINGS = "key string, rating int, query_idx long, candidate_idx long, seq long"


def pair_key(query: Column, candidate: Column) -> Column:
    """Key of a rated pair."""
    return F.concat_ws("_", query.cast("string"), candidate.cast("string"))


def state_key(conversation: Column, index: Column) -> Column:
    """Key of a state's summary."""
    return F.concat_ws("|", conversation.cast("string"), index.cast("string"))


def cached(spark, path: str) -> DataFrame:
    """(query_id, cand_id, rating) of a rating cache, the last write of each pair; empty before the first write."""
    try:
        rows = spark.read.schema(RATINGS).json(path)
        rows.schema  # noqa: B018
    except AnalysisException:
        rows = spark.createDataFrame([], RATINGS)
    return rows.groupBy("query_idx", "candidate_idx").agg(F.max_by("rating", "seq").alias("rating")).toDF("query_id", "cand_id", "rating")


def failures(results: DataFrame, metadata: DataFrame, shown: int | None = None, limit: int = 2) -> DataFrame:
    """Pairs rated ``limit`` or less with both states' conversation, index, turns, recent turns and secondary context.

    ``metadata`` has state_id and what ``states.judge_context`` adds; the first ``shown`` by query and rank.
    """
    rows = results.where(F.col("rating") <= limit).select("query_id", "rank", "cand_id", "rating")
    rows = rows.orderBy("query_id", "rank").limit(shown) if shown else rows
    of = lambda side: metadata.select(F.col("state_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in ("conv_id", "state_index", "n_turns_available")], F.substring("w1_text", 1, 120).alias(f"{side}_w1"), F.col("secondary_context").alias(f"{side}_context"))
    return rows.join(of("query"), "query_id").join(of("cand"), "cand_id")


def trial_values(results: DataFrame) -> DataFrame:
    """(trial, value, n_ratings)."""
    return results.groupBy("trial").agg(rounded(F.avg("rating"), 6).alias("value"), F.count("*").alias("n_ratings"))


def best_trial(values: DataFrame) -> DataFrame:
    """The trial of the largest value, the lowest number among equals."""
    return values.orderBy(F.col("value").desc(), "trial").limit(1)


def remaining(trials_done: DataFrame, n: int) -> int:
    return max(0, n - trials_done.count())


def poor(results: DataFrame, limit: int = 2, shown: int | None = None) -> DataFrame:
    rows = results.where(F.col("rating") <= limit)
    return rows.orderBy("trial", "query_id", "rank").limit(shown) if shown else rows


def training_pairs(results: DataFrame) -> DataFrame:
    """Rated pairs as training pairs: 4 and 5 positive, 1 and 2 hard negative, 3 unused."""
    kind = F.when(F.col("rating") >= 4, "positive").when(F.col("rating") <= 2, "hard_negative")
    return results.withColumn("pair", kind).where("pair is not null")
