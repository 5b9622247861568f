"""Stratified samples of states, seeded by hash: equal in every run and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import hash32


def draw(key: Column, seed: int) -> Column:
    return hash32(F.concat_ws("|", F.lit(str(seed)), key))


def several_states(states: DataFrame) -> DataFrame:
    """States of conversations that have more than one."""
    return states.withColumn("n_states", F.count("*").over(Window.partitionBy("conv_id"))).where("n_states > 1")


def bins(states: DataFrame, cuts: tuple[float, float] = (0.33, 0.67)) -> DataFrame:
    """Adds position, position_bin (right-closed cuts), length_bin (terciles of n_states over states) and stratum.

    Terciles whose edges collapse leave fewer bins.
    """
    rows = states.withColumn("position", F.col("state_index") / F.greatest(F.max("state_index").over(Window.partitionBy("conv_id")), F.lit(1)))
    rows = rows.withColumn("position_bin", F.when(F.col("position") <= cuts[0], "early").when(F.col("position") <= cuts[1], "mid").otherwise("late"))
    edges = rows.agg(F.percentile("n_states", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("edges")).select(F.col("edges")[0].alias("low"), F.col("edges")[1].alias("high"))
    rows = rows.crossJoin(F.broadcast(edges))  # one row
    rows = rows.withColumn("length_bin", F.when(F.col("n_states") <= F.col("low"), "short").when(F.col("n_states") <= F.col("high"), "medium").otherwise("long")).drop("low", "high")
    return rows.withColumn("stratum", F.concat_ws("_", "position_bin", "length_bin"))


def sample(states: DataFrame, n: int, seed: int, key: Column, by: str = "stratum") -> DataFrame:
    """``n`` rows: per stratum its share max(1, n // strata) first, then a top-up, all by hash order.

    Ranks within a stratum are cut at n per partition before the shuffle (a window group limit), so a large stratum
    sends no more than n rows of a partition to one task.
    """
    strata = states.agg(F.count_distinct(by).alias("strata")).select(F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest("strata", F.lit(1)))).alias("per"))
    ranked = states.withColumn("draw", draw(key, seed)).withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("draw", "conv_id", "state_index"))).where(F.col("nth") <= n)
    rows = ranked.crossJoin(F.broadcast(strata))  # one row
    return rows.orderBy((F.col("nth") <= F.col("per")).desc(), "draw", "conv_id", "state_index").limit(n).drop("nth", "per")


def holdout(states: DataFrame, chosen: DataFrame, n: int, seed: int, key: Column) -> DataFrame:
    """A stratified sample of ``n`` states under its own seed, less those already chosen; may leave fewer."""
    return sample(states, n, seed, key).join(chosen.select("conv_id", "state_index"), ["conv_id", "state_index"], "left_anti")
