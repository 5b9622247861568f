"""Reports as DataFrames: lengths, percentiles, histograms, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def length_stats(df: DataFrame, *columns: str) -> DataFrame:
    """(measure, n, least, most, mean), one row per column."""
    stacked = df.select(F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', {c}" for c in columns) + ") as (measure, v)"))
    return stacked.groupBy("measure").agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 6).alias("mean"))


def percentiles(df: DataFrame, column: str, at: tuple[int, ...] = (50, 75, 90, 95, 99, 100)) -> DataFrame:
    """(percentile, value): exact, linear between neighbours, truncated."""
    values = df.agg(F.percentile(column, F.array(*[F.lit(p / 100) for p in at])).alias("v"))
    return values.select(F.posexplode(F.col("v")).alias("i", "x")).select(F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("percentile"), F.col("x").cast("long").alias("value"))


def over_budget(df: DataFrame, column: str, limit: int) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(column) > limit).alias("n_over"), F.round(F.try_divide(F.count_if(F.col(column) > limit), F.count("*")), 6).alias("share_over"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin from 1, n): equal bins over the range; the largest value falls into the last. Empty bins have no row."""
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    rows = df.select(column).crossJoin(F.broadcast(span))  # one row
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col(column) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1))
    return rows.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    p = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    row = df.agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("std"), F.min(column).alias("least"), F.max(column).alias("most"), p.alias("p"))
    return row.select("n", "mean", "std", "least", F.round(F.col("p")[0], 6).alias("p25"), F.round(F.col("p")[1], 6).alias("p50"), F.round(F.col("p")[2], 6).alias("p75"), "most")


def tercile_intervals(df: DataFrame, column: str, parts: int = 3) -> DataFrame:
    """(interval, n): rows between quantiles, as `(low, high]`; edges that are equal make one; the first holds the least."""
    edges = df.agg(F.array_distinct(F.percentile(column, F.array(*[F.lit(i / parts) for i in range(parts + 1)]))).alias("e"))
    rows = df.select(F.col(column).cast("double").alias("v")).where("v is not null").crossJoin(F.broadcast(edges))  # one row
    at = F.expr("greatest(1, size(filter(e, x -> x < v)))")
    shown = lambda i: F.round(F.expr(f"e[{i}]"), 3).cast("decimal(18,3)").cast("string")
    rows = rows.withColumn("i", F.least(F.expr("greatest(size(e) - 1, 1)"), at))
    low = F.when(F.col("i") == 1, (F.expr("e[0]") - 0.001).cast("decimal(18,3)").cast("string")).otherwise(shown("i - 1"))
    return rows.withColumn("interval", F.concat(F.lit("("), low, F.lit(", "), F.coalesce(shown("i"), shown("0")), F.lit("]"))).groupBy("interval").agg(F.count("*").alias("n"))


def bars(weights: DataFrame, width: int = 50) -> DataFrame:
    return weights.withColumn("bar", F.repeat(F.lit("#"), F.floor(F.col("weight") * width).cast("int")))
