"""Compliance: flag texts by rules, keep an audit trail; top documents into a context block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def context_of(matches: DataFrame, texts: DataFrame, shown: int = 80) -> DataFrame:
    """(query_id, context): the first ``shown`` characters of each query's matches (query_id, rank, cand_id), best first.

    ``texts`` has cand_id and text. The number of matches of a query is the search's k.
    """
    rows = matches.join(texts.select("cand_id", F.substring("text", 1, shown).alias("shown")), "cand_id")
    best = F.transform(F.sort_array(F.collect_list(F.struct("rank", "shown"))), lambda r: r.shown)
    return rows.groupBy("query_id").agg(F.array_join(best, "\n").alias("context"))


def audit(texts: DataFrame, rules: dict[str, str], column: str = "text") -> DataFrame:
    """Adds n_rules, broken (names of matched rules, joined) and blocked; rules are regular expressions, a bounded list."""
    hits = F.filter(F.array(*[F.when(F.col(column).rlike(p), F.lit(name)) for name, p in rules.items()]), lambda x: x.isNotNull())
    return texts.withColumn("broken", F.array_join(hits, ",")).withColumn("n_rules", F.size(hits)).withColumn("blocked", F.col("n_rules") > 0)
