"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Only DataFrame functions. Sources meet their weights in one narrow table; documents are only ever aggregated into
histograms over a seeded hash, so a source with most of the rows costs no task more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm._common import WORD_RX, materialise, shielded

SEED, BINS = "mix-2026", 1024


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_RX)), F.lit(0)).cast("long")


def draw_of(seed: str) -> Column:
    """A seeded hash of the document's id, or of its text where it has none."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce("text", F.lit(""))))
    return F.md5(F.concat_ws(":", F.lit(seed), key).cast("binary"))


def water_fill(sources: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target): targets by weight that sum to ``share`` of all sizes, none above max_epochs sizes.

    The fill level is found in closed form: with sources in ascending order of cap by weight, the first k are clamped
    where the level that the others then share does not pass the next one's. That is where repeated resharing of the
    excess ends. Sources by code point, null last, take ``weights`` in turn. Feasible if share <= max_epochs.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    caps = sources.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int")).cast("double").alias("weight"))
    caps = caps.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    caps = caps.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "goal": F.sum("source_size").over(whole) * F.lit(float(share)), "weights": F.sum("weight").over(whole)})
    level = (F.col("goal") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    caps = caps.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("weight_before", "level"))).over(whole)
    return caps.withColumn("level", first["level"]).select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), "cap").alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and draw (its seeded hash) of every row.

    A source of target t and size s takes every document floor(t / s) times whole. Of the rest, a part of a repetition,
    it takes documents in the order of a seeded hash until the target is met; the document in which it is met gives
    its first words only. So each source takes its target, rounded down to a word. Where t = s * max_epochs the rest
    is nothing. The threshold is found by two levels of histograms of the hash, then among a millionth of the source's
    rows. Null texts have size 0 and null sources form one source, the last. Rows with a null doc_id draw by their
    text. Repeated rows are told apart by their count: identical rows stand side by side in the order.
    """
    sized = materialise(docs.select(F.col("doc_id").cast("long"), "source", word_count().alias("size"), draw_of(seed).alias("draw")), "sizes")
    sized = sized.withColumns({"bin": F.conv(F.substring("draw", 1, 5), 16, 10).cast("int"), "key": F.struct("draw", "doc_id", "size")})
    sized = sized.withColumns({"bin2": F.col("bin") % BINS, "bin1": F.floor(F.col("bin") / BINS).cast("int")})

    first = materialise(sized.groupBy("source", "bin1").agg(F.sum("size").alias("words")), "bins")
    sources = first.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = water_fill(sources, list(weights), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = materialise(plan.withColumn("whole", whole).withColumn("rest", (F.floor(F.col("target")) - F.col("whole") * F.col("source_size")).cast("long")), "mix-plan")

    def boundary(bins: DataFrame, column: str, limits: DataFrame) -> DataFrame:
        """source, the bin in which the rest is met, and the rest that is left on entering it."""
        up_to = F.sum("words").over(Window.partitionBy("source").orderBy(column))
        met = by_source(bins, limits)
        met = met.withColumn("up_to", up_to).where("up_to > rest")
        return met.groupBy("source").agg(F.min(F.struct(F.col(column), (F.col("rest") - F.col("up_to") + F.col("words")).alias("rest"))).alias("at")).select("source", f"at.{column}", "at.rest")

    edge1 = materialise(boundary(first, "bin1", plan.select("source", "rest")), "mix-edge")
    tagged = by_source(by_source(sized, plan, "left"), edge1.select("source", F.col("bin1").alias("edge1")), "left")
    within = by_source(sized, edge1, on=["bin1"])
    second = within.groupBy("source", "bin2").agg(F.sum("size").alias("words"))
    edge2 = materialise(boundary(second, "bin2", edge1.select("source", "rest")), "mix-edge")
    last = by_source(within.drop("rest"), edge2, on=["bin2"])
    order = Window.partitionBy("source").orderBy(F.col("draw"), F.col("doc_id"), F.col("size"))
    last = last.withColumns({"before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), "nth": F.row_number().over(order)})
    last = last.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.coalesce("before", F.lit(0)))))
    last = materialise(last.select("doc_id", "source", "size", "draw", "part"), "mix-last")

    tagged = by_source(tagged, edge2.select("source", F.col("bin2").alias("edge2")), "left")
    here = (F.col("bin1") == F.col("edge1")) & (F.col("bin2") == F.col("edge2"))
    taken = F.when(F.col("edge1").isNull(), F.when(F.col("rest") > 0, F.col("size")).otherwise(0))
    taken = taken.when(F.col("bin1") != F.col("edge1"), F.when(F.col("bin1") < F.col("edge1"), F.col("size")).otherwise(0))
    taken = taken.otherwise(F.when(F.col("bin2") < F.col("edge2"), F.col("size")).otherwise(0))
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "draw"]
    inside = F.coalesce(here, F.lit(False))
    sure = tagged.where(~inside).select(*columns, taken.alias("part"))
    near = by_source(last, plan).select(*columns, "part")
    out = sure.unionByName(near)
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("whole") * F.col("size") + F.coalesce("part", F.lit(0))).cast("long").alias("taken"), "draw")


#: Tables with at most this many rows are broadcast; larger ones are joined by key, where skew is split at run time.
BROADCAST_ROWS = 50_000


def by_source(left: DataFrame, right: DataFrame, how: str = "inner", on: list[str] | None = None) -> DataFrame:
    """``left`` joined to a narrow table by source (null equals null) and the columns ``on``.

    The table is broadcast if a count finds it small; it holds one row of a source, or one for each of its bins.
    """
    right = right.withColumnsRenamed({c: f"__{c}" for c in ["source", *(on or [])]})
    same = F.col("source").eqNullSafe(F.col("__source"))
    for c in on or []:
        same &= F.col(c) == F.col(f"__{c}")
    right = F.broadcast(right) if right.count() <= BROADCAST_ROWS else right
    return left.join(right, same, how).drop("__source", *(f"__{c}" for c in on or []))


def sampled(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: each row as often as the mix takes it, rounded to whole texts.

    Rows without a word are taken once. Repeated rows are taken alike. Further columns of any name stay as they are.
    """
    safe = shielded(docs, "doc_id", "text", "source")
    shares = mix(safe, seed=seed, **options).groupBy("draw", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size") / F.col("rows"))).otherwise(1).cast("int")
    shares = shares.select("draw", "size", times.alias("times")).where("times > 0")
    rows = safe.withColumns({"draw": draw_of(seed), "size": word_count()}).join(shares, ["draw", "size"])
    return rows.select(*safe.columns, F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).drop("copy").toDF(*docs.columns)


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS size, md5('mix-2026:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(text, ''))) AS draw
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM sources
), running AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before, sum(source_size) OVER () * 1.5::DOUBLE AS goal, sum(weight) OVER () AS weights
  FROM weighted WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (goal - cap_before) / (weights - weight_before) AS level FROM running
), chosen AS (
  SELECT level FROM levels WHERE level <= cap / weight ORDER BY weight_before LIMIT 1
), plan AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM chosen)) AS target FROM levels
), parts AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan
), placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, CAST(floor(p.target) AS BIGINT) - p.whole * p.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM placed
"""
