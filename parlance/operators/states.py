"""Decision states: after each customer utterance that something follows, with nested look-back windows.

Windows are slices of the conversation's line array, made once per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.config import WINDOWS, marker

ORDER = ("w_0", *WINDOWS, "w_full", "w_summary")


def states(df: DataFrame, min_turns: int = 2, keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """One row per state of each conversation with ``min_turns`` turns; state_index counts from 0 in a conversation."""
    df = df.where(F.size("turns") >= min_turns)
    lines = F.expr(f"transform(turns, t -> concat(if(t.speaker = 'agent', '{marker('agent')}', '{marker('customer')}'), t.text))")
    at = F.expr("filter(sequence(0, size(turns) - 2), i -> turns[i].speaker = 'customer')")
    rows = df.select(*keep, "turns", lines.alias("lines"), F.posexplode(at).alias("state_index", "pos"))
    texts = {"w_0_text": "turns[pos].text"} | {f"{w}_text": f"array_join(slice(lines, greatest(1, pos + 2 - {n}), least({n}, pos + 1)), '\\n')" for w, n in WINDOWS.items()} | {"w_full_text": "array_join(slice(lines, 1, pos + 1), '\\n')"}
    return rows.select(*keep, "state_index", F.col("pos").alias("state_turn_idx"), F.expr("turns[pos + 1].text").alias("agent_response"), F.expr("turns[pos + 1].index").alias("agent_response_turn_idx"), *[F.expr(v).alias(k) for k, v in texts.items()], F.expr("pos + 1").alias("n_turns_available"))


def segments(df: DataFrame, keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Disjoint stretches before each state: the current turn, the 3 before it, the 6 before those, and all the rest."""
    at = F.expr("filter(sequence(0, size(turns) - 2), i -> turns[i].speaker = 'customer')")
    rows = df.where("size(turns) >= 2").select(*keep, F.transform("turns", lambda t: t.text).alias("lines"), F.explode(at).alias("pos"))
    cut = lambda hi, n: f"array_join(slice(lines, greatest(1, pos + 2 - {hi + n}), greatest(0, pos + 2 - {hi} - greatest(1, pos + 2 - {hi + n}))), '\\n')"
    return rows.select(*keep, "pos", F.expr("lines[pos]").alias("s0"), F.expr(cut(1, 3)).alias("s1"), F.expr(cut(4, 6)).alias("s2"), F.expr("array_join(slice(lines, 1, greatest(0, pos - 9)), '\\n')").alias("s3"))


def summary_prompt(df: DataFrame) -> DataFrame:
    """Adds the summariser's prompt over the whole conversation so far."""
    fields = "need, product, objections, promises, mood, next step"
    return df.withColumn("summary_prompt", F.concat(F.lit(f"Summarise the conversation in six fields ({fields}).\n\n"), F.col("w_full_text")))


def judge_context(df: DataFrame) -> DataFrame:
    """Adds the text a judge sees of a state: the last turns, then a summary or else the whole conversation."""
    summary = F.col("w_summary_text") if "w_summary_text" in df.columns else F.lit(None).cast("string")
    second = F.coalesce(F.concat(F.lit("Summary:\n"), summary), F.concat(F.lit("Full context:\n"), F.col("w_full_text")))
    brief = F.coalesce(F.concat(F.lit("summary: "), F.substring(summary, 1, 120)), F.concat(F.lit("full:    "), F.substring("w_full_text", 1, 120)), F.lit(""))
    return df.withColumns({"judge_context": F.concat_ws("\n\n", F.concat(F.lit("Recent turns:\n"), F.col("w3_text")), second), "secondary_context": brief})


def pair_prompt(a: str, b: str) -> Column:
    """A judge's prompt about the states whose contexts are in columns ``a`` and ``b``; it asks for one number."""
    ask = "Would the same reply of the agent serve both of these states? Answer with one number from 1 (not at all) to 5 (fully)."
    return F.concat(F.lit(ask + "\n\nFirst state:\n"), F.col(a), F.lit("\n\nSecond state:\n"), F.col(b))


def windows_long(df: DataFrame, names: tuple[str, ...] = ORDER, keep: tuple[str, ...] = ("conv_id", "state_index")) -> DataFrame:
    """(keep, window, text), one row per window."""
    pairs = ", ".join(f"'{w}', {w}_text" for w in names)
    return df.select(*keep, F.expr(f"stack({len(names)}, {pairs}) as (window, text)"))
