"""Transcripts: parse, validate, repair, filter. One row per conversation, turns as an array; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import TURN, integer, strip

TURNS = "array<struct<speaker:string,index:int,text:string>>"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def from_messages(conversations: DataFrame) -> DataFrame:
    """Turn rows (conv_id, pos, speaker, text) of a role-based message table: user is the customer, assistant the agent.

    System messages are dropped; any other role, null too, raises when it is read. Line feeds become spaces, as a
    transcript has one turn a line.
    """
    from pyspark.sql import Window

    rows = conversations.where("role is distinct from 'system'")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    speaker = F.when(F.col("role") == "user", "customer").when(F.col("role").isin("assistant", "agent"), "agent").otherwise(F.col("role"))
    rows = check_speakers(rows.withColumn("speaker", speaker))
    return rows.select("conv_id", pos.alias("pos"), "speaker", strip(F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"))


def collect_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) from turn rows; a conversation is as long as its turns, however many conversations there are."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "speaker", "text")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t.speaker.alias("speaker"), (t.pos + 1).cast("int").alias("index"), t.text.alias("text"))).alias("turns"))


def render(turns: str = "turns") -> Column:
    return F.expr(f"array_join(transform({turns}, t -> concat(t.speaker, '(u', t.index, '): ', t.text)), '\\n')")


def parse(df: DataFrame, column: str = "transcript") -> DataFrame:
    """Adds ``turns``: all matches in text order, not sorted by number. A null transcript has no turns."""
    text = F.coalesce(F.col(column), F.lit(""))
    parts = [F.regexp_extract_all(text, F.lit(TURN), F.lit(g)) for g in (1, 2, 3)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("speaker", "index", "text"), strict=True)])
    turns = F.transform(zipped, lambda t: F.struct(t["speaker"].alias("speaker"), integer(t["index"]).alias("index"), strip(t["text"]).alias("text")))
    return df.withColumn("turns", turns)


def alternates(turns: str = "turns") -> Column:
    """Agents at even and customers at odd positions."""
    return F.expr(f"forall(transform({turns}, (t, i) -> t.speaker = if(i % 2 = 0, 'agent', 'customer')), x -> x)")


def validate(df: DataFrame, min_turns: int = 4) -> DataFrame:
    """Adds n_turns, alternates, status (OK or WARN) and a preview of the first turn's text."""
    line = F.expr("get(turns, 0).text")
    short = F.when(F.length(line) > 60, F.concat(F.substring(line, 1, 60), F.lit("..."))).otherwise(line)
    df = df.withColumns({"n_turns": F.size("turns"), "alternates": alternates()})
    return df.withColumns({"status": F.when(F.col("alternates") & (F.col("n_turns") >= min_turns), "OK").otherwise("WARN"), "preview": F.when(F.col("n_turns") == 0, "N/A").otherwise(short)})


def repair(df: DataFrame, column: str = "transcript") -> DataFrame:
    """Adds ``repaired``: matched turns renumbered 1..n with speakers by parity; unchanged where nothing matches."""
    fixed = F.expr("array_join(transform(turns, (t, i) -> concat(if(i % 2 = 0, 'agent', 'customer'), '(u', i + 1, '): ', t.text)), '\\n')")
    return df.withColumn("repaired", F.when(F.size("turns") == 0, F.col(column)).otherwise(fixed))


def violations(repaired: DataFrame, min_turns: int = 4) -> DataFrame:
    """Rows of a repaired and re-parsed frame that break what repair promises; none should be left."""
    numbered = F.expr("forall(transform(turns, (t, i) -> t.index = i + 1), x -> x)")
    return repaired.where((F.size("turns") < min_turns) | ~alternates() | ~numbered)


def converted(df: DataFrame) -> DataFrame:
    return df.where(F.col("label") == 1)


def with_min_turns(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.size("turns") >= n)


def check_speakers(df: DataFrame) -> DataFrame:
    """Raises when a row is read whose speaker is neither agent nor customer."""
    ok = F.col("speaker").isin("agent", "customer")
    return df.withColumn("speaker", F.when(ok, F.col("speaker")).otherwise(F.raise_error(F.concat(F.lit("unknown speaker: "), F.coalesce("speaker", F.lit("null"))))))
