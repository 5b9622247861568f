"""What queries read: the message table as turns, transcripts, states and examples, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.config import CONTEXTS, SYSTEM_PROMPT, WINDOWS, marker
from parlance.functions.text import TOKEN
from parlance.operators import examples, states, transcripts

#: Stand-ins for the eight windows of an embedding of 64 dimensions.
PARTS = [f"p{j}" for j in range(8)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.collect_turns(transcripts.from_messages(table(spark, sf_dir, "conversations")))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, transcript)."""
    return turns(spark, sf_dir).select("conv_id", transcripts.render().alias("transcript"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse(rendered(spark, sf_dir))


def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.states(turns(spark, sf_dir))


def example_rows(spark: SparkSession, sf_dir: str, k: int = 20, min_tokens: int = 15) -> DataFrame:
    return examples.examples(turns(spark, sf_dir), k, min_tokens, id_column="conv_id")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


AGENT, CUSTOMER = marker("agent"), marker("customer")
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"

ROWS = f"""rows AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
    CASE WHEN role = 'user' THEN 'customer' ELSE 'agent' END AS speaker, {STRIP.format("replace(text, chr(10), ' ')")} AS text
  FROM conversations WHERE role IS DISTINCT FROM 'system'
), lined AS (
  SELECT *, CASE WHEN speaker = 'agent' THEN '{AGENT}' ELSE '{CUSTOMER}' END || text AS line FROM rows
)"""

TRANSCRIPTS = f"""{ROWS}, rendered AS (
  SELECT conv_id, string_agg(speaker || '(u' || (pos + 1) || '): ' || text, chr(10) ORDER BY pos) AS transcript FROM rows GROUP BY conv_id
)"""

_FRAME = "array_to_string(list(line) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN {} PRECEDING AND CURRENT ROW), chr(10)) AS {}_text"
STATES = f"""{ROWS}, framed AS (
  SELECT *, lead(text) OVER w AS agent_response, lead(pos) OVER w AS next_pos, text AS w_0_text,
    {", ".join(_FRAME.format(n - 1, w) for w, n in WINDOWS.items())}, {_FRAME.format("UNBOUNDED", "w_full")}
  FROM lined WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), states AS (
  SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::INT AS state_index, pos::INT AS state_turn_idx, agent_response,
    (next_pos + 1)::INT AS agent_response_turn_idx, w_0_text, {", ".join(f"{w}_text" for w in WINDOWS)}, w_full_text, (pos + 1)::INT AS n_turns_available
  FROM framed WHERE speaker = 'customer' AND agent_response IS NOT NULL
)"""


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, {quoted(TOKEN)})"


def context_sql(key: str) -> str:
    templates = "[" + ", ".join(map(quoted, CONTEXTS)) + "]"
    return f"CASE WHEN {HASH.format(f"'42|' || {key}")} % 10000 < 1500 THEN {templates}[{HASH.format(f"'43|' || {key}")} % 5 + 1] ELSE '' END"


def examples_sql(k: int = 20, min_tokens: int = 15) -> str:
    m = marker
    return f"""{ROWS}, whole AS (
  SELECT conv_id, list(line ORDER BY pos) AS lines FROM lined GROUP BY conv_id
), targets AS (
  SELECT l.conv_id, l.pos, l.text, CASE WHEN l.pos <= {k} THEN lines[1:l.pos] ELSE lines[1:2] || lines[l.pos - {k - 3}:l.pos] END AS history
  FROM lined l JOIN whole USING (conv_id) WHERE speaker = 'agent' AND len({tokens_sql("l.text")}) >= {min_tokens}
), prefixed AS (
  SELECT conv_id, (pos + 1)::INT AS target_turn_index, len(history)::INT AS n_history, text AS target,
    {quoted(f"{m('system')}{SYSTEM_PROMPT}{m('/system')}")} || chr(10) || '{m("context")}' || {context_sql("conv_id || '|' || (pos + 1)")} || '{m("/context")}' || chr(10)
    || '{m("conversation")}' || chr(10) || array_to_string(history, chr(10)) || chr(10) || '{m("/conversation")}' || chr(10) || '{m("agent")}' AS prefix
  FROM targets
), examples AS (
  SELECT *, prefix || target AS full_text, len({tokens_sql("prefix")})::INT AS prefix_len, len({tokens_sql("target")})::INT AS target_len FROM prefixed
)"""
