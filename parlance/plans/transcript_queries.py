"""Queries over transcripts: parsing, repair, states, training examples, packing, reports, dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.config import MARKERS, SYSTEM_PROMPT, marker
from parlance.functions.text import TURN, preview, tokens, trim_response
from parlance.operators import compliance, examples, providers, reports, states, transcripts
from parlance.plans.inputs import HASH, ROWS, STATES, STRIP, TRANSCRIPTS, context_sql, example_rows, examples_sql, parsed, quoted, rendered, state_rows, table, tokens_sql, turns
from parlance.sources import io
from parlance.streaming import dialogue

FOUND: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {STATES} SELECT * FROM states")
def states_windows(spark, sf):
    return state_rows(spark, sf)


_MATCHES = r"""(?m)^(agent|customer)\(u(\d+)\):\s*(.+)$"""
_PARSED = f"""{TRANSCRIPTS}, matched AS (
  SELECT conv_id, transcript, regexp_extract_all(transcript, '{_MATCHES}', 1) AS s, regexp_extract_all(transcript, '{_MATCHES}', 2) AS n, regexp_extract_all(transcript, '{_MATCHES}', 3) AS t FROM rendered
), parsed AS (
  SELECT conv_id, i::INT AS pos, s[i + 1] AS speaker, n[i + 1]::INT AS "index", {STRIP.format("t[i + 1]")} AS text FROM matched, unnest(range(len(s))) AS u(i)
), fixed AS (
  SELECT conv_id, string_agg(CASE WHEN pos % 2 = 0 THEN 'agent' ELSE 'customer' END || '(u' || (pos + 1) || '): ' || text, chr(10) ORDER BY pos) AS repaired, count(*)::INT AS n_turns,
    bool_and(speaker = CASE WHEN pos % 2 = 0 THEN 'agent' ELSE 'customer' END) AS alternates
  FROM parsed GROUP BY conv_id
)"""


@query(f"WITH {_PARSED} SELECT * FROM parsed")
def parse_turns(spark, sf):
    rows = parsed(spark, sf).select("conv_id", F.posexplode("turns").alias("pos", "t"))
    return rows.select("conv_id", "pos", "t.speaker", "t.index", "t.text")


@query(f"WITH {_PARSED} SELECT conv_id, repaired FROM fixed")
def repair_transcripts(spark, sf):
    return transcripts.repair(parsed(spark, sf)).select("conv_id", "repaired")


@query(f"""WITH {_PARSED} SELECT f.conv_id, n_turns, alternates, CASE WHEN alternates AND n_turns >= 4 THEN 'OK' ELSE 'WARN' END AS status,
  CASE WHEN length(p.text) > 60 THEN left(p.text, 60) || '...' ELSE p.text END AS preview
  FROM fixed f JOIN parsed p ON p.conv_id = f.conv_id AND p.pos = 0""")
def validate_transcripts(spark, sf):
    return transcripts.validate(parsed(spark, sf)).select("conv_id", "n_turns", "alternates", "status", "preview")


@query(f"WITH {_PARSED} SELECT conv_id, n_turns FROM fixed WHERE n_turns < 4")
def repair_violations(spark, sf):
    fixed = transcripts.repair(parsed(spark, sf)).select("conv_id", "repaired")
    again = transcripts.parse(fixed, "repaired")
    return transcripts.violations(again).select("conv_id", F.size("turns").alias("n_turns"))


@query(f"WITH {TRANSCRIPTS}, n AS (SELECT conv_id, count(*)::INT AS n_turns FROM rows GROUP BY conv_id) SELECT conv_id, quality AS label, n_turns FROM n JOIN labels ON doc_id = conv_id WHERE quality = 1 AND n_turns >= 4")
def converted_filter(spark, sf):
    label = table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"), F.col("quality").alias("label"))
    rows = turns(spark, sf).join(label, "conv_id", "left")
    return transcripts.with_min_turns(transcripts.converted(rows), 4).select("conv_id", "label", F.size("turns").alias("n_turns"))


@query(f"WITH {ROWS} SELECT conv_id, pos::INT AS pos, len({tokens_sql('text')})::INT AS n_tokens FROM rows WHERE speaker = 'agent' AND len({tokens_sql('text')}) >= 40")
def substantive_filter(spark, sf):
    rows = turns(spark, sf).select("conv_id", F.posexplode("turns").alias("pos", "t")).where("t.speaker = 'agent'")
    return rows.select("conv_id", "pos", F.size(tokens(F.col("t.text"))).alias("n_tokens")).where("n_tokens >= 40")


@query(f"WITH {examples_sql()} SELECT conv_id, target_turn_index, n_history, prefix, target, full_text FROM examples")
def training_examples(spark, sf):
    return example_rows(spark, sf)


@query(f"WITH {examples_sql(4, 40)} SELECT conv_id, target_turn_index, n_history, prefix, target, full_text FROM examples")
def history_window_k4(spark, sf):
    return example_rows(spark, sf, 4, 40)


@query(f"WITH {examples_sql()} SELECT count(*) AS n, count_if(prefix NOT LIKE '%{marker('context')}{marker('/context')}%')::BIGINT AS n_populated, round(100.0 * count_if(prefix NOT LIKE '%{marker('context')}{marker('/context')}%') / nullif(count(*), 0), 6)::DOUBLE AS percent FROM examples")
def populated_share(spark, sf):
    rows = example_rows(spark, sf)
    return rows.agg(F.count("*").alias("n"), F.count_if(examples.populated()).alias("n_populated"), F.round(F.try_divide(100.0 * F.count_if(examples.populated()), F.count("*")), 6).alias("percent"))


_MEASURES = ("prefix_len", "target_len", "total_len")
_LENGTHS = f"{examples_sql()}, lengths AS (SELECT *, prefix_len + target_len + 1 AS total_len FROM examples)"


@query(f"WITH {_LENGTHS} " + " UNION ALL ".join(f"SELECT '{c}' AS measure, count({c}) AS n, min({c})::INT AS least, max({c})::INT AS most, round(avg({c}), 6) AS mean FROM lengths" for c in _MEASURES))
def length_stats(spark, sf):
    return reports.length_stats(examples.lengths(example_rows(spark, sf)), *_MEASURES)


@query(f"WITH {_LENGTHS} " + " UNION ALL ".join(f"SELECT {p}::INT AS percentile, trunc(quantile_cont(total_len, {p / 100}))::BIGINT AS value FROM lengths" for p in (50, 75, 90, 95, 99, 100)))
def length_percentiles(spark, sf):
    return reports.percentiles(examples.lengths(example_rows(spark, sf)), "total_len")


@query(f"WITH {_LENGTHS}, span AS (SELECT min(total_len)::DOUBLE AS lo, max(total_len)::DOUBLE AS hi FROM lengths) SELECT CASE WHEN hi = lo THEN 1 ELSE least(50, floor((total_len - lo) * 50 / (hi - lo)) + 1) END::INT AS bin, count(*) AS n FROM lengths, span GROUP BY ALL")
def length_histogram(spark, sf):
    return reports.histogram(examples.lengths(example_rows(spark, sf)), "total_len")


@query(f"WITH {_LENGTHS} SELECT count(*) AS n, count_if(total_len > 256)::BIGINT AS n_over, round(count_if(total_len > 256) / count(*), 6)::DOUBLE AS share_over FROM lengths")
def over_length(spark, sf):
    return reports.over_budget(examples.lengths(example_rows(spark, sf)), "total_len", 256)


@query(f"WITH {STATES}, sizes AS (SELECT conv_id, count(*) AS n_states FROM states GROUP BY conv_id) SELECT count(*) AS n, round(avg(n_states), 6) AS mean, round(stddev_samp(n_states), 6) AS std, min(n_states) AS least, round(quantile_cont(n_states, 0.25), 6) AS p25, round(quantile_cont(n_states, 0.5), 6) AS p50, round(quantile_cont(n_states, 0.75), 6) AS p75, max(n_states) AS most FROM sizes")
def describe_states(spark, sf):
    sizes = state_rows(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n_states"))
    return reports.describe(sizes, "n_states")


@query(f"WITH {STATES} SELECT count(*) AS n_states, count(DISTINCT conv_id) AS n_conversations FROM states")
def conversation_counts(spark, sf):
    return state_rows(spark, sf).agg(F.count("*").alias("n_states"), F.count_distinct("conv_id").alias("n_conversations"))


@query(f"WITH {STATES} SELECT n_turns_available, count(*) AS n FROM states GROUP BY 1")
def turns_histogram(spark, sf):
    return state_rows(spark, sf).groupBy("n_turns_available").agg(F.count("*").alias("n"))


_KNOWN = "[" + ", ".join(f"'<|{m}|>'" for m in MARKERS) + "]"


def _ids(text: str) -> str:
    return f"list_transform({tokens_sql(text)}, lambda t: coalesce(nullif(list_position({_KNOWN}, t), 0), {HASH.format('t')} % 50000 + 16)::INT)"


def _packed_sql(limit: int) -> str:
    return f"""{examples_sql()}, ids AS (
  SELECT conv_id, target_turn_index, {_ids("prefix")} AS p, list_append({_ids("target")}, 0) AS t FROM examples
), marks AS (
  SELECT *, coalesce(list_position(p, 5), 0) AS s, coalesce(list_position(p, 6), 0) AS e FROM ids
), parts AS (
  SELECT *, CASE WHEN s > 0 AND e > 0 THEN p[1:s] ELSE p END AS head, CASE WHEN s > 0 AND e > 0 THEN p[s + 1:e - 1] ELSE [] END AS conv, CASE WHEN s > 0 AND e > 0 THEN p[e:] ELSE [] END AS tail FROM marks
), room AS (
  SELECT *, {limit} - len(head) - len(tail) - len(t) AS budget FROM parts
), cut AS (
  SELECT *, CASE WHEN budget < 0 AND -budget > len(head) THEN 'over' WHEN budget < 0 THEN 'head' WHEN len(conv) > budget THEN 'conv' ELSE 'none' END AS trunc_kind,
    CASE WHEN budget < 0 THEN head[least(-budget, len(head)) + 1:] || tail WHEN len(conv) > budget THEN head || conv[len(conv) - budget + 1:] || tail ELSE head || conv || tail END AS kept
  FROM room
), packed AS (
  SELECT conv_id, target_turn_index, trunc_kind, least(len(kept) + len(t), {limit})::INT AS n_real,
    (kept || t || list_transform(range({limit}), lambda x: 0))[1:{limit}] AS input_ids,
    (list_transform(range(len(kept)), lambda x: -100) || t || list_transform(range({limit}), lambda x: -100))[1:{limit}] AS labels,
    list_transform(range({limit}), lambda x: CASE WHEN x < len(kept) + len(t) THEN 1 ELSE 0 END) AS attention_mask
  FROM cut
)"""


@query(f"WITH {_packed_sql(256)} SELECT conv_id, target_turn_index, trunc_kind, n_real, array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels, array_to_string(attention_mask, ',') AS attention_mask FROM packed")
def pack_sequences(spark, sf):
    rows = examples.pack(example_rows(spark, sf), 256)
    return rows.select("conv_id", "target_turn_index", "trunc_kind", "n_real", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("input_ids", "labels", "attention_mask")])


@query(f"""WITH {_packed_sql(256)}, firsts AS (SELECT *, list_position(list_transform(labels, lambda x: x <> -100), true) - 1 AS f FROM packed)
SELECT conv_id, target_turn_index, f::INT AS first_label, coalesce(list_min(list_filter(range(len(labels)), lambda i: i > f AND labels[i + 1] = -100)), len(labels))::INT AS pad_start, list_sum(attention_mask)::INT AS n_attended FROM firsts""")
def loss_mask_boundary(spark, sf):
    return examples.boundaries(examples.pack(example_rows(spark, sf), 256)).select("conv_id", "target_turn_index", "first_label", "pad_start", "n_attended")


@query(f"WITH {_packed_sql(128)} SELECT trunc_kind, count(*) AS n FROM packed GROUP BY 1")
def truncation_counts(spark, sf):
    return examples.pack(example_rows(spark, sf), 128).groupBy("trunc_kind").agg(F.count("*").alias("n"))


@query(f"WITH {STATES} SELECT conv_id, state_index, 'Recent turns:' || chr(10) || w3_text || chr(10) || chr(10) || 'Full context:' || chr(10) || w_full_text AS judge_context, 'full:    ' || left(w_full_text, 120) AS secondary_context FROM states")
def judge_contexts(spark, sf):
    return states.judge_context(state_rows(spark, sf)).select("conv_id", "state_index", "judge_context", "secondary_context")


@query(f"WITH {STATES} SELECT conv_id, state_index, 'Turns: ' || len(string_split(w_full_text, chr(10))) || '; begins: ' || left(w_full_text, 60) AS w_summary_text, left(w_full_text, 200) AS shown FROM states")
def state_summaries(spark, sf):
    return state_rows(spark, sf).select("conv_id", "state_index", providers.summary_of(F.col("w_full_text")).alias("w_summary_text"), preview(F.col("w_full_text"), 200).alias("shown"))


@query(f"""WITH {ROWS}, l AS (SELECT conv_id, list(text ORDER BY pos) AS t FROM rows GROUP BY conv_id), placed AS (SELECT r.conv_id, r.pos, t FROM rows r JOIN l USING (conv_id) WHERE speaker = 'customer' AND r.pos + 1 < len(t))
SELECT conv_id, pos::INT AS pos, t[pos + 1] AS s0, array_to_string(t[greatest(1, pos - 2):pos], chr(10)) AS s1, array_to_string(CASE WHEN pos < 4 THEN [] ELSE t[greatest(1, pos - 8):pos - 3] END, chr(10)) AS s2, array_to_string(CASE WHEN pos < 10 THEN [] ELSE t[1:pos - 9] END, chr(10)) AS s3 FROM placed""")
def disjoint_segments(spark, sf):
    return states.segments(turns(spark, sf))


@query(f"""WITH {ROWS}, w AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY pos) AS h FROM lined GROUP BY conv_id)
SELECT conv_id, {quoted(f"{marker('system')}{SYSTEM_PROMPT}{marker('/system')}")} || chr(10) || '{marker("context")}' || {context_sql("conv_id::VARCHAR")} || '{marker("/context")}' || chr(10) || '{marker("conversation")}' || chr(10) || h || chr(10) || '{marker("/conversation")}' || chr(10) || '{marker("agent")}' AS prompt FROM w""")
def prompt_render(spark, sf):
    rows = turns(spark, sf)
    return rows.select("conv_id", examples.prompt(SYSTEM_PROMPT, examples.context(F.col("conv_id").cast("string")), examples.rendered("turns"), blank_line_on_empty=False).alias("prompt"))


@query(f"""WITH r AS (SELECT conv_id, turn, '  ' || replace(text, ' the ', ' <|agent|> ') || ' <|customer|>' || role AS answer FROM conversations)
SELECT conv_id, turn, {STRIP.format(r"regexp_extract(answer, '^(.*?)(?:<\|customer\|>|<\|/conversation\|>|<\|agent\|>|$)', 1, 's')")} AS trimmed FROM r""")
def response_trim(spark, sf):
    answer = F.concat(F.lit("  "), F.replace("text", F.lit(" the "), F.lit(" <|agent|> ")), F.lit(" <|customer|>"), F.col("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", trim_response(answer).alias("trimmed"))


_TRIM = STRIP.format(r"regexp_extract({}, '^(.*?)(?:<\|customer\|>|<\|/conversation\|>|<\|agent\|>|$)', 1, 's')")


@query(f"""WITH {ROWS}, w AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY pos) || chr(10) || '{marker("/conversation")}' || chr(10) || '{marker("agent")}' AS p FROM lined GROUP BY conv_id)
SELECT conv_id, {_TRIM.format("' Noted: ' || right(p, 40)")} AS tuned, {_TRIM.format("' Base: ' || right(p, 36)")} AS base FROM w""")
def ab_generation(spark, sf):
    """Replies of two generators to the same prompts, side by side."""
    p = examples.prompt(SYSTEM_PROMPT, F.lit(""), examples.rendered("turns"), blank_line_on_empty=False)
    return turns(spark, sf).select("conv_id", trim_response(providers.reply_to(p)).alias("tuned"), trim_response(providers.base_reply_to(p)).alias("base"))


@query("""WITH i AS (SELECT conv_id AS session, turn AS seq, CASE WHEN turn % 4 = 2 AND conv_id % 3 = 0 THEN ' Quit ' ELSE text END AS text FROM conversations WHERE role = 'user'),
q AS (SELECT *, sum(CASE WHEN lower(trim(text)) = 'quit' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS quits FROM i),
c AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq)::INT AS k, """ + STRIP.format("text") + f""" AS text FROM q WHERE quits = 0),
tails AS (SELECT session, k, '{marker("customer")}' || text AS tail FROM c UNION ALL SELECT DISTINCT session, 0, '{marker("conversation")}' FROM i)
SELECT session, 2 * k AS n, 'customer' AS speaker, text FROM c UNION ALL
SELECT session, 2 * k + 1, 'agent', {_TRIM.format(f"' Noted: ' || right(tail || chr(10) || '{marker('/conversation')}' || chr(10) || '{marker('agent')}', 40)")} FROM tails""")
def dialogue_two_sided(spark, sf):
    """Whole dialogues: the agent opens and answers each customer input until a `quit`."""
    rows = table(spark, sf, "conversations").where("role = 'user'")
    text = F.when((F.col("turn") % 4 == 2) & (F.col("conv_id") % 3 == 0), " Quit ").otherwise(F.col("text"))
    inputs = rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), text.alias("text"))
    lines = lambda t: F.array_join(F.transform(t, lambda x: F.concat(F.when(x.speaker == "agent", marker("agent")).otherwise(marker("customer")), x.text)), "\n")
    return dialogue.two_sided(inputs, lambda t: examples.prompt(SYSTEM_PROMPT, F.lit(""), lines(t), blank_line_on_empty=False), providers.reply_to)


@query("""WITH i AS (SELECT conv_id AS session, turn AS seq, CASE WHEN turn % 4 = 2 AND conv_id % 3 = 0 THEN ' Quit ' ELSE text END AS text FROM conversations WHERE role = 'user'),
q AS (SELECT *, sum(CASE WHEN lower(trim(text)) = 'quit' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS quits FROM i)
SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq)::INT AS n, """ + STRIP.format("text") + """ AS text FROM q WHERE quits = 0""")
def dialogue_replay(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'user'")
    text = F.when((F.col("turn") % 4 == 2) & (F.col("conv_id") % 3 == 0), " Quit ").otherwise(F.col("text"))
    return dialogue.replay(rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), text.alias("text")))


@query(f"""WITH h AS (SELECT i, {HASH.format("'42|' || i")} % 11 + 5 AS half FROM range(10) t(i))
SELECT 'fake_' || lpad(i::VARCHAR, 3, '0') AS conversation_id, 1 AS label, array_to_string(list_transform(range(1, half * 2 + 1), lambda k: CASE WHEN k % 2 = 1 THEN 'agent' ELSE 'customer' END || '(u' || k || '): Line ' || k || ' of fake_' || lpad(i::VARCHAR, 3, '0')), chr(10)) AS transcript FROM h""")
def synthetic_transcripts(spark, sf):
    return providers.synthetic_transcripts(spark)


_RULES = {"promise": r"(?i)\bguarantee", "number": r"[0-9]{3,}", "shout": r"!{2,}|[A-Z]{5,}", "the": r"\bthe\b"}


@query("WITH h AS (SELECT conv_id, turn, [" + ", ".join(f"CASE WHEN regexp_matches(text, {quoted(p)}) THEN '{n}' END" for n, p in _RULES.items()) + "] AS b FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(b, lambda x: x IS NOT NULL), ',') AS broken, len(list_filter(b, lambda x: x IS NOT NULL))::INT AS n_rules, len(list_filter(b, lambda x: x IS NOT NULL)) > 0 AS blocked FROM h")
def compliance_audit(spark, sf):
    return compliance.audit(table(spark, sf, "conversations"), _RULES).select("conv_id", "turn", "broken", "n_rules", "blocked")


@query(f"WITH {examples_sql()} SELECT conv_id, target_turn_index, full_text, target FROM examples")
def jsonl_round_trip(spark, sf):
    """Examples written as JSON lines and read again."""
    path = io.scratch(spark, "examples")
    io.write_jsonl(example_rows(spark, sf).withColumn("conversation_id", F.col("conv_id").cast("string")), path)
    return io.read_examples(spark, path).select(F.col("conversation_id").cast("long").alias("conv_id"), "target_turn_index", "full_text", "target")


@query(f"WITH {TRANSCRIPTS} SELECT conv_id, transcript FROM rendered")
def csv_round_trip(spark, sf):
    """Transcripts, which hold line feeds, written as CSV and read again."""
    path = io.scratch(spark, "transcripts")
    rendered(spark, sf).select(F.col("conv_id").cast("string").alias("conversation_id"), F.lit(1).alias("label"), "transcript").write.csv(path, header=True, escape='"')
    return io.read_csv(spark, path).select(F.col("conversation_id").cast("long").alias("conv_id"), "transcript")
