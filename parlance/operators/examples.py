"""Training examples: history windows, prefixes, token packing with loss masks. Narrow plans without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.config import CONTEXTS, MARKERS, SYSTEM_PROMPT, marker
from parlance.functions.text import hash32, token_ids, tokens


def history(turns: str, pos: str, k: int) -> Column:
    """The turns before ``pos``: all if at most k, else the first 2 and the last k - 2."""
    if k <= 2:
        raise ValueError("k must be over 2")
    return F.expr(f"if({pos} <= {k}, slice({turns}, 1, {pos}), concat(slice({turns}, 1, 2), slice({turns}, {pos} - {k - 2} + 1, {k - 2})))")


def rendered(turns: str) -> Column:
    return F.expr(f"array_join(transform({turns}, t -> concat(if(t.speaker = 'agent', '{marker('agent')}', '{marker('customer')}'), t.text)), '\\n')")


def context(key: Column, rate: float = 0.15, templates: tuple[str, ...] = CONTEXTS, seed: int = 42) -> Column:
    """A template for a share ``rate`` of the keys, else an empty text; by hash, so equal in every run."""
    h, h2 = hash32(F.concat_ws("|", F.lit(f"{seed}"), key)), hash32(F.concat_ws("|", F.lit(f"{seed + 1}"), key))
    pick = F.element_at(F.array(*map(F.lit, templates)), (h2 % len(templates) + 1).cast("int"))
    return F.when(h % 10_000 < int(rate * 10_000), pick).otherwise("")


def prompt(system: str, context_text: Column, history_text: Column, blank_line_on_empty: bool = True) -> Column:
    """The prefix: system, context and conversation blocks, each closed, then the agent's marker.

    The flag tells whether an empty history leaves a blank line.
    """
    m = marker
    between = F.concat(history_text, F.lit("\n")) if blank_line_on_empty else F.when(history_text == "", "").otherwise(F.concat(history_text, F.lit("\n")))
    return F.concat(F.lit(f"{m('system')}{system}{m('/system')}\n{m('context')}"), context_text, F.lit(f"{m('/context')}\n{m('conversation')}\n"), between, F.lit(f"{m('/conversation')}\n{m('agent')}"))


def examples(df: DataFrame, k: int = 20, min_tokens: int = 15, context_rate: float = 0.15, system: str = SYSTEM_PROMPT, id_column: str = "conversation_id") -> DataFrame:
    """One row per agent turn of ``min_tokens`` tokens and more: history, prefix, target, full_text.

    Shorter agent turns are no targets but stay in the history of others.
    """
    rows = df.select(id_column, "turns", F.posexplode("turns").alias("pos", "turn")).where("turn.speaker = 'agent'").where(F.size(tokens(F.col("turn.text"))) >= min_tokens)
    rows = rows.withColumn("history", history("turns", "pos", k))
    key = F.concat_ws("|", F.col(id_column).cast("string"), F.col("turn.index").cast("string"))
    rows = rows.withColumn("prefix", prompt(system, context(key, context_rate), rendered("history")))
    return rows.select(id_column, F.col("turn.index").alias("target_turn_index"), F.size("history").alias("n_history"), "prefix", F.col("turn.text").alias("target"), F.concat("prefix", "turn.text").alias("full_text"))


def populated(prefix: str = "prefix") -> Column:
    return ~F.col(prefix).contains(f"{marker('context')}{marker('/context')}")


def pack(df: DataFrame, max_len: int = 4096, mask: int = -100, eos: int = 0, pad: int | None = None) -> DataFrame:
    """Adds input_ids, labels, attention_mask of exactly ``max_len``, trunc_kind (none, conv, head, over) and n_real.

    The conversation loses its oldest tokens first, then the head. With no budget left the conversation is empty. A prefix
    that lacks one of the conversation's markers is all head: it loses its oldest tokens.
    Where the target alone is too long the row is marked ``over`` and its arrays are cut to the limit.
    """
    pad = eos if pad is None else pad
    ids = df.withColumns({"p": token_ids(tokens(F.col("prefix")), MARKERS), "t": F.concat(token_ids(tokens(F.col("target")), MARKERS), F.array(F.lit(eos)))})
    start, end = MARKERS.index("conversation") + 1, MARKERS.index("/conversation") + 1
    ids = ids.withColumns({"s": F.array_position("p", start), "e": F.array_position("p", end)})
    both = "s > 0 and e > 0"
    parts = {
        "head": f"if({both}, slice(p, 1, int(s)), p)",
        "conv": f"if({both}, slice(p, int(s) + 1, int(greatest(e - s - 1, 0))), array())",
        "tail": f"if({both}, slice(p, int(e), int(size(p) - e + 1)), array())",
    }
    ids = ids.withColumns({k: F.expr(v) for k, v in parts.items()})
    return _fit(ids, max_len, mask, pad).drop("p", "s", "e", "head", "conv", "tail", "t")


def _fit(ids: DataFrame, max_len: int, mask: int, pad: int) -> DataFrame:
    """From head, conv, tail and t (target with its end) to fixed lengths."""
    ids = ids.withColumn("budget", F.expr(f"{max_len} - size(head) - size(tail) - size(t)"))
    ids = ids.withColumn("trunc_kind", F.expr("case when budget < 0 and -budget > size(head) then 'over' when budget < 0 then 'head' when size(conv) > budget then 'conv' else 'none' end"))
    ids = ids.withColumn("kept", F.expr("case when budget < 0 then concat(slice(head, least(-budget, size(head)) + 1, size(head)), tail) when size(conv) > budget then concat(head, if(budget = 0, slice(conv, 1, 0), slice(conv, greatest(size(conv) - budget + 1, 1), budget)), tail) else concat(head, conv, tail) end"))
    ids = ids.withColumn("n_real", F.expr(f"least(size(kept) + size(t), {max_len})"))
    fixed = lambda a, fill: F.expr(f"slice(concat({a}, array_repeat({fill}, greatest({max_len} - size(kept) - size(t), 0))), 1, {max_len})")
    ids = ids.withColumns({"input_ids": fixed("concat(kept, t)", pad), "labels": fixed(f"concat(array_repeat({mask}, size(kept)), t)", mask)})
    return ids.withColumn("attention_mask", F.expr(f"concat(array_repeat(1, n_real), array_repeat(0, {max_len} - n_real))")).drop("kept", "budget")


def boundaries(packed: DataFrame, mask: int = -100) -> DataFrame:
    """Adds first_label (0-based, first unmasked), pad_start (first masked after it, or the length), n_attended."""
    packed = packed.withColumn("first_label", (F.array_position(F.transform("labels", lambda x: x != mask), True) - 1).cast("int"))
    packed = packed.withColumn("pad_start", F.expr(f"coalesce(array_min(filter(transform(labels, (x, i) -> if(x = {mask} and i > first_label, i, null)), x -> x is not null)), size(labels))"))
    return packed.withColumn("n_attended", F.expr("aggregate(attention_mask, 0, (a, x) -> a + x)"))


def lengths(df: DataFrame) -> DataFrame:
    """Adds prefix_len, target_len, total_len (with the end token), measured without packing."""
    df = df.withColumns({"prefix_len": F.size(tokens(F.col("prefix"))), "target_len": F.size(tokens(F.col("target")))})
    return df.withColumn("total_len", F.col("prefix_len") + F.col("target_len") + 1)
