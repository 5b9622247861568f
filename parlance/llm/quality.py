"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far each can be trusted.

DataFrame functions only. What EM sees is how often each combination of votes occurs, a table of at most 3 ** rules
rows however many documents there are; it runs on the driver over those counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm._common import WORD_RX, materialise, text_or_empty

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the base measures of each whole text, and what the rules need beside them (columns ``__``).

    A word is in a repeated window if one of the 8-word windows over it occurs twice or more. Windows are compared by
    64-bit hashes; texts without a repeated hash, nearly all, need no sort. For the rest, windows are sorted by hash,
    those with an equal neighbour are kept, and the words that these cover are counted once each.
    """
    df = docs.withColumn("__t", text_or_empty())
    df = df.withColumn("__words", F.regexp_extract_all("__t", F.lit(WORD_RX), F.lit(0)))
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long"),
            "__lines": F.expr(r"filter(split(__t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"),
            "__runs": F.regexp_count("__t", F.lit(r"[#*$%&|<>]+")),
            "__letters": F.length(F.regexp_replace("__t", r"[^\p{L}]+", "")),
            "__upper": F.length(F.regexp_replace("__t", r"[^\p{Lu}]+", "")),
            "__stops": F.length("__t") - F.length(F.translate("__t", ".!?", "")),
            "__stutter": F.expr("size(filter(__words, (w, i) -> i > 0 and w = get(__words, i - 1)))"),
            "__h": F.expr(f"if(size(__words) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(1, size(__words) - {WINDOW - 1}), i -> xxhash64(slice(__words, i, {WINDOW}))))"),
        }
    )
    df = df.withColumns({"n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__n_lines": F.size("__lines")})
    df = df.withColumn("__sorted", F.expr("if(size(array_distinct(__h)) = size(__h), null, array_sort(transform(__h, (x, i) -> named_struct('h', x, 'i', i))))"))
    df = df.withColumn("__at", F.expr("array_sort(transform(filter(transform(__sorted, (x, k) -> named_struct('i', x.i, 'twin', (k > 0 and get(__sorted, k - 1).h = x.h) or (k < size(__sorted) - 1 and get(__sorted, k + 1).h = x.h))), y -> y.twin), y -> y.i))"))
    df = df.withColumn("n_repeat_words", F.expr(f"if(__at is null, 0L, cast(aggregate(transform(__at, (p, k) -> if(k = size(__at) - 1, {WINDOW}, least({WINDOW}, get(__at, k + 1) - p))), 0, (a, x) -> a + x) as bigint))"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__t", "__words", "__lines", "__h", "__sorted", "__at")


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 for good, -1 for bad, 0 if it abstains. Shares are per word, line or letter."""
    words, letters = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("__letters"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    mean, symbols, runs = F.col("word_chars") / words, F.col("n_symbols") / words, F.col("__runs") / words
    repeats, lines = F.col("n_repeat_words") / words, F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1))
    stutter = F.col("__stutter") / words
    alphabetic, upper, stops = F.col("__letters") / F.greatest(F.col("word_chars"), F.lit(1)), F.col("__upper") / letters, F.col("__stops") / words
    return {
        "length": vote(F.col("n_words") >= 50, F.col("n_words") < MIN_WORDS),
        "word_length": vote((mean >= 3) & (mean <= 12), (mean < 2) | (mean > 25)),
        "symbols": vote(symbols < 0.1, symbols > 0.3),
        "symbol_runs": vote(runs < 0.05, runs > 0.3),
        "lines": vote((lines < 0.1) & (F.col("__n_lines") >= 3), (lines > 0.3) & (F.col("n_dup_lines") >= 3)),
        "repeats": vote(repeats < 0.05, repeats > MAX_REPEAT_PERCENT / 100),
        "stutter": vote(stutter < 0.05, stutter > 0.2),
        "letters": vote(alphabetic > 0.8, alphabetic < 0.6),
        "capitals": vote(upper < 0.2, upper > 0.5),
        "stops": vote(stops >= 0.02, (F.col("__stops") == 0) & (F.col("n_words") >= 50)),
    }


#: Prior vote shares (bad, abstain, good) of a rule over good and over bad documents, and the prior share of good ones.
PRIOR_GOOD, PRIOR_BAD, PRIOR_SHARE = (0.02, 0.18, 0.8), (0.3, 0.2, 0.5), 0.85


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 60, prior: float = 1 / 50) -> tuple[float, list[tuple[tuple[float, ...], tuple[float, ...]]]]:
    """(share of good documents, per rule its vote shares over good and over bad ones) by expectation-maximisation.

    Rules vote independently given the quality. Priors with the weight of a share ``prior`` of the documents, 10
    at least, keep the estimate off degenerate ends and say which class is which.
    """
    n, total = len(next(iter(patterns), ())), sum(patterns.values())
    weight = max(10.0, total * prior)
    share, shares = PRIOR_SHARE, [(PRIOR_GOOD, PRIOR_BAD)] * n
    for _ in range(rounds):
        good, seen = PRIOR_SHARE * weight, [([p * weight for p in PRIOR_GOOD], [p * weight for p in PRIOR_BAD]) for _ in range(n)]
        for votes, count in patterns.items():
            q = posterior(votes, share, shares)
            good += count * q
            for j, v in enumerate(votes):
                seen[j][0][v + 1] += count * q
                seen[j][1][v + 1] += count * (1 - q)
        share = good / (total + weight)
        shares = [tuple(tuple(x / sum(side) for x in side) for side in sides) for sides in seen]
    return share, shares


def evidence(sides: tuple[tuple[float, ...], tuple[float, ...]]) -> list[float]:
    """Log odds of good against bad that a rule's vote (bad, abstain, good) adds."""
    return [math.log(g / b) for g, b in zip(*sides, strict=True)]


def posterior(votes: tuple[int, ...], share: float, shares: list) -> float:
    return 1 / (1 + math.exp(-math.log(share / (1 - share)) - sum(evidence(sides)[v + 1] for v, sides in zip(votes, shares, strict=True))))


def judged(measured: DataFrame, least: float = 0.5) -> DataFrame:
    """What ``measures`` gives, with votes, posterior quality and ``kept``; all rows stay."""
    names = list(rules())
    voted = measured.withColumns({f"vote_{k}": v.cast("int") for k, v in rules().items()}).drop("__runs", "__letters", "__upper", "__stops", "__n_lines", "__stutter")
    voted = materialise(voted, "votes")
    counts = voted.groupBy(*[f"vote_{k}" for k in names]).agg(F.count("*").alias("n")).collect()
    share, shares = estimate({tuple(r[f"vote_{k}"] for k in names): r["n"] for r in counts} or {(0,) * len(names): 0})
    z = F.lit(math.log(share / (1 - share)))
    for k, sides in zip(names, shares, strict=True):
        z = z + F.element_at(F.array(*map(F.lit, evidence(sides))), F.col(f"vote_{k}") + 2)
    quality = 1 / (1 + F.exp(-z))
    return voted.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality of every row.

    Null and empty texts have no words, so they fail. Rows with null or repeated ids keep their row. An empty table
    gives an empty result. Only narrow measures are written between the two steps, never texts.
    """
    out = judged(measures(docs.select("doc_id", "text")).drop("text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
