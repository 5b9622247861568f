"""Secret scans: patterns, and Markov models of random strings against ordinary identifiers. DataFrame functions only.

Spans are code points, end exclusive. Spark has no function for the positions of matches; they follow from the lengths
of the matches and of what ``split`` with the same pattern leaves between them. All steps are linear in a text's length
or nearly so: running sums go chunk by chunk, characters are looked up in arrays, and texts are cut by blocks.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm._common import materialise, seeded_hash, shielded, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the models are asked about: runs of 20 and more characters of this alphabet, of ``VARIETY`` different ones.
ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"
LEAST, VARIETY = 20, 8
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
KINDS = ("assign", "access", "hex", "markov")
#: Expected rows, of all and again of those with a pattern's match, and most characters of a row in the training sample.
SAMPLE_ROWS, SAMPLE_CHARS, SEED = 5_000, 50_000, 29
#: Alphabets of the random strings that are made as labelled samples, so many of each, of 20 to 59 characters.
RANDOM = {
    "upper": string.ascii_uppercase + string.digits,
    "lower": string.ascii_lowercase + string.digits,
    "mixed": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "url": string.ascii_letters + string.digits + "_-",
    "hex": string.digits + "ABCDEF",
}
MADE = 500
_SPANS = "array<struct<s:int,k:int,e:int,v:string>>"
_CHUNK, _BLOCK = 256, 4096


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``value`` computed once under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(items: str, value: str, put: str, total: str, kind: str) -> str:
    """SQL array of ``put`` for each ``x`` of ``items``, where ``at`` is ``total`` (of a and b) of ``value`` over all before it.

    A fold that appends copies what it has; chunk by chunk it copies no more than a chunk's length an item.
    """
    step = lambda acc, item: total.replace("(a)", f"({acc})").replace("(b)", f"({item})")
    sums = f"transform(q, ch -> aggregate(ch, 0, (acc, x) -> {step('acc', value)}))"
    before = f"aggregate({sums}, named_struct('at', 0, 'out', cast(array() as array<int>)), (acc, t) -> named_struct('at', {step('acc.at', 't')}, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"
    fold = f"aggregate(ch, named_struct('at', p, 'out', cast(array() as {kind})), (acc, x) -> named_struct('at', {step('acc.at', value)}, 'out', concat(acc.out, array({put.replace('(at)', '(acc.at)')}))), acc -> acc.out)"
    chunks = f"transform(sequence(0, (size(z) - 1) div {_CHUNK}), c -> slice(z, c * {_CHUNK} + 1, {_CHUNK}))"
    return _let(items, "z", f"if(size(z) = 0, cast(array() as {kind}), {_let(chunks, 'q', f'flatten(zip_with(q, {before}, (ch, p) -> {fold}))')})")


def _spans(df: DataFrame, name: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> DataFrame:
    """Adds array column ``name`` of spans (s, k: kind, e, v: text of ``group``) whose group has ``least`` characters."""
    m, g, v = f"__{name}_m", f"__{name}_g", f"__{name}_v"
    df = df.withColumn(m, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
    df = df.withColumns({g: F.when(F.size(m) > 0, F.split("__text", pattern, -1)), v: F.when(F.size(m) > 0, F.regexp_extract_all("__text", F.lit(pattern), F.lit(group))) if group else F.col(m)})
    items = f"zip_with(zip_with({m}, slice({g}, 1, size({m})), (x, y) -> named_struct('gap', length(y), 'n', length(x))), {v}, (z, w) -> named_struct('gap', z.gap, 'n', z.n, 'v', w))"
    put = f"named_struct('s', (at) + x.gap, 'k', {kind}, 'e', (at) + x.gap + x.n, 'v', x.v)"
    spans = _running(items, "x.gap + x.n", put, "(a) + (b)", _SPANS)
    return df.withColumn(name, F.expr(f"if(size({m}) = 0, cast(array() as {_SPANS}), filter({spans}, x -> length(x.v) >= {least}))")).drop(m, g, v)


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with what one pass over the texts finds: spans by kind, ``__base`` (those of all patterns by start, then
    kind), ``__run`` (candidates that touch none of these) and, for sampled rows, ``__plain`` (words outside spans).
    """
    df = docs.withColumn("__text", text_or_empty())
    df = _spans(df, "__assign", ASSIGN, 0, group=2, least=6)
    df = _spans(df, "__access", ACCESS, 1)
    df = _spans(df, "__hex", HEX, 2)
    df = _spans(df, "__all_runs", CANDIDATE, 3).withColumn("__base", F.expr("array_sort(concat(__assign, __access, __hex))"))
    # by start: a run touches a span that began before it and ends in it or later, or one that begins in it, the next one
    put = "named_struct('s', x.s, 'k', if(x.k = 3 and (at) > x.s, -1, x.k), 'e', x.e, 'v', x.v)"
    past = _running("array_sort(concat(__base, __all_runs))", "if(x.k < 3, x.e, 0)", put, "greatest((a), (b))", _SPANS)
    free = _let(past, "w", "filter(w, (x, i) -> x.k = 3 and (i = size(w) - 1 or get(w, i + 1).s >= x.e))")
    df = df.withColumn("__run", F.expr(f"if(size(__all_runs) = 0 or size(__base) = 0, __all_runs, {free})")).drop("__all_runs")
    draw, share = F.pmod(seeded_hash("doc_id", seed=SEED), F.lit(1 << 30)), int((1 << 30) * min(1.0, SAMPLE_ROWS / max(1, docs.count())))
    left = F.expr(f"regexp_extract_all(concat_ws(' ', split(__text, {_quoted(ASSIGN + '|' + ACCESS + '|' + HEX)})), '[A-Za-z_-]{{4,}}', 0)")
    plain = F.when((draw < share) & (F.length("__text") <= SAMPLE_CHARS), left)
    return df.withColumn("__plain", plain).drop("__text")


def _digest(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def _score(value: str, table: str) -> str:
    """SQL for the mean log-likelihood ratio per pair of neighbouring characters of ``value``."""
    places = f"transform(split({value}, ''), c -> instr('{ALPHABET}', c) - 1)"
    return _let(places, "ix", f"aggregate(sequence(1, size(ix) - 1), 0D, (acc, i) -> acc + {table}[ix[i - 1] * {len(ALPHABET)} + ix[i]]) / (size(ix) - 1)")


def made_samples(spark: SparkSession) -> DataFrame:
    """(label 1, v): ``MADE`` random strings of each alphabet in ``RANDOM``, by hash, equal in every run."""
    rows = spark.range(MADE * len(RANDOM)).withColumn("abc", F.element_at(F.array(*map(F.lit, RANDOM.values())), (F.col("id") % len(RANDOM) + 1).cast("int")))
    pick = "substring(abc, cast(pmod(xxhash64(id, i, 71), length(abc)) as int) + 1, 1)"
    return rows.select(F.lit(1).alias("label"), F.expr(f"array_join(transform(sequence(1, cast({LEAST} + id div {len(RANDOM)} % 40 as int)), i -> {pick}), '')").alias("v"))


def labelled(found: DataFrame) -> DataFrame:
    """(label, v) strings of 20 characters and more; 1 for random ones, 0 for ordinary identifiers.

    Random: what the patterns find, in a sample of the rows that have any, and made strings of several alphabets, some of
    which no pattern sees. Ordinary: long words of the sampled texts, and each three words that stand one after another,
    joined by underscores, by hyphens or by nothing with capitals at the start, and by underscores in capitals; whole
    and cut to 20 to 39 characters, as the quantiles of a mean depend on length.
    """
    bears = found.where("size(__base) > 0")
    draw, share = F.pmod(seeded_hash("doc_id", seed=SEED + 1), F.lit(1 << 30)), int((1 << 30) * min(1.0, SAMPLE_ROWS / max(1, bears.count())))
    random = bears.where(draw < share).select(F.lit(1).alias("label"), F.explode("__base.v").alias("v")).where(F.length("v") <= SAMPLE_CHARS)
    forms = ("array_join(w, '_')", "array_join(w, '-')", "array_join(transform(w, y -> initcap(y)), '')", "upper(array_join(w, '_'))")
    joined = ", ".join(f"transform(filter(threes, (w, i) -> i % {len(forms)} = {k}), w -> {form})" for k, form in enumerate(forms))
    threes = "transform(sequence(1, greatest(1, size(__plain) - 2), 3), i -> slice(__plain, i, 3))"
    ordinary = found.where("size(__plain) > 0").withColumn("threes", F.expr(threes)).select(F.explode(F.expr(f"concat(filter(__plain, w -> length(w) >= {LEAST}), {joined})")).alias("v"))
    ordinary = ordinary.select(F.lit(0).alias("label"), F.explode(F.expr(f"array(v, substring(v, 1, cast({LEAST} + pmod(xxhash64(v), {LEAST}) as int)))")).alias("v"))
    strings = random.unionByName(made_samples(found.sparkSession)).unionByName(ordinary)
    return strings.withColumn("v", F.regexp_replace("v", r"[^A-Za-z0-9+/_=-]", "")).where(F.length("v") >= LEAST)


def train(found: DataFrame) -> tuple[list[float], float] | None:
    """(log-likelihood ratio of each pair of characters, threshold) from ``scanned``; None if it has no ordinary string.

    Counts are collected per pair (a bounded table) with add-one smoothing. The threshold is halfway between the
    ordinary strings' 99.9 % quantile and the random strings' 2 % quantile, or the former where these cross.
    """
    strings = materialise(labelled(found), "labelled-strings")
    pairs = strings.select("label", F.explode(F.expr(_let("split(v, '')", "c", "transform(sequence(1, size(c) - 1), i -> concat(c[i - 1], c[i]))"))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    if {label for label, _ in counts} != {0, 1}:
        return None
    table = []
    for a in ALPHABET:
        rows = [[counts.get((label, a + b), 0) + 1 for b in ALPHABET] for label in (0, 1)]
        table += [round(math.log(r / sum(rows[1])) - math.log(o / sum(rows[0])), 6) for o, r in zip(*rows, strict=True)]
    scored = strings.withColumn("llr", _table(table)).withColumn("score", F.expr(_score("v", "llr")))
    low, high = scored.agg(F.expr("percentile(score, 0.999) filter (where label = 0)"), F.expr("percentile(score, 0.02) filter (where label = 1)")).first()
    return table, float(max(low, (low + high) / 2))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _table(table: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")


def find(found: DataFrame, model: tuple[list[float], float] | None) -> DataFrame:
    """``scanned`` rows with ``__spans``, sorted by start, then kind: the patterns' and the runs that score over the threshold."""
    if model is None:
        return found.withColumn("__spans", F.col("__base"))
    varied = f"size(array_distinct(split(x.v, ''))) >= {VARIETY}"
    more = f"if(size(__run) = 0, __run, filter(__run, x -> {varied} and {_score('x.v', '__llr')} > {model[1]!r}D))"
    df = found.withColumn("__llr", _table(model[0])).withColumn("__more", F.expr(more))
    return df.withColumn("__spans", F.expr("if(size(__more) = 0, __base, array_sort(concat(__base, __more)))")).drop("__llr", "__more")


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_markov of every row.

    Null and empty texts have no spans; their base_sha256 is that of the empty string. Rows with null or repeated ids
    keep their row. An empty table gives an empty result. Texts are read once; only spans are written between the steps.
    """
    found = materialise(scanned(docs.select("doc_id", "text")).drop("text"), "secret-spans")
    df = find(found, train(found))
    count = lambda c: F.size(c).cast("long")
    return df.select("doc_id", count("__assign").alias("n_assign"), count("__access").alias("n_access"), count("__hex").alias("n_hex"), F.sha2(_digest("__base"), 256).alias("base_sha256"), _digest("__spans").alias("spans"), (F.size("__spans") - F.size("__base")).cast("long").alias("n_markov"))


def redacted(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with each span, overlapping ones together, replaced by ``mark``; n_chars follows the text if it is there.

    Texts without a span, null ones included, and further columns of any name stay as they are. All rows stay.
    """
    safe = shielded(docs, "doc_id", "text", "n_chars")
    found = materialise(scanned(safe), "secret-spans")
    df = find(found, train(found))
    piece = lambda a, b: f"""if({a} div {_BLOCK} = ({b} - 1) div {_BLOCK}, substring(tb[{a} div {_BLOCK}], {a} % {_BLOCK} + 1, {b} - {a}), concat(substring(tb[{a} div {_BLOCK}], {a} % {_BLOCK} + 1, {_BLOCK}),
        array_join(slice(tb, {a} div {_BLOCK} + 2, ({b} - 1) div {_BLOCK} - {a} div {_BLOCK} - 1), ''), substring(tb[({b} - 1) div {_BLOCK}], 1, ({b} - 1) % {_BLOCK} + 1)))"""  # noqa: E731
    before = _running("__spans", "x.e", f"if(x.s < (at), '', if(x.s = (at), '{mark}', concat({piece('(at)', 'x.s')}, '{mark}')))", "greatest((a), (b))", "array<string>")
    last = _let("array_max(transform(__spans, x -> x.e))", "e", f"if(e = length(text), '', {piece('e', 'length(text)')})")
    whole = _let(f"regexp_extract_all(text, '(?s).{{1,{_BLOCK}}}', 0)", "tb", f"concat(array_join({before}, ''), {last})")
    df = df.withColumn("__new", F.when(F.size("__spans") > 0, F.expr(whole)))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    df = df.withColumn("text", F.coalesce("__new", "text"))
    return df.select(safe.columns).toDF(*docs.columns)
