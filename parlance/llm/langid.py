"""Language ID by interpolated Kneser-Ney character models, one per language, in shared sorted hash arrays.

A text is lower-cased and read as its runs of letters; each word is scored with a space on either side, so the score
of a text is the sum over its words and words are scored once per worker. The language with the lowest cross-entropy
per character wins. Calibration rows, held out of the counts, set the temperature of the score and, per language, the
cross-entropy beyond which a prediction is rejected.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._common import seeded_hash, shielded

WORDS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Params:
    """per_lang: expected sampled rows of a language; max_chars: longer rows aren't sampled. Both bound the fit only."""

    order: int = 5
    per_lang: int = 600
    max_chars: int = 20_000
    seed: int = 17
    alphabet: int = 65_536
    slack: float = 1.5
    min_margin: float = 1.5


def _words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word of each predicted character, is it the first, hash of the n characters that end there for n = 1..order).

    A hash is 0 where fewer than n characters stand in the padded word.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(chars)) - np.repeat(starts, lengths)
    hashes, unit = [], (chars + np.uint64(1)) * _ADD
    for n in range(1, order + 1):
        if n == 1:
            h = unit * _MUL
        else:
            before = np.concatenate([[np.uint64(0)], hashes[-1][:-1]])
            h = (before ^ unit) * _MUL
            h ^= h >> np.uint64(29)
        h[at < n - 1] = 0
        hashes.append(h)
    return np.repeat(np.arange(len(words)), lengths), at, hashes


def fit_language(counts: Counter, p: Params) -> list[dict[str, np.ndarray]]:
    """For each order: sorted gram hashes, their interpolated probability, and the back-off mass of each as a context."""
    words = sorted(counts)
    weight = np.array([counts[w] for w in words], np.float64)
    word, at, hashes = _grams(words, p.order)
    seen = at > 0  # the leading space is never predicted
    raw, grams = weight[word], []
    for n in range(1, p.order + 1):
        ok = seen & (at >= n - 1)
        where = np.flatnonzero(ok)
        gram, first, inverse = np.unique(hashes[n - 1][where], return_index=True, return_inverse=True)
        i = where[first]
        context = hashes[n - 2][i - 1] if n > 1 else np.zeros(len(gram), np.uint64)
        suffix = hashes[n - 2][i] if n > 1 else np.zeros(len(gram), np.uint64)
        grams.append({"gram": gram, "context": context, "suffix": suffix, "raw": np.bincount(inverse, raw[where], len(gram)), "initial": at[i] == n - 1})
    out: list[dict[str, np.ndarray]] = []
    for n, g in enumerate(grams, 1):
        a = g["raw"].copy()
        if n < p.order:  # in how many contexts it stands; grams at a word's start have none
            longer = grams[n]
            found = np.bincount(np.searchsorted(g["gram"], longer["suffix"]), minlength=len(a)).astype(float)
            a = np.where(g["initial"] & (n > 1), a, np.maximum(found, 1))
        ones, twos = (a == 1).sum(), (a == 2).sum()
        d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        context, inverse = np.unique(g["context"], return_inverse=True)
        total = np.bincount(inverse, a)
        mass = d * np.bincount(inverse) / total
        if n == 1:
            lower = np.full(len(a), 1 / p.alphabet)
            base = mass[0] if len(mass) else 1.0
        else:
            lower = out[-1]["p"][np.searchsorted(out[-1]["gram"], g["suffix"])]
            out[-1]["back"] = np.ones(len(out[-1]["gram"]))
            hit = np.searchsorted(out[-1]["gram"], context)
            hit = np.minimum(hit, len(out[-1]["gram"]) - 1)
            same = out[-1]["gram"][hit] == context
            out[-1]["back"][hit[same]] = mass[same]
            out[-1]["space"] = mass[context == hashes[0][0]] if n == 2 and len(hashes[0]) else None
        out.append({"gram": g["gram"], "p": np.maximum(a - d, 0) / total[inverse] + mass[inverse] * lower, "back": np.ones(len(a))})
    out[0]["base"] = np.array([base / p.alphabet])
    return out


class Model:
    """Union of all languages' grams per order: sorted hashes, and log probability and log back-off per language."""

    def __init__(self, langs: list[str], fitted: list[list[dict[str, np.ndarray]]], p: Params):
        self.langs, self.order = langs, p.order
        self.hashes, self.logp, self.back = [], [], []
        self.unseen = np.log([f[0]["base"][0] for f in fitted]).astype(np.float32)
        space = _grams([""], 1)[2][0][0]
        for n in range(p.order):
            union = np.unique(np.concatenate([f[n]["gram"] for f in fitted] + ([np.array([space])] if n == 0 else [])))
            logp = np.full((len(union), len(langs)), np.nan, np.float32)
            back = np.zeros((len(union), len(langs)), np.float32)
            for k, f in enumerate(fitted):
                rows = np.searchsorted(union, f[n]["gram"])
                logp[rows, k] = np.log(f[n]["p"])
                back[rows, k] = np.log(f[n]["back"])
                if n == 0 and f[0].get("space") is not None and len(f[0]["space"]):
                    back[np.searchsorted(union, space), k] = np.log(f[0]["space"][0])
            self.hashes.append(union)
            self.logp.append(logp)
            self.back.append(back)
        self.temperature, self.limit = 1.0, np.full((len(langs), 2), np.inf)

    def _rows(self, n: int, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes[n], h)
        at[at == len(self.hashes[n])] = 0
        return np.where(self.hashes[n][at] == h, at, -1)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (with the space after it) in each language."""
        word, at, hashes = _grams(words, self.order)
        rows = []
        for n in range(self.order):
            found = np.full(len(at), -1)
            ask = np.flatnonzero((at >= n) & (rows[n - 1] >= 0 if n else True))
            found[ask] = self._rows(n, hashes[n][ask])
            rows.append(found)
        where = np.flatnonzero(at > 0)
        out = np.zeros((len(words), len(self.langs)))
        logp = np.broadcast_to(self.unseen, (len(where), len(self.langs))).copy()
        for n in range(self.order):
            usable = at[where] >= n
            hit = rows[n][where]
            here = self.logp[n][np.maximum(hit, 0)]
            known = (hit >= 0)[:, None] & ~np.isnan(here)
            if n:
                context = rows[n - 1][where - 1]
                back = np.where((context >= 0)[:, None], self.back[n - 1][np.maximum(context, 0)], 0)
                lower = logp + back
            else:
                lower = logp
            logp = np.where(usable[:, None], np.where(known, here, lower), logp)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(word[where], logp[:, k], len(words))
        return out


class Scorer:
    """Scores texts; keeps the scores of words seen before, at most ``cap`` of them."""

    def __init__(self, model: Model, cap: int = 200_000):
        self.model, self.cap, self.ids = model, cap, {}
        self.table = np.zeros((cap * 2, len(model.langs)), np.float32)

    def texts(self, texts: list[str | None]) -> list[tuple[np.ndarray, int] | None]:
        """For each text (log probability by language, characters), or None without a letter."""
        out: list = []
        for text in texts:
            words = _words(text) if text else []
            if not words or not has_letter(text):
                out.append(None)
                continue
            total = np.zeros(len(self.model.langs))
            for i in range(0, len(words), self.cap):
                total += self._sum(words[i : i + self.cap])
            out.append((total, sum(map(len, words)) + len(words)))
        return out

    def _sum(self, words: list[str]) -> np.ndarray:
        get = self.ids.get
        rows = [get(w, -1) for w in words]
        if -1 in rows:
            new = list({w for w, r in zip(words, rows, strict=True) if r < 0})
            if len(self.ids) + len(new) > len(self.table):
                self.ids.clear()
                new = list(set(words))
                get = self.ids.get
            start = len(self.ids)
            self.table[start : start + len(new)] = self.model.score_words(new)
            self.ids.update(zip(new, range(start, start + len(new)), strict=True))
            rows = [get(w) for w in words]
        return self.table[rows].sum(axis=0, dtype=np.float64)


def verdict(model: Model, scored: tuple[np.ndarray, int] | None) -> tuple[str, float, float | None, bool]:
    """(language, score from 0 to 1, nats per character, accepted)."""
    if scored is None:
        return UNDETERMINED, 0.0, None, False
    total, n = scored
    entropy = -total / n
    best = int(np.argmin(entropy))
    z = -model.temperature * np.sqrt(n) * (entropy - entropy[best])
    mean, sd = model.limit[best]
    return model.langs[best], float(1 / np.exp(z).sum()), float(entropy[best]), bool(entropy[best] <= mean + sd * (1 + 20 / n))


def calibrate(model: Model, held: list[tuple[str, str]], p: Params) -> None:
    """Temperature of least loss over a grid, and per language mean and tolerated excess of cross-entropy."""
    scored = [(lang, s) for (lang, _), s in zip(held, Scorer(model).texts([t for _, t in held]), strict=True) if s and lang in model.langs]
    if scored:
        index = np.array([model.langs.index(lang) for lang, _ in scored])
        entropy = np.array([-s[0] / s[1] for _, s in scored])
        root = np.sqrt([s[1] for _, s in scored])
        losses = []
        for t in (grid := [0.25, 0.5, 1, 2, 4, 8]):
            z = -t * root[:, None] * entropy
            z -= z.max(axis=1, keepdims=True)
            losses.append(-(z[np.arange(len(z)), index] - np.log(np.exp(z).sum(axis=1))).mean())
        model.temperature = float(grid[int(np.argmin(losses))])
        right = entropy[np.arange(len(index)), index]
        for k in range(len(model.langs)):
            own = right[index == k]
            own = own if len(own) >= 10 else right  # too few rows of its own: those of all languages
            mean = np.median(own)
            model.limit[k] = mean, max(p.slack * (own.max() - mean), p.min_margin)


def train(docs: DataFrame, p: Params = Params()) -> Model | None:
    """Fit on a bounded seeded sample of rows with a language, text and id; None if there is none.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out: neither counted nor used to calibrate.
    """
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, p.per_lang / n))])
    draw = F.pmod(seeded_hash("doc_id", seed=p.seed), F.lit(1 << 30)) / (1 << 30)
    sample = usable.select("lang", "text", draw.alias("draw")).where((F.length("text") <= p.max_chars) & (F.col("draw") < share[F.col("lang")]))
    sample = sample.withColumn("held", F.pmod(F.floor(F.col("draw") * (1 << 30)), F.lit(5)) == 0)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for text in rows.text[~rows.held]:
            counts.update(_words(text))
        held = rows[rows.held]
        file = io.BytesIO()
        if counts:
            np.savez(file, **{f"{n}_{k}": v for n, part in enumerate(fit_language(counts, p)) for k, v in part.items() if v is not None})
        return pd.DataFrame({"lang": [rows.lang.iloc[0]], "model": [file.getvalue()], "held": [held.text.tolist()]})

    parts = sample.select("lang", "text", "held").groupBy("lang").applyInPandas(fit, "lang string, model binary, held array<string>").collect()
    fitted, langs, held = [], [], []
    for row in sorted(parts, key=lambda r: r["lang"]):
        if row["model"]:
            with np.load(io.BytesIO(bytes(row["model"]))) as arrays:
                fitted.append([{k.split("_")[1]: arrays[k] for k in arrays.files if k.startswith(f"{n}_")} for n in range(p.order)])
            langs.append(row["lang"])
            held += [(row["lang"], t) for t in row["held"]]
    if not langs:
        return None
    model = Model(langs, fitted, p)
    calibrate(model, held, p)
    return model


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of each row with lang_pred, score, nats_per_char and accepted.

    Null texts and texts without a letter, and all texts if there was nothing to learn from: `und`, 0, null, false.
    Only the text is read. Repeated rows stay; an empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        scorer = Scorer(fitted) if fitted else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            rows = [verdict(fitted, s) for s in scorer.texts(texts)] if scorer else [verdict(None, None) for _ in texts]
            lang, score, nats, ok = zip(*rows, strict=True) if rows else ((), (), (), ())
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(nats, pa.float64()), pa.array(ok, pa.bool_())]
            yield pa.record_batch([*batch.columns[: len(keep)], *made], names)

    names = [*keep, "lang_pred", "score", "nats_per_char", "accepted"]
    at = keep.index("text") if "text" in keep else len(keep)  # texts are sent once
    inner = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    schema = inner.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("nats_per_char", "double").add("accepted", "boolean")
    return inner.mapInArrow(run, schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the model's nats_per_char and accepted, for every row.

    A null doc_id is never learned from and counts as not held out.
    """
    out = predict(docs, train(docs, p))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "nats_per_char", "accepted")


def accepted_only(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows, in all columns of ``docs``, whose language is told with confidence; rejected rows go.

    Rejected are null texts, texts without a letter, and texts whose cross-entropy is beyond the calibrated limit of
    every language. Further columns of any name stay as they are.
    """
    safe = shielded(docs, "doc_id", "text", "lang")
    return predict(safe, train(safe, p), safe.columns).where("accepted").select(safe.columns).toDF(*docs.columns)
