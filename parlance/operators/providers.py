"""Seams for models, with deterministic stand-ins. A provider maps a text column to a column; models stay outside."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import hash32
from parlance.operators.vectors import EPSILON


#: Texts that are Python strings at once; a whole batch of long ones takes much memory.
TEXTS = 512


class HashedEmbedder:
    """Feature hashing of lower-cased words: bucket and sign from the MD5 of the word; keeps the words that it has seen."""

    def __init__(self, dims: int = 64, cap: int = 200_000):
        self.dims, self.cap, self.known = dims, cap, {}

    def _hash(self, word: str) -> int:
        if word not in self.known:
            if len(self.known) >= self.cap:
                self.known.clear()
            self.known[word] = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
        return self.known[word]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            h = np.array([self._hash(w) for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w], np.int64)
            np.add.at(out[i], h % self.dims, np.where(h // self.dims % 2 == 0, 1.0, -1.0))
        return out


def embed_distinct(windows: DataFrame, dims: int = 64, provider: Callable[[], Callable[[list], np.ndarray]] | None = None) -> DataFrame:
    """Adds ``vec``, normalised, to (.., window, text) rows; equal texts are embedded once.

    ``provider`` makes an embedder, once in each task: a function from texts to a matrix of ``dims`` columns. Null texts
    have no vector and no row.
    """
    make, texts_at_once = provider or (lambda: HashedEmbedder(dims)), TEXTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make()
        for whole in batches:
            for at in range(0, whole.num_rows, texts_at_once):
                batch = whole.slice(at, texts_at_once)
                m = np.asarray(embed(batch.column(0).to_pylist()), np.float64).reshape(batch.num_rows, dims)
                unit = m / (np.linalg.norm(m, axis=1, keepdims=True) + EPSILON)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * dims), pa.array(unit.reshape(-1)))
                yield pa.record_batch([batch.column(0), lists], ["text", "vec"])

    texts = windows.select("text").where("text is not null").distinct().mapInArrow(run, "text string, vec array<double>")
    return windows.join(texts, "text")


def summary_of(text: Column) -> Column:
    return F.concat(F.lit("Turns: "), F.size(F.split(text, "\n")).cast("string"), F.lit("; begins: "), F.substring(text, 1, 60))


def judge_of(similarity: Column) -> Column:
    """A stand-in judge's answer as text: 1 to 5 by similarity."""
    return (F.lit(1) + F.floor(F.lit(4) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity)))).cast("int").cast("string")


def reply_to(prompt: Column) -> Column:
    """A stand-in generator: an echo that runs on past the stop marker."""
    return F.concat(F.lit(" Noted: "), F.right(prompt, F.lit(40)), F.lit("<|customer|>and on"))


def base_reply_to(prompt: Column) -> Column:
    """A stand-in for the generator before tuning: a shorter echo."""
    return F.concat(F.lit(" Base: "), F.right(prompt, F.lit(36)), F.lit("<|customer|>and on"))


def synthetic_transcripts(spark, n: int = 10, seed: int = 42) -> DataFrame:
    """(conversation_id, label, transcript): an even number of lines from 10 to 30, agents first; by hash."""
    rows = spark.range(n).select(F.format_string("fake_%03d", "id").alias("conversation_id"), F.lit(1).alias("label"), (hash32(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))) % 11 + 5).alias("half"))
    line = "transform(sequence(1, int(half * 2)), i -> concat(if(i % 2 = 1, 'agent', 'customer'), '(u', i, '): Line ', i, ' of ', conversation_id))"
    return rows.select("conversation_id", "label", F.array_join(F.expr(line), "\n").alias("transcript"))
