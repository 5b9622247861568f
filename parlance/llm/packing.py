"""Packing by vector bin packing: the dot-product heuristic under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._common import materialise
from parlance.llm.bpe import encoder
from parlance.llm.token_files import END_ID

MAX_TOKENS, MAX_SEGMENTS, GROUP_ROWS = 1024, 256, 4096


def place(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in bin) of each item, all limits held in every dimension.

    One bin is filled after another: of the items that still fit, the one whose size has the largest dot product with
    the room left (both as shares of the limits) comes next; ties go to the earlier item. Equal items are one class,
    so a step costs as much as there are different sizes.
    """
    kinds, inverse, counts = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    if len(kinds) and (kinds > limits).any():
        raise ValueError("an item is larger than a bin")
    queues = np.split(np.argsort(inverse.reshape(-1), kind="stable"), np.cumsum(counts)[:-1]) if len(kinds) else []
    taken, share, left = np.zeros(len(kinds), np.int64), kinds / limits, counts.copy()
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    n, total = 0, len(sizes)
    done = 0
    while done < total:
        room, at = limits.astype(np.int64).copy(), 0
        while True:
            fits = (left > 0) & (kinds <= room).all(axis=1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, share @ (room / limits), -1.0)))
            item = queues[k][taken[k]]
            taken[k] += 1
            left[k] -= 1
            bins[item], places[item] = n, at
            room -= kinds[k]
            at += 1
            done += 1
        n += 1
    return bins, places


def pack(items: DataFrame, keys: list[str], limits: dict[str, int], group_rows: int = GROUP_ROWS) -> DataFrame:
    """``items`` with columns sequence_id, position and offset (sum of the first limit's column before it): items share a sequence within all ``limits`` (column: limit).

    Rows are dealt by a hash of their values into groups of ``group_rows`` expected rows, so the result depends on
    the data alone, no group grows with the input, and only these narrow rows are shuffled. Items over a limit raise.
    """
    names, caps = list(limits), np.array(list(limits.values()), np.int64)
    groups = max(1, -(-items.count() // group_rows))
    schema = items.schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*keys, *names], kind="stable", na_position="first").reset_index(drop=True)
        bins, places = place(rows[names].to_numpy(np.int64), caps)
        rows["sequence_id"] = rows["__group"].to_numpy(np.int64) * (1 << 24) + bins
        rows["position"] = places
        order = np.lexsort([places, bins])
        sizes, first = rows[names[0]].to_numpy(np.int64)[order], np.diff(bins[order], prepend=-1) != 0
        ends = np.cumsum(sizes)
        rows.loc[order, "offset"] = ends - sizes - np.maximum.accumulate(np.where(first, ends - sizes, 0))
        rows["offset"] = rows["offset"].astype(np.int64)
        return rows.drop(columns="__group")

    dealt = items.withColumn("__group", F.pmod(F.xxhash64(*keys, *names), F.lit(groups)))
    out = type(schema)([*schema.fields]).add("sequence_id", "long").add("position", "long").add("offset", "long")
    return dealt.groupBy("__group").applyInPandas(run, out)


def pieces(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Documents cut at multiples of ``max_tokens`` ids: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).each
        for batch in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i, found in enumerate(encode(text or "" for text in batch.column(1).to_pylist())):
                ids = memoryview(found + END_ID)
                n = len(ids) // 4
                for at in range(0, n, max_tokens):
                    part = ids[4 * at : 4 * (at + max_tokens)]
                    rows.append(i)
                    starts.append(at)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(n)
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Whole runs of ``max_tokens`` ids are sequences of their own; the rests of documents are packed together. In plain
    documents every id bears loss. Null and empty texts are their end id alone. Rows with a null or repeated doc_id
    are packed like any other. An empty table gives an empty result.
    """
    cut = materialise(pieces(docs, vocabulary, max_tokens), "pieces")
    cut = cut.withColumns({"loss": F.col("length"), "segments": F.lit(1).cast("long")})
    keys = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    placed = pack(cut, keys, {"length": max_tokens, "segments": max_segments, "loss": max_loss})
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
