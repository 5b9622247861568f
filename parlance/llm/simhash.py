"""SimHash near-duplicates, linked through Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import golay
from parlance.llm._common import materialise, shielded, spread_join
from parlance.llm.components import connected_components

SHINGLE_WORDS, MAX_BITS = 3, 2
#: Buckets of up to so many fingerprints are verified pair by pair.
BLOCK = 64
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text: bit i is set if over half of the shingle hashes have it set."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return h(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.diff(ends, prepend=0)).tolist()
    n = len(words) - shingle_words + 1
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = np.array([h(line[i:j], 42) for i, j in zip(starts[at : min(n, at + _CHUNK)], stops[at : at + _CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): signed 64-bit fingerprint of every whole text; null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def links(reps: DataFrame) -> DataFrame:
    """(a, b): links that join all distinct fingerprints ``fp`` at most two bits apart, directly or by a chain of links.

    Fingerprints that share a Golay key meet in its bucket, and those of a bucket of up to ``BLOCK`` are verified there.
    Only in larger buckets, whose pairs could be many, fingerprints get their 65 neighbours within one bit: two
    fingerprints are at most two bits apart if and only if they have a neighbour in common, and no neighbour belongs to
    more than 65 fingerprints, so links stay in proportion to fingerprints. A key has about 34 bits, so buckets that
    large come from groups of near copies, not from a corpus' size, up to some 10^11 different fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            rows, keys = golay.fuzzy_keys(np.ascontiguousarray(fps))
            yield pa.record_batch([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])

    keyed = reps.select("fp").mapInArrow(run, "key long, fp long")
    keyed = materialise(keyed, "golay-keys")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    buckets = materialise(buckets, "golay-buckets")
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS
    pairs = buckets.where((F.col("n") == 2) & close(F.col("a"), F.col("b"))).select("a", "b")
    shared = materialise(spread_join(keyed, buckets.where("n > 2").select("key", "n"), "key", buckets.select("key", "n")), "golay-shared")
    blocks = shared.where(F.col("n") <= BLOCK).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    later = f"transform(fps, (x, i) -> transform(filter(slice(fps, i + 2, {BLOCK}), y -> bit_count(x ^ y) <= {MAX_BITS}), y -> named_struct('a', x, 'b', y)))"
    verified = blocks.select(F.explode(F.expr(f"flatten({later})")).alias("p")).select("p.a", "p.b").distinct()
    crowded = shared.where(F.col("n") > BLOCK).select("fp").distinct()
    near = crowded.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("near"))
    stars = near.groupBy("near").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    stars = stars.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()
    return pairs.union(verified).union(stars)


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, fingerprint as 16 hex digits, component_id).

    component_id is the smallest doc_id that links of at most two differing bits reach. Texts without a word (null,
    empty, white space) have fingerprint zero and are linked like any other. Rows with a null doc_id keep their row;
    a component of only such rows has a null id. Repeated rows stay repeated. An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, shingle_words), "fingerprints")
    reps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "representatives")
    parts = materialise(connected_components(links(reps)), "components")
    ids = materialise(least_ids(reps.select(F.col("fp").alias("node"), "first_id"), parts), "component-ids").withColumnRenamed("node", "fp")
    rows = spread_join(prints, ids, "fp", reps.select("fp", "n"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def least_ids(reps: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, component_id) of every row of ``reps`` (node, first_id): the smallest first_id of the node's component.

    Nodes that ``parts`` (node, component) lacks are components of their own.
    """
    linked = materialise(reps.join(parts, "node"), "linked")
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    least = materialise(least, "least-ids")
    linked = spread_join(linked, least.select("component", "component_id"), "component", least.select("component", "n")).select("node", "component_id")
    alone = reps.join(parts, "node", "left_anti").select("node", F.col("first_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """Documents without near-copies: of each component the row with the smallest doc_id stays, in all its columns.

    ``groups`` gives doc_id and component_id of every row. Rows with a null doc_id have no identity to decide by and stay. Of repeated rows with one doc_id and text one
    stays. Further columns of any name stay as they are.
    """
    safe = shielded(docs, "doc_id", "text")
    chosen = groups(safe).where("doc_id = component_id").select("doc_id").distinct()
    kept = safe.where("doc_id is not null").join(chosen, "doc_id", "left_semi").withColumn("__text_hash", F.xxhash64("text"))
    kept = kept.dropDuplicates(["doc_id", "__text_hash"])
    return kept.select(safe.columns).unionByName(safe.where("doc_id is null")).toDF(*docs.columns)
