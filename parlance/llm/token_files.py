"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm._common import shared_dir
from parlance.llm.bpe import encoder

END_ID = b"\0\0\0\0"
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}
#: Rows of a batch on the way to and from Python: long texts make large rows.
_TARGET = 4 << 20


def tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids): ids of every whole text with the end id 0 after them. Null and empty texts: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).each
        for batch in batches:
            start, parts, size = 0, [], 0
            for i, ids in enumerate(encode(text or "" for text in batch.column(1).to_pylist()), 1):
                parts.append(ids + END_ID)
                size += len(parts[-1])
                if size >= _TARGET or i == batch.num_rows:
                    yield pa.record_batch([batch.column(0).slice(start, i - start), _lists(parts)], ["doc_id", "ids"])
                    start, parts, size = i, [], 0

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def _lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))]))


def write(docs: DataFrame, vocabulary: str, path: str, partitions: int | None = None) -> None:
    """Write ids as ORC, each file a range of ascending doc_id (null ids first), sorted within.

    Texts, which are smaller than their ids, are dealt out by range; then each task encodes and writes its range.
    """
    ranged = docs.select(F.col("doc_id").cast("long"), "text")
    ranged = ranged.repartitionByRange(partitions, "doc_id") if partitions else ranged.repartitionByRange("doc_id")
    tokenised(ranged.sortWithinPartitions("doc_id", "text"), vocabulary).write.options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) as written; filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def digests(stored: DataFrame) -> DataFrame:
    """Per stored row: doc_id, start (ids of all rows before it), n_tokens, ids_crc32.

    Order is doc_id, nulls first, then the ids' length and checksum, so rows that share an id have a defined order.
    The global prefix sum is two sums: over files' totals (as many rows as files), and within each file's range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            base, data = int(ends[0]), memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(data[4 * (i - base) : 4 * (j - base)]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "ids_crc32", "file"])

    from parlance.llm._common import materialise

    rows = stored.select("doc_id", "ids", F.col("_metadata.file_name").alias("file"))
    rows = materialise(rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, file string"), "token-digests")
    files = rows.groupBy("file").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy(F.col("low").asc_nulls_first(), F.col("high").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Write the files, read them back and give their digests. An empty table gives an empty result."""
    path = path or f"{shared_dir(docs.sparkSession)}/parlance-tokens-{uuid.uuid4().hex}"
    write(docs, vocabulary, path)
    return digests(read(docs.sparkSession, path))
