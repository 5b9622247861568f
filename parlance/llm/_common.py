"""Helpers that all training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD_RX = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session that names none, as in tests, gets a temporary folder. On a cluster that raises.
    """
    chosen = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not chosen:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        chosen = tempfile.mkdtemp(prefix="parlance-shared-")
        spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen.rstrip("/")


#: Paths of all tables that ``materialise`` has written, in order.
WRITTEN: list[str] = []


def materialise(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, with the writer's ``options``, and read it again.

    This cuts lineage and survives the loss of any executor, which a local checkpoint does not. Whoever has written the
    result that was made from it may ``discard`` it.
    """
    path = f"{shared_dir(df.sparkSession)}/parlance-{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove written tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shielded(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with all columns but ``used`` under names that no operator uses; ``toDF(*docs.columns)`` undoes it."""
    return docs.toDF(*[c if c in used else f"__kept_{i}" for i, c in enumerate(docs.columns)])


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def seeded_hash(*columns, seed: int):
    """64-bit hash of columns and a seed, equal in every run."""
    return F.xxhash64(F.lit(seed), *columns)


#: Most keys whose rows ``spread_join`` joins by broadcast; and where the other side's rows hold texts.
HOT_KEYS, HOT_TEXTS = 4_000, 64


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None, how: str = "inner", hot_keys: int = HOT_KEYS) -> DataFrame:
    """``left`` joined to ``right``, which has one row of a key, so that a hot key of ``left`` lands in no one task.

    A key is hot if it holds over 1 / ``hot_keys`` of the rows of ``left``, so there are fewer than that: their rows of
    ``right`` are broadcast, all others are joined by key. ``counts`` (key, n) tells how many rows a key has, if that is
    known. Both sides should be written tables, as each is read twice. Null keys join nothing.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    limit = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // hot_keys)
    hot = [r[0] for r in counts.where((F.col("n") > limit) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(~is_hot).join(right, key, how).unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))
