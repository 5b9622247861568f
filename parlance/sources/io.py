"""Sources and sinks: JSON lines, CSV, Parquet, append-only caches, the window index, studies."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.ratings import RATINGS, latest  # noqa: F401

RAW = "conversation_id string, label int, transcript string"
EXAMPLES = "conversation_id string, target_turn_index int, prefix string, target string, full_text string, cleaned_target string"
SUMMARIES = "key string, summary string, seq long"
TRIALS = "trial int, value double, n_ratings long"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only for a local session that names none."""
    chosen = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not chosen:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        chosen = tempfile.mkdtemp(prefix="parlance-shared-")
        spark.conf.set("spark.checkpoint.dir", chosen)
    return f"{chosen.rstrip('/')}/parlance-{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """A malformed line raises, as silent nulls would shrink the data."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Training examples; the cleaned target where there is one. No rows or a null target raise."""
    df = read_jsonl(spark, path, EXAMPLES).withColumn("target", F.coalesce("cleaned_target", "target")).drop("cleaned_target")
    if df.isEmpty():
        raise ValueError("no training examples")
    if not df.where("target is null or prefix is null").isEmpty():
        raise ValueError("an example lacks its prefix or target")
    return df


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, non-ASCII characters as they are, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_cache(spark: SparkSession, path: str, value: str, schema: str) -> DataFrame:
    """(key, value): the last write of each key, by its sequence number."""
    return latest(spark.read.schema(schema).json(path), "key", value)


def write_index(vectors: DataFrame, metadata: DataFrame, path: str) -> None:
    """Vectors (state_id, window, vec) and metadata (state_id, ..) side by side."""
    vectors.write.parquet(f"{path}/vectors")
    metadata.write.parquet(f"{path}/metadata")


def read_index(spark: SparkSession, path: str, known: tuple[str, ...], dims: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(vectors, metadata, windows present); raises without a known window, on a wrong width, or where keys differ."""
    vectors, metadata = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/metadata")
    present = {r[0] for r in vectors.select("window").distinct().limit(1000).collect()}
    windows = [w for w in known if w in present]
    if not windows:
        raise ValueError("the index has no known window")
    if dims is not None and not vectors.where(F.size("vec") != dims).isEmpty():
        raise ValueError(f"a vector does not have {dims} dimensions")
    keys = vectors.select("state_id").distinct()
    if not keys.join(metadata, "state_id", "left_anti").isEmpty() or not metadata.join(keys, "state_id", "left_anti").isEmpty():
        raise ValueError("vectors and metadata do not have the same states")
    return vectors, metadata, windows


def write_weights(weights: dict[str, float], path: str, spark: SparkSession) -> None:
    """Best weights as one JSON object in a text file."""
    import json

    spark.createDataFrame([(json.dumps(weights),)], "value string").coalesce(1).write.text(path)


def read_weights(path: str, spark: SparkSession) -> dict[str, float]:
    import json

    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))


def append_trials(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
