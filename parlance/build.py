"""Packed training examples from raw transcripts: ``python -m parlance.build --data-file .. --output-dir ..``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.config import Config, parse_args
from parlance.operators import examples, transcripts
from parlance.sources import io


def packed(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """Examples of the converted conversations in a JSON-lines file, packed to fixed lengths.

    A malformed line, a missing column or a file without rows raises.
    """
    raw = transcripts.require_rows(transcripts.require_columns(io.read_jsonl(spark, path), "conversation_id", "label", "transcript"))
    chosen = transcripts.with_min_turns(transcripts.converted(transcripts.parse(raw)), config.min_turns_training)
    rows = examples.examples(chosen, config.history_turns, config.min_agent_tokens, config.context_rate, config.system_prompt)
    return examples.pack(rows, config.max_seq_len, config.label_mask)


def main(argv: list[str] | None = None) -> None:
    args = parse_args(argv)
    spark = SparkSession.builder.appName("parlance-build").getOrCreate()
    packed(spark, args.data_file, Config(max_seq_len=args.max_seq_len)).write.mode("overwrite").parquet(args.output_dir)


if __name__ == "__main__":
    main()
