"""Live dialogues: a batch replay and a stream that keeps each session's turns until the customer quits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import strip, trim_response


def replay(inputs: DataFrame) -> DataFrame:
    """Of (session, seq, text) customer inputs, those before the first `quit` (any case, stripped), numbered from 1."""
    w = Window.partitionBy("session").orderBy("seq")
    quits = F.sum(F.when(F.lower(strip(F.col("text"))) == "quit", 1).otherwise(0)).over(w)
    rows = inputs.withColumn("quits", quits).where("quits = 0")
    return rows.select("session", F.row_number().over(w).alias("n"), strip(F.col("text")).alias("text"))


def two_sided(inputs: DataFrame, prompt: Callable[[Column], Column], generate: Callable[[Column], Column]) -> DataFrame:
    """(session, n, speaker, text): the whole dialogue, agent first, of (session, seq, text) customer inputs.

    Each agent turn is generated from the prompt over all turns before it and trimmed; an input of `quit` ends the
    dialogue before it. The dialogue of a session is one fold over its inputs, in the JVM.
    """
    asked = replay(inputs).groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda t: t.text).alias("texts"))
    asked = inputs.select("session").distinct().join(asked, "session", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    kind = "array<struct<speaker:string,text:string>>"

    def agent(turns: Column) -> Column:
        said = trim_response(generate(prompt(turns)))
        return F.concat(turns, F.array(F.struct(F.lit("agent").alias("speaker"), said.alias("text"))))

    def step(turns: Column, text: Column) -> Column:
        return agent(F.concat(turns, F.array(F.struct(F.lit("customer").alias("speaker"), text.alias("text")))))

    turns = F.aggregate("texts", agent(F.array().cast(kind)), step)
    return asked.select("session", F.posexplode(turns).alias("n", "t")).select("session", (F.col("n") + 1).alias("n"), "t.speaker", "t.text")


_OUT, _STATE = "session string, n long, text string", "n long, closed boolean"


def stream(inputs: DataFrame) -> DataFrame:
    """The same from a stream of (session, seq, text); the state is a count and a flag, whatever the dialogue's length."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, closed = state.get if state.exists else (0, False)
        rows = []
        for batch in batches:
            for text in batch.sort_values("seq").text:
                text = (text or "").strip()
                closed = closed or text.lower() == "quit"
                if not closed:
                    n += 1
                    rows.append((key[0], n, text))
        state.update((n, closed))
        yield pd.DataFrame(rows, columns=["session", "n", "text"])

    return inputs.groupBy("session").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")
