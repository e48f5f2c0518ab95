"""Batch scoring of distinct sequences by a model that the user brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes sequences, gives for each its per-position predictions.
Scorer = Callable[[list[str]], list[list[float]]]


def score_sequences(df: DataFrame, scorer: Scorer, batch: int = 32, key: str = "sequence_id", sequence: str = "sequence", limit: int | None = None) -> DataFrame:
    """(sequence, sequence_id, position_id, prediction): each distinct (id, sequence) is scored once, in batches of
    ``batch``, cut to ``limit`` letters if given; a null sequence has no position."""
    text = F.substring(sequence, 1, limit) if limit else F.col(sequence)
    rows = df.select(F.col(key).alias("sequence_id"), text.alias("sequence")).where("sequence is not null").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), batch):
                part = frame.iloc[low : low + batch]
                yield part.assign(predictions=[list(map(float, p)) for p in scorer(part.sequence.tolist())])

    id_type = rows.schema["sequence_id"].dataType.simpleString()
    scored = rows.mapInPandas(run, f"sequence_id {id_type}, sequence string, predictions array<double>")
    return scored.select("sequence", "sequence_id", F.posexplode("predictions").alias("position_id", "prediction"))


def only_new(sequences: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Sequences without a stored prediction of the model."""
    return sequences.join(stored.where(F.col("model") == model).select("sequence").distinct(), "sequence", "left_anti")


def scored_once(spark, sequences: DataFrame, path: str, model: str, scorer: Scorer) -> DataFrame:
    """All predictions at ``path`` of the model, after those of new sequences were scored and appended. The run's name
    is the model's and the number of its runs before, so that a run that was killed is written again in its place."""
    from helixbench.sources.files import append_result, finished_runs, read_results

    known = read_results(spark, path)
    if known is not None:
        sequences = only_new(sequences, known, model)
    run = f"{model}-{sum(r.rpartition('-')[0] == model for r in finished_runs(spark, path))}"
    append_result(score_sequences(sequences, scorer).withColumn("model", F.lit(model)), path, run)
    return read_results(spark, path).where(F.col("model") == model).drop("run")
