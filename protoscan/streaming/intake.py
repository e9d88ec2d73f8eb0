"""Scoring of guide/site pairs as they arrive.

Checking, alignment, features and scoring look at one row at a time, so the batch plan
runs on a stream unchanged and needs no state or watermark. Scored and rejected rows go to
two sinks, each with its own checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from protoscan.operators.model import TreeEnsemble
from protoscan.plans.pair_scoring import score_pairs

PAIR_SCHEMA = "id string, guide string, context string"


def read_pair_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """New CSV files (id, guide, context; no header) in a folder."""
    return spark.readStream.schema(PAIR_SCHEMA).option("maxFilesPerTrigger", per_trigger).csv(path)


def start_scoring(pairs: DataFrame, shape_table, models: dict[str, TreeEnsemble], out: str, checkpoints: str, once: bool = False) -> tuple[StreamingQuery, StreamingQuery]:
    """Start writing Parquet to ``out``/scored and ``out``/rejected; ``once`` stops when caught up."""
    started = []
    for name, df in zip(("scored", "rejected"), score_pairs(pairs, shape_table, models)):
        writer = df.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{checkpoints}/{name}")
        started.append((writer.trigger(availableNow=True) if once else writer).start())
    return started[0], started[1]
