"""Library call: scores of guides against their 29-letter contexts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from protoscan.operators.model import TreeEnsemble
from protoscan.plans.pair_scoring import score_pairs


def predict_cleavage_score(spark: SparkSession, guides: Sequence[str], contexts: Sequence[str], shape_table, model: TreeEnsemble) -> DataFrame:
    """Rows position, guide, context, score; the lists are taken pair by pair.

    The model is that of 29-letter contexts: a pair with another context, 223 letters included, is rejected like one
    with a bad guide, and has a null score. For tables of pairs use ``score_pairs``.
    """
    if len(guides) != len(contexts):
        raise ValueError("there must be one context per guide")
    rows = [(i, g, c) for i, (g, c) in enumerate(zip(guides, contexts))]
    pairs = spark.createDataFrame(rows, "position bigint, guide string, context string")
    scored, rejected = score_pairs(pairs, shape_table, {"noflanking": model})
    columns = ["position", "guide", "context", "score"]
    return scored.select(columns).unionByName(rejected.selectExpr("position", "guide", "context", "cast(null as double) as score")).orderBy("position")
