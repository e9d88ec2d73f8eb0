"""Evaluation metrics and alignment-column statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from protoscan.operators.ordered import in_order, running_sum


def rmse(observed: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((predicted - observed) * (predicted - observed)))


def squared_pearson(observed: Column, predicted: Column) -> Column:
    r = F.corr(observed, predicted)
    return r * r


def describe(x: Column) -> list[Column]:
    """Mean, population variance and deviation, and sum of squares."""
    return [F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("deviation"), F.sum(x * x).alias("sum_of_squares")]


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rows ``value`` and their average rank, one per distinct value.

    Equal values are counted before any shuffle, then the counts of the distinct values are
    summed up in order, so a value shared by most rows costs no more than a rare one.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    summed = running_sum(in_order(counts, [F.col(value).asc()]), F.col("_n"), "_upto")
    return summed.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))


def squared_spearman(df: DataFrame, observed: str, predicted: str, out: str = "squared_spearman") -> DataFrame:
    """Squared rank correlation, from pair counts joined with the ranks of both sides."""
    pairs = df.select(observed, predicted).filter(F.col(observed).isNotNull() & F.col(predicted).isNotNull())
    weighted = pairs.groupBy(observed, predicted).agg(F.count("*").alias("_w"))
    ranked = (
        weighted.join(average_ranks(pairs, observed, "_x"), observed)
        .join(average_ranks(pairs, predicted, "_y"), predicted)
    )
    w, x, y = F.col("_w"), F.col("_x"), F.col("_y")
    sums = ranked.agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return sums.select((cov * cov / (vx * vy)).alias(out))


def letter_counts(aligned: DataFrame, seq: str = "seq", by: list[str] | None = None) -> DataFrame:
    """Counts of A, C, G and T per alignment column (1-based) over all sequences."""
    return (
        aligned.select(*(by or []), F.posexplode(F.split(F.upper(F.col(seq)), "")).alias("_p", "letter"))
        .filter(F.col("letter").isin("A", "C", "G", "T"))
        .groupBy(*(by or []), (F.col("_p") + 1).cast("bigint").alias("position"), "letter")
        .agg(F.count("*").alias("n"))
    )


def column_entropy(aligned: DataFrame, seq: str = "seq", by: list[str] | None = None) -> DataFrame:
    """Entropy per column: minus the sum of count * log2(share) over the four letters.

    The factor is the count, not the share; gaps are left out of the shares.
    """
    keys = (by or []) + ["position"]
    wide = letter_counts(aligned, seq, by).groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("letter") == x, F.col("n"))), F.lit(0)).alias(x) for x in "ACGT"])
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    entropy = F.lit(0.0)
    for x in "AGCT":
        entropy = entropy - F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / total)).otherwise(F.lit(0.0))
    return wide.select(*keys, entropy.alias("entropy"))


def mean_column_entropy(aligned: DataFrame, seq: str = "seq") -> DataFrame:
    """Mean entropy over the columns, and the number of sequences."""
    length = aligned.agg(F.max(F.length(seq)).alias("_columns"), F.count("*").alias("sequences")).withColumn("_one", F.lit(1))
    total = column_entropy(aligned, seq).agg(F.coalesce(F.sum("entropy"), F.lit(0.0)).alias("_sum")).withColumn("_one", F.lit(1))
    return length.join(total, "_one").select((F.col("_sum") / F.col("_columns")).alias("mean_entropy"), "sequences")
