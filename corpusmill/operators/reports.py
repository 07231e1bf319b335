"""Counts for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """label and n, without rows that have no label."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def language_summary(df: DataFrame, languages: Sequence[str]) -> DataFrame:
    """language, n and status of each language asked for, and their total under TOTAL."""
    asked = df.sparkSession.createDataFrame([(x,) for x in languages], "language string")
    counts = df.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    each = asked.join(counts, "language", "left").fillna(0, ["n"])
    out = each.rollup("language").agg(F.sum("n").alias("n"))
    return out.select(F.coalesce("language", F.lit("TOTAL")).alias("language"), "n", F.when(F.col("n") > 0, "ok").otherwise("FAIL").alias("status"))


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select(label).where(F.col(label).isNotNull()).distinct()
