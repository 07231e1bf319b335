"""Sampling that depends on ids and a seed alone, so it can be repeated and tested."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import draw, pick
from corpusmill.shared import small, written


def balanced(df: DataFrame, n_per_class: int, label: str = "label", seed: int = 42) -> DataFrame:
    """At most n_per_class rows of each label, without replacement. Needs a column id.

    Spark turns the rank filter into a per-task limit (WindowGroupLimit) first, so
    no label's rows are gathered whole.
    """
    order = Window.partitionBy(label).orderBy(draw(seed, F.col("id")), F.col("id"))
    ranked = df.where(F.col(label).isNotNull()).withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= n_per_class).drop("_rank")


def numbered(df: DataFrame, by: Sequence[str] = (), order: str | Sequence[str] = "id") -> DataFrame:
    """rn from 0 by ``order``, within groups: by counting partitions, not by one task for all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [order] if isinstance(order, str) else list(order)
    keys = [*by, *order]
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    placed = written(placed, "placed")
    counts = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = placed.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1)
    return own.join(F.broadcast(before), [*by, "_part"]).withColumn("rn", (F.col("_rn") + F.col("_before")).cast("long")).drop("_part", "_rn", "_before")


def _keyed(df: DataFrame) -> DataFrame:
    """``df`` with _row, a hash of the whole row: with id it tells rows apart that are not alike."""
    return df.withColumn("_row", F.xxhash64(*[F.col(c) for c in df.columns]))


def _drawn(df: DataFrame, draws: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` that draws (draw_no, by, rn) fall on: only ids are numbered, so no text moves but those drawn."""
    keyed = _keyed(df)
    places = numbered(keyed.select(*by, "id", "_row"), by, ["id", "_row"])
    hit = written(draws.join(places, [*by, "rn"]).select("draw_no", "id", "_row"), "drawn")
    rows = keyed.join(small(hit.select("id", "_row").distinct()), ["id", "_row"], "left_semi").dropDuplicates(["id", "_row"])
    return hit.join(rows, ["id", "_row"]).select("draw_no", *df.columns)


def with_replacement(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """draw_no and the columns of the row that each of ``n`` draws falls on."""
    total = df.count()
    if not total:
        raise ValueError("nothing to draw from")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw_no"), F.pmod(draw(seed, F.col("id")), F.lit(total)).alias("rn"))
    return _drawn(df, draws)


def balanced_with_replacement(df: DataFrame, n: int, label: str = "label", seed: int = 42) -> DataFrame:
    """``n`` draws, equally many for each label there is; the lowest labels get one more.

    Draws are numbered through: those of the lowest label come first.
    """
    sizes = [(r[0], r[1]) for r in df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(label).collect()]
    if not sizes:
        raise ValueError("nothing to draw from")
    out, first = None, 0
    for i, (value, size) in enumerate(sizes):
        many = n // len(sizes) + (i < n % len(sizes))
        own = df.sparkSession.range(first, first + many).select(F.col("id").alias("draw_no"), F.lit(value).alias(label), F.pmod(draw(seed, F.col("id")), F.lit(size)).alias("rn"))
        out, first = own if out is None else out.unionByName(own), first + many
    return _drawn(df.where(F.col(label).isNotNull()), out, [label])


def topic_of(topics: dict[str, list[str]] | None, seed: int, index: Column) -> Column:
    """A category, then a topic in it, both drawn for ``index``; null without topics."""
    if not topics:
        return F.lit(None).cast("string")
    groups = F.array(*[F.array(*[F.lit(t) for t in listed]) for listed in topics.values()])
    group = F.element_at(groups, (F.pmod(draw(seed, "category", index), F.lit(len(topics))) + 1).cast("int"))
    return pick(group, draw(seed, "topic", index))
