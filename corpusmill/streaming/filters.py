"""The filters of one row over a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.filters import Filter, FilterPipeline


def filtered_stream(stream: DataFrame, pipeline: FilterPipeline) -> DataFrame:
    """``stream`` through a pipeline that has conditions of one row only: no state is kept."""
    for f in pipeline.filters:
        if type(f).apply is not Filter.apply:
            raise ValueError(f"{f.name} looks at other rows and can't run on a stream")
    return pipeline.run(stream)


def counted_stream(stream: DataFrame, at: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """label and n by window of column ``at``; rows later than ``late`` are dropped with their state."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), "label").agg(F.count(F.lit(1)).alias("n"))


def counts_to(counted: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts of everything there is now, as changes by batch in ``path``.

    A batch that is run again after a failure writes the same folder again, and
    a rerun goes on from ``checkpoint``, with its state.
    """

    def save(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/changes-{batch}")

    return counted.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """window, label and n as the last batch that changed them left them."""
    changes = spark.read.parquet(f"{path}/changes-*")
    return changes.groupBy("window", "label").agg(F.max_by("n", "batch").alias("n"))


def run_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, as Parquet in ``path``; a rerun goes on from ``checkpoint``."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
