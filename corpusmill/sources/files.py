"""Samples, chunks and results in files, read and written by Spark alone."""

from __future__ import annotations

import io
import json
import textwrap
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from corpusmill.functions.text import not_blank

# Texts that a table reader of the same semantics takes as missing.
NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Quotes are doubled; white space is part of a value.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text, as they are."""
    return spark.read.options(**CSV, multiLine=True).csv(path)


def load_samples(spark: SparkSession, path: str | list[str], label_column: str = "label") -> DataFrame:
    """id, text, label and other columns; rows without text or label go, labels are cut to whole numbers.

    Without a column id, all rows are numbered from 0 in file order.
    """
    df = read_csv(spark, path)
    for name in ("text", label_column):
        if name not in df.columns:
            raise ValueError(f"the file has no column {name!r}; it has {', '.join(df.columns)}")
    if label_column != "label":
        df = df.drop("label").withColumnRenamed(label_column, "label")
    for name in ("text", "label"):
        df = df.withColumn(name, F.when(~F.col(name).isin(*NA), F.col(name)))
    if "id" not in df.columns:
        df = _numbered(df)
    return df.dropna(subset=["text", "label"]).withColumn("label", F.col("label").cast("double").cast("int"))


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` of files with id from 0: Spark's own row ids, whose gaps between partitions are closed by counts."""
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33).alias("_part")
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())  # a row for each partition
    starts = [(p, 0) for p, _ in counts[:1]]
    for (_, n), (p, _) in zip(counts, counts[1:], strict=False):
        starts.append((p, starts[-1][1] + n))
    before = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))
    own = placed.withColumn("_part", part).join(before, "_part")
    return own.withColumn("id", (F.col("_start") + F.col("_at") - F.shiftleft("_part", 33)).cast("string")).drop("_at", "_part", "_start")


def load_by_language(spark: SparkSession, folder: str, languages: list[str], label_column: str = "label") -> DataFrame | None:
    """The files {language}.csv of a folder as one table with column language; None if there are none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x for x in languages if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(hadoop, f"{x}.csv"))]
    out = None
    for x in names:
        own = load_samples(spark, f"{folder}/{x}.csv", label_column).withColumn("language", F.lit(x))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def load_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chunk_id (the file) and text of whole files that are not blank."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("chunk_id"), F.col("value").alias("text"))
    return df.where(not_blank(F.col("text")))


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, StructType | MapType | ArrayType)]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def save_csv(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> str:
    """A folder of CSV files, in folders by the values of column ``by``."""
    out = flat(df).write.mode(mode).options(**CSV)
    (out.partitionBy(by) if by else out).csv(path)
    return path


def filtered_path(path: str) -> str:
    """Where a filtered copy goes by default."""
    stem, dot, _ = path.rpartition(".")
    return f"{stem if dot and '/' not in path[len(stem):] else path}_filtered.csv"


def stamped_path(folder: str, language: str, stamp: str | None = None) -> str:
    return f"{folder.rstrip('/')}/{language}_synthetic{'_' + stamp if stamp else ''}.csv"


def write_json(df: DataFrame, out: TextIO) -> None:
    """All rows as a JSON array, one partition in memory at a time."""
    before = "[\n"
    for row in df.select(F.to_json(F.struct("*"))).toLocalIterator():
        out.write(before + textwrap.indent(json.dumps(json.loads(row[0]), indent=2, ensure_ascii=False), "  "))
        before = ",\n"
    out.write("\n]" if before.startswith(",") else "[]")


def as_json(df: DataFrame) -> str:
    """All rows as a JSON array."""
    out = io.StringIO()
    write_json(df, out)
    return out.getvalue()
