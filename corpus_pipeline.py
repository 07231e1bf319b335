"""From raw documents to packed sequences: five stages, each on what the one before it kept.

Every stage but the last returns the columns it was given, whatever their names.
Null texts are empty, empty tables stay empty. Rows are dropped by doc_id and
row_key, a hash of doc_id and text: what tells dropped rows is broadcast if it is
little, and joined by a shuffle otherwise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.decontaminate import contamination
from corpusmill.llm.exact_dedup import exact_duplicates
from corpusmill.llm.near_dedup import near_duplicates
from corpusmill.llm.packing import pack
from corpusmill.llm.queries import table, word_bpe_path
from corpusmill.llm.toxicity import score, train
from corpusmill.shared import give_back, small, written


def _id() -> F.Column:
    return F.col("doc_id").cast("long")


def row_key() -> F.Column:
    """What operators call row_key."""
    return F.xxhash64(_id(), F.col("text").cast("string"))


def _new_name() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"


def _joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) those of ``rows`` (doc_id, row_key)."""
    own, key = _new_name(), _new_name()
    those = small(rows.select(F.col("doc_id").alias(own), F.col("row_key").alias(key)).distinct())
    return docs.join(those, _id().eqNullSafe(F.col(own)) & (row_key() == F.col(key)), how)


def _one_of_each(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` that are kept; of rows that repeat doc_id and text too, one."""
    decisions = written(decisions.select("doc_id", "row_key", "kept"), "decisions")
    gone = decisions.where("NOT kept").select("doc_id", "row_key")
    again = decisions.where("kept").groupBy("doc_id", "row_key").count().where("count > 1").select("doc_id", "row_key")
    out = _joined(docs, gone.unionByName(again), "left_anti")
    if again.isEmpty():
        return out
    own, key = _new_name(), _new_name()
    one = _joined(docs, again, "left_semi").withColumns({own: _id(), key: row_key()}).dropDuplicates([own, key])
    return out.unionByName(one.drop(own, key))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that a classifier, trained on the rows with labels, finds toxic."""
    give_back(spark)
    return score(docs, train(docs, table(spark, sf_dir, "labels")), keep=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat that too, one."""
    give_back(spark)
    return _one_of_each(docs, exact_duplicates(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts the row with the smallest doc_id; rows without words or doc_id stay."""
    give_back(spark)
    return _joined(docs, near_duplicates(docs).where("NOT kept"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those of which a twentieth of the words or more are passages of the benchmark."""
    give_back(spark)
    found = written(contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "row_key"), "contaminated")
    return _joined(docs, found, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all ``docs`` in sequences."""
    give_back(spark)
    return pack(docs, word_bpe_path())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Stages train a classifier, confirm links and call a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
