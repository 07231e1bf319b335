"""Texts of up to a million characters and more, with copies, through every operator of documents."""

import random

import pytest
from helpers import documents, rows

from corpusmill.llm import exact_dedup, near_dedup, packing, pii, secrets, substring_dedup, toxicity
from corpusmill.llm.decontaminate import contamination
from corpusmill.llm.queries import word_bpe_path


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    own = " ".join(words)
    return [own, own.upper(), own + " and a tail", "x" * 1_000_000, "y " * 200_000, None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts).cache()


def test_exact(docs):
    assert rows(exact_dedup.exact_duplicates(docs), "doc_id", "keep_id") == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_near(docs):
    assert rows(near_dedup.near_duplicates(docs), "doc_id", "component_id") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 5)]


def test_repeats(docs, texts):
    got = rows(substring_dedup.without_repeats(docs), "doc_id", "n_words", "n_removed", "text")
    assert [r[1:3] for r in got] == [(200_000, 200_000), (200_000, 0), (200_003, 200_000), (1, 0), (200_000, 200_000), (0, 0)] and got[2][3] == "and a tail"


def test_passages(spark, docs, texts):
    passage = " ".join(texts[0].split()[150_000:150_020])
    items = spark.createDataFrame([("a", passage), ("b", "y " * 30), ("c", None)], "item_id string, text string")
    got = rows(contamination(docs, items), "doc_id", "n_words", "n_hit", "n_items")
    assert got == [(0, 200_000, 20, 1), (1, 200_000, 20, 1), (2, 200_003, 20, 1), (3, 1, 0, 0), (4, 200_000, 200_000, 1), (5, 0, 0, 0)]


def test_scans(spark):
    rng = random.Random(2)
    filler = " ".join(f"w{rng.randrange(10**4)}x" for _ in range(150_000))
    docs = documents(spark, [filler + " mail a@b.example.org password=abcdef12 end", None])
    assert [(s["kind"], s["end"] - s["start"]) for s in pii.personal_data(docs).orderBy("doc_id").head()["spans"] if s["kind"] == "email"] == [("email", 15)]
    assert [s["kind"] for s in secrets.secrets(docs).orderBy("doc_id").head()["spans"] if s["start"] > len(filler)] == ["assign"]


def test_packing_and_scores(spark, docs):
    pieces = packing.pack(docs, word_bpe_path()).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == {i: sum(r["length"] for r in pieces if r["doc_id"] == i) for i in range(6)}
    assert len(rows(toxicity.toxicity(docs, spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, toxic int")))) == 6
