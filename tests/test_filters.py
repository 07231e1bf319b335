import random

import pytest
from pyspark.sql import functions as F

from corpusmill.config import TaskSpec
from corpusmill.operators import filters as O
from corpusmill.operators import reports, sampling, similarity

TASK = TaskSpec("t", {0: "good", 1: "bad"}, "d", marker_keywords={1: ["terrible", "awful", "horrible"]})


def frame(spark, texts, labels=None):
    rows = [(i, f"s_{i}", t, (labels or [0] * len(texts))[i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "ord long, id string, text string, label int")


def kept(df):
    return [r[0] for r in df.select("ord").orderBy("ord").collect()]


def test_basic(spark):
    df = frame(spark, ["hello world test", "", None, "another good text", " "])
    assert kept(O.BasicFilter(min_length=5).apply(df)) == [0, 3]
    df = frame(spark, ["short", "a" * 2000, "This is a normal length text.", "😀" * 10])
    assert kept(O.BasicFilter(min_length=10, max_length=100).apply(df)) == [2, 3]
    assert kept(O.BasicFilter([1], 0).apply(frame(spark, ["a", "b", "c"], [0, 1, None]))) == [1]


def test_leakage(spark):
    texts = ["This is classified as positive", "A normal text without issues", "label: 1 this is positive", "claſſ: x", "class = y", None, "subclass bad thing", "The classification for this text is negative. Bad product."]
    assert kept(O.LeakageFilter().apply(frame(spark, texts))) == [1, 5, 6, 7]
    assert kept(O.LeakageFilter(TASK.labels).apply(frame(spark, texts))) == [1, 5, 7]


def test_markers(spark):
    df = frame(spark, ["Terrible product", "nice day", "just ok", None], [1, 1, 0, 1])
    assert kept(O.MarkerFilter(TASK).apply(df)) == [0, 2]
    assert kept(O.MarkerFilter(TASK, 2).apply(df)) == [2]


def test_judge(spark):
    df = frame(spark, ["a", "b", "c", "d"])
    answers = F.element_at(F.array(F.lit('{"realistic": true, "label_correct": true, "natural_language": true, "no_artifacts": true}'), F.lit("no json"), F.lit(None).cast("string"), F.lit('{"realistic": "true", "label_correct": true, "natural_language": true, "no_artifacts": true}')), (F.col("ord") + 1).cast("int"))
    judge = lambda d: d.withColumn("raw", answers)
    assert kept(O.JudgeFilter(judge).apply(df)) == [0, 2]
    assert kept(O.JudgeFilter(judge, on_unparsed="keep").apply(df)) == [0, 1, 2]
    bad = lambda d: d.withColumn("raw", F.lit("no"))
    assert len(kept(O.JudgeFilter(bad, 0.5).apply(df))) == 2 and len(kept(O.JudgeFilter(bad, 0.0).apply(df))) == 3
    assert kept(O.JudgeFilter(bad, 0.5).apply(df.limit(0))) == []


def test_translation_filter(spark):
    df = spark.createDataFrame([(0, "a b c", "a b c"), (1, "x", "a b c"), (2, None, "a")], "ord long, back_translated string, english_original string")
    assert kept(O.TranslationQualityFilter().apply(df)) == [0, 2]
    assert kept(O.TranslationQualityFilter().apply(df.drop("english_original"))) == [0, 1, 2]


def test_pipeline_and_statistics(spark):
    df = frame(spark, ["good text here", "", "this is classified as positive", "another good one"])
    pipe = O.FilterPipeline.default(TASK, use_embeddings=False)
    assert kept(pipe.run(df)) == [0, 3]
    assert [tuple(r) for r in pipe.statistics(df).orderBy("stage").collect()] == [(1, "BasicFilter", 4, 3, 1), (2, "LeakageFilter", 3, 2, 1), (3, "MarkerFilter", 2, 2, 0)]
    assert kept(O.FilterPipeline.default(TASK).run(df)) == [0, 3]
    assert O.FilterPipeline.default(TASK, use_embeddings=False).add(O.BlocklistFilter(["ANOTHER"])).run(df).count() == 1


def greedy(n, close):
    stay = []
    for j in range(n):
        if not any(close(i, j) for i in stay):
            stay.append(j)
    return stay


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_sparse_dedup_equals_a_loop(spark, threshold):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(8))) for _ in range(120)] + [None, ""]

    def counts(t):
        words = (t or "").split()
        return {w: words.count(w) for w in words}

    def close(i, j):
        a, b = counts(texts[i]), counts(texts[j])
        dot = sum(a[w] * b.get(w, 0) for w in a)
        p = round(threshold * 100)
        return dot > 0 and dot * dot * 10_000 >= p * p * sum(v * v for v in a.values()) * sum(v * v for v in b.values())

    got = kept(similarity.SimilarityDeduplicator(threshold).apply(frame(spark, texts)))
    assert got == greedy(len(texts), close)


def test_dense_dedup_cases(spark):
    def vectors(*rows):
        return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(rows)], "ord long, vector array<float>")

    dedup = similarity.SimilarityDeduplicator(0.7, encoder=lambda d: d)
    assert kept(dedup.apply(vectors((1, 0), (1, 0.9), (0.1, 1)))) == [0, 2]  # a chain: the second goes, the third stays
    assert kept(dedup.apply(vectors((0, 0), (0, 0)))) == [0, 1]
    # The second is tied to the first only; the first is tied to the reference: both go.
    both = similarity.SimilarityDeduplicator(0.7, encoder=lambda d: d, original=vectors((1, -0.9)))
    assert kept(both.apply(vectors((1, 0), (1, 0.9)))) == []


def test_sampling(spark):
    df = spark.createDataFrame([(str(i), i % 3 if i % 7 else None) for i in range(60)], "id string, label int")
    got = sampling.balanced(df, 5)
    assert {r[0]: r[1] for r in got.groupBy("label").count().collect()} == {0: 5, 1: 5, 2: 5}
    assert sorted(sampling.balanced(df, 5).collect()) == sorted(got.collect())
    assert [r["rn"] for r in sampling.numbered(df).orderBy("id").collect()] == list(range(60))
    assert sampling.with_replacement(df, 200).count() == 200
    drawn = sampling.balanced_with_replacement(df, 7)
    assert [r[1] for r in drawn.groupBy("label").count().orderBy("label").collect()] == [3, 2, 2]
    with pytest.raises(ValueError):
        sampling.with_replacement(df.limit(0), 1)
    topics = {"a": ["x"], "b": ["y", "z"]}
    seen = {r[0] for r in spark.range(200).select(sampling.topic_of(topics, 1, F.col("id"))).collect()}
    assert seen == {"x", "y", "z"} and spark.range(1).select(sampling.topic_of(None, 1, F.col("id"))).head()[0] is None


def test_reports(spark):
    df = spark.createDataFrame([("en", 1), ("en", None), ("de", 0)], "language string, label int")
    assert {tuple(r) for r in reports.class_distribution(df).collect()} == {(1, 1), (0, 1)}
    assert {tuple(r) for r in reports.language_summary(df, ["en", "fr"]).collect()} == {("en", 2, "ok"), ("fr", 0, "FAIL"), ("TOTAL", 2, "ok")}


def test_thresholds_are_exact(spark):
    texts = ["a " * 9 + "b", "a " * 9 + "c", "a " * 99 + "b", "a " * 99 + "c", "a b c d", "a b c e"]

    def close(t):
        return lambda i, j: cosine(texts[i], texts[j]) >= t

    def cosine(x, y):
        x, y = x.split(), y.split()
        dot = sum(x.count(w) * y.count(w) for w in set(x))
        return dot / (sum(x.count(w) ** 2 for w in set(x)) * sum(y.count(w) ** 2 for w in set(y))) ** 0.5

    for t in (0.7501, 0.9878, 0.9879, 0.995, 0.9999):
        assert kept(similarity.SimilarityDeduplicator(t).apply(frame(spark, texts))) == greedy(len(texts), close(t)), t
    for t in (0.00001, 0, 1.5, 0.12345):
        with pytest.raises(ValueError, match="threshold"):
            similarity.sparse_pairs(frame(spark, texts), None, t)


@pytest.mark.parametrize(("pairs", "most"), [(1 << 19, 1), (1000, 6)])
def test_a_long_chain_is_decided_in_few_rounds(spark, monkeypatch, pairs, most):
    rounds = []
    monkeypatch.setattr(similarity, "EDGES", pairs)
    real = similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name, *a: rounds.append(name) or real(df, name, *a))
    n = 3000
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "i long, j long")
    assert kept(similarity.first_come(spark.range(n).withColumnRenamed("id", "ord"), edges)) == list(range(0, n, 2))
    assert rounds.count("ruled") <= most


def test_copies_meet_nothing_twice(spark):
    texts = ["the same text here"] * 400 + ["text here the SAME"] * 400 + ["another one, really"]
    df = frame(spark, texts)
    assert kept(similarity.SimilarityDeduplicator(0.9).apply(df)) == [0, 800]
    assert kept(similarity.SimilarityDeduplicator(0.9, original=frame(spark, ["same here text the"])).apply(df)) == [800]


def test_filters_of_text_are_pushed_below_a_join(spark):
    left = frame(spark, ["some text of its own"] * 3).drop("label")
    right = spark.createDataFrame([(0, 1), (1, 5)], "ord long, label int")
    out = O.FilterPipeline.default(TASK, use_embeddings=False).run(left.join(right, "ord", "left"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert "length(text" in below and "RLIKE" in below and kept(out) == []


def test_blocks_of_vectors(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(similarity, "LEAST", 16)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 6)), 2)
    x[3] = 0
    df = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)] + [(200, None), (201, [])], "ord long, vector array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sim = unit @ unit.T
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if sim[i, j] >= 0.8}
    assert {(r["i"], r["j"]) for r in similarity.dense_pairs(df, None, 0.8).collect()} == want
    best = {r["ord"]: r["max_similarity"] for r in similarity.most_similar(df.where("ord < 50"), df.where("ord >= 50")).collect()}
    assert set(best) == set(range(50)) and all(abs(best[i] - max(sim[i, 50:])) < 1e-9 for i in best)


def test_texts_of_one_language_need_no_list_of_their_pairs(spark, monkeypatch):
    from fractions import Fraction

    from corpusmill.operators import leaders

    # Every two of the first 900 share a frequent word that makes them similar.
    rng = random.Random(11)
    texts = ["the " * rng.randrange(15, 30) + " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(25))) for _ in range(900)]
    texts += ["x" + " y" * k for k in range(20)] + [None, "", " "] + ["the"] * 30
    for k, v in (("ROWS", 64), ("LEADERS", 100), ("STEP", 16), ("TILE", 4), ("WORDS", 900), ("SAMPLE", 50)):
        monkeypatch.setattr(leaders, k, v)

    def counts(t):
        words = (t or "").split()
        return {w: words.count(w) for w in words}

    bags = [counts(t) for t in texts]
    norms = [sum(v * v for v in b.values()) for b in bags]

    def close(i, j):
        dot = sum(n * bags[j].get(w, 0) for w, n in bags[i].items())
        return dot > 0 and dot * dot * 10_000 >= 8100 * norms[i] * norms[j]

    names = []
    for module in (similarity, leaders):
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, name, *a, real=real: names.append(name) or real(df, name, *a))
    df = frame(spark, texts)
    want = greedy(len(texts), close)
    assert kept(similarity.SimilarityDeduplicator(0.9).apply(df)) == want and len(want) < 200
    assert not {"terms", "edges"} & set(names)
    # Against other rows: what they remove still removes later rows.
    both = similarity.SimilarityDeduplicator(0.9, original=frame(spark, [*texts[5:400:40], None])).apply(df)
    assert kept(both) == [j for j in want if not any(close(i, j) for i in range(5, 400, 40))]
    # By a column, only rows of one value meet; an ord that is there twice is one text.
    by = df.withColumn("g", F.col("ord") % 3)
    assert kept(similarity.SimilarityDeduplicator(0.9, by="g").apply(by)) == sorted(3 * k + g for g in range(3) for k in greedy(len(texts[g::3]), lambda i, j, g=g: close(3 * i + g, 3 * j + g)))
    twice = spark.createDataFrame([(0, "a a a b"), (1, "c d"), (2, "c"), (1, "e"), (2, "d e")], "ord long, text string")
    assert leaders.outdone(twice, Fraction(9, 10)).collect() == [(2,)]
    assert leaders.outdone(df.limit(0), Fraction(9, 10)).collect() == []
