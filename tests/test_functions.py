import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import arithmetic as A
from corpusmill.functions import jsonparse as J
from corpusmill.functions import text as T
from corpusmill.functions.template import compiled


def column(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def cleaned(t):
    t = (t or "").strip()
    for p in T.PREFIXES:
        if t.lower().startswith(p.lower()):
            t = t[len(p) :].strip()
            if t[:1] in (":", "-"):
                t = t[1:].strip()
    if t and t[0] == t[-1] and t[0] in "\"'":
        t = t[1:-1] if len(t) > 1 else ""
    return t.strip()


def test_clean_generated(spark):
    rng = random.Random(1)
    parts = [*T.PREFIXES, "here IS", "TEXT:", " ", "\n", ":", "-", '"', "'", "a", "é", " ", " ", "\x1c", "x y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(7))) for _ in range(1500)]
    texts += ["  hello  ", "Here is a great post", "Text: The actual content", '"Hello world"', None, "Post: Here is x", '"', "''", "Here isn't"]
    assert column(spark, texts, T.clean_generated) == [cleaned(t) for t in texts]


def test_strip_and_blank_are_unicode(spark):
    texts = [" a ", "\x1c b\n", "", "  ", "​", None]
    assert column(spark, texts, T.strip) == ["a", "b", "", "", "​", None]
    assert column(spark, texts, T.not_blank) == [True, True, False, False, True, False]


def test_jaccard(spark):
    df = spark.createDataFrame([("", ""), ("a", ""), ("a b", "B c"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1 / 3, 1.0]


def test_sample_id_depends_on_run(spark):
    ids = [spark.range(3).select(T.sample_id("p", "s", F.col("id"), run)).collect() for run in ("a", "a", "b")]
    assert ids[0] == ids[1] != ids[2] and len({r[0] for r in ids[0]}) == 3 and ids[0][0][0].startswith("p_syn_")


def test_template(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(compiled("{{{a}}} {b}{c}!", {"a": F.col("a"), "b": F.col("b"), "c": 3})).head()[0] == "{x} 3!"
    with pytest.raises(KeyError):
        compiled("{missing}", {})


def test_shares():
    assert A.allocate(100, [0.5, 0.3, 0.2]) == [50, 30, 20]
    assert A.allocate(10, A.normalised(None, 3)) == [4, 3, 3]
    assert A.normalised([2, 3, 5], 3)[0] == pytest.approx(0.2)
    assert A.label_counts(7, [2, 0, 1]) == {0: 3, 1: 2, 2: 2}
    assert A.label_counts(5, [0, 1], {0: 1, 1: 1}) == {0: 2, 1: 3}
    assert A.answer_budget(1, 500) == 4000 and A.answer_budget(10, 800) == 8000
    for bad in (lambda: A.normalised([], 0), lambda: A.normalised([1], 2), lambda: A.normalised([0, 0], 2)):
        with pytest.raises(ValueError):
            bad()


def test_loose_json():
    whole = {"key": "value"}
    fenced = "```json\n" + json.dumps(whole) + "\n```"
    for text in (json.dumps(whole), fenced, "So: " + json.dumps(whole) + " ok", "{broken " + json.dumps(whole)):
        assert J.loose_object(text) == whole
    assert J.loose_object('[{"a": 1}]') == {"a": 1}
    assert J.loose_object('{"a": 1, "a": 2}') == {"a": 2}
    for text in ("not json at all", '["a", "b"]', "", None, "{" * 3000):
        assert J.loose_object(text) == {}


def test_pairs_and_samples():
    raw = json.dumps({"qa_pairs": [{"question": " q ", "answer": "a"}, {"question": "", "answer": "b"}, {"question": "x"}, 3, {"question": 1, "answer": "b"}, {"question": "r", "answer": "s"}]})
    assert J.question_pairs(raw) == [{"question": "q", "answer": "a"}, {"question": "r", "answer": "s"}]
    assert J.question_pairs(raw, 1) == [{"question": "q", "answer": "a"}] and J.question_pairs("no") == []
    assert J.sample_texts('{"samples": [{"text": "a"}, {"other": 1}, "b", 5]}') == ["a", "b"]
    assert J.sample_texts('{"samples": {"text": "a"}, "text": "z"}') == ["a"]
    assert J.sample_texts('{"samples": 3, "outputs": ["a"]}') == ["a"] and J.sample_texts('{"sample": "a"}') == ["a"]


def test_contrastive_cascade():
    names = ("neg", "pos")
    for raw in ('{"neg": "a", "pos": "b"}', "a\n---\nb", "a\n ***** \nb", "1. a\n2) b", "neg: a\npos: b", "pos: b\nneg: a", "a\n\nb\nc"):
        assert J.contrastive_pair(raw, names) == ("a", "b"), raw
    assert J.contrastive_pair("one", names) is None and J.contrastive_pair(None, names) is None


def test_criteria(spark):
    names = ("p", "q")
    raw = ['{"p": true, "q": true}', '{"p": "true", "q": true}', 'x {"p": true} y', "no", '{"p": null}', None]
    assert column(spark, raw, lambda c: J.criteria_of(c, names)) == [2, 1, 1, 0, 0, 0]
