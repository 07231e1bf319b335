"""Answers that hold whole texts: nothing behind any place of a text is lost."""

import re

import pytest

from corpusmill.plans.catalogue import QUERIES

TAIL = 'x' * 60
HARD = [
    f'{TAIL} "quoted" \\ back\\\\slash \\u0041 end', f"{TAIL}\nline two\n\nline three", f"{TAIL} {{}} {{ }} }} {{ {{\"text\": \"no\"}} [", f"{TAIL}\n```json\n{{\"text\": \"no\"}}\n```\n```", f"{TAIL} ``` {{\"qa_pairs\": []}}", f"{TAIL}\ttab\x01\x1f\x7f   é 日本 😀 ",
    'very "long" {text} \\ ' * 2000, "short", f"  {TAIL} spaced  ", f"{TAIL} </script> ' `` end",
]
TEXTS = [t for t in HARD for _ in range(6)]


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("answers"))
    # Each text meets each shape: six ids in a row, and shapes are by the id modulo 2, 4 and 6.
    ids = range(4 * len(TEXTS))
    spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in ids], "doc_id long, text string").repartition(4).write.parquet(f"{at}/documents.parquet")
    return at, {i: TEXTS[i % len(TEXTS)] for i in ids}


def got(spark, hard, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, hard[0]).collect())


def test_questions_hold_whole_texts(spark, hard):
    want = [(i, 0, t.strip(), "yes") for i, t in hard[1].items() if i % 4 != 3] + [(i, 1, "second", "no") for i in hard[1] if i % 4 == 0]
    assert got(spark, hard, "json_qa_explode") == sorted(want)


def test_samples_hold_whole_texts(spark, hard):
    want = [(i, 0, t) for i, t in hard[1].items() if i % 6 != 5] + [(i, 1, "more") for i in hard[1] if i % 6 in (0, 2)]
    assert got(spark, hard, "json_samples_shapes") == sorted(want)
    assert got(spark, hard, "json_fenced") == sorted(hard[1].items())


def test_pairs_hold_whole_texts(spark, hard):
    def pair(i, t):
        if i % 6 < 4:  # an object, a rule, numbered items, names
            return t.strip(), f"good {t}".strip()
        lines = [x.strip() for x in f"{t}\n\ngood {t}".split("\n") if x.strip()]
        return lines[0], lines[1]

    assert not any(re.search(r"\n\s*(?:---|\*\*\*|[12][.)]|civil|abusive)", t) for t in HARD)
    assert got(spark, hard, "contrastive_parse_cascade") == sorted((i, *pair(i, t)) for i, t in hard[1].items() if i % 6 != 5)


def test_answers_read_in_the_jvm_equal_those_read_in_python(spark):
    """Whatever form an answer has, and whatever stands around it."""
    import json
    import random

    from pyspark.sql import functions as F

    from corpusmill.functions import jsonparse as J

    rng = random.Random(7)

    def value(depth=0):
        kinds = [lambda: rng.choice(["x", " a b ", "", "  ", "é\n", 'q"{}', "1"]), lambda: rng.choice([1, 2.5, True, False, None, 10**30])]
        if depth < 3:
            kinds += [lambda: [value(depth + 1) for _ in range(rng.randrange(3))], lambda: {rng.choice(["text", "question", "answer", "samples", "texts", "output", "sample", "qa_pairs", "civil", "abusive", "ok"]): value(depth + 1) for _ in range(rng.randrange(4))}] * 2
        return rng.choice(kinds)()

    answers = [None, "", "{", "}", "{}", "none", '{"a":1,"a":2}', '{"civil": "x", "civil": "y", "abusive": "z"}', '{"ok": true} {"ok": false}', '{"text": NaN}', "{x} {\"text\": \"y\"}"]
    for _ in range(600):
        text = json.dumps(value(), ensure_ascii=rng.random() < 0.5)
        around = rng.choice(["{}", "{}", "Sure! {}", "```json\n{}\n```", "{} and more }}", "a {{ b {}", "[{}]", "{}{}"])
        answers.append(around.replace("{{", "\1").replace("}}", "\2").replace("{}", text).replace("\1", "{").replace("\2", "}"))
    names = ("civil", "abusive")
    df = spark.createDataFrame(list(enumerate(answers)), "i int, raw string")
    got = df.select("i", J.question_pairs_of(F.col("raw")).alias("q"), J.sample_texts_of(F.col("raw")).alias("s"), J.contrastive_pair_of(F.col("raw"), names).alias("c"), J.criteria_of(F.col("raw"), ("ok", "text")).alias("k")).collect()
    for r in got:
        raw = answers[r["i"]]
        assert [p.asDict() for p in r["q"]] == J.question_pairs(raw), raw
        assert r["s"] == J.sample_texts(raw), raw
        assert (tuple(r["c"]) if r["c"] else None) == J.contrastive_pair(raw, names), raw
        assert r["k"] == sum(J.loose_object(raw).get(n) is True for n in ("ok", "text")), raw


def test_rules_numbers_and_fences():
    from corpusmill.functions import jsonparse as J

    assert J.ruled("a\n---\nb".split("\n")) == ["a", "b"] and J.ruled("---\na\n--\n***".split("\n")) == ["---\na\n--\n***"] and J.ruled(" a \n\n  ***** \n\nb".split("\n")) == ["a", "b"]
    assert J.numbered("x\n1. a\nb\n 2) c\n1.\n".split("\n")) == ["a\nb", "c"]
    assert J.fenced("x ```json\n{}\n``` y") == "\n{}\n" and J.fenced("``` a") is None and J.fenced("```{}```") == "{}"
