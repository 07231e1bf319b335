import json

import pytest
from pyspark.sql import functions as F

from corpusmill.cli import main
from corpusmill.config import LanguageConfig, TaskSpec, load_config
from corpusmill.plans.builder import DatasetBuilder
from corpusmill.plans.prompts import PromptRenderer
from corpusmill.plans.strategies import Run, questions, restyled, restyled_one
from corpusmill.sources import files, providers
from corpusmill.sources.providers import ColumnProvider
from corpusmill.streaming.filters import counted_stream, filtered_stream, run_stream

TASK = TaskSpec("sentiment", {0: "negative", 1: "positive"}, "Is it good?", topics={"general": ["product quality", "customer service"]})
ECHO = ColumnProvider(lambda p: F.concat(F.lit("Here is: a text "), F.md5(p.cast("binary"))))
TAG = ColumnProvider(lambda t, a, b: F.concat(t, F.lit(" "), b))


def original(spark):
    return spark.createDataFrame([(str(i), f"text number {i}", i % 2) for i in range(10)], "id string, text string, label int")


def test_task_and_languages(tmp_path):
    with pytest.raises(ValueError, match="at least 2 labels"):
        TaskSpec("t", {0: "a"}, "d")
    assert TASK.label_description(1) == "positive" and TASK.other_label(0) == 1
    task = TaskSpec("t", {0: "a", 1: "b"}, "d", custom_prompts={"direct": "x"})
    assert TaskSpec.from_dict(json.loads(json.dumps(task.to_dict()))) == task
    langs = LanguageConfig({"ne": "Nepali", "hi": "Hindi"}, related_languages={"ne": "hi"}, tiers={1: ["hi"]})
    assert langs.related_language("ne") == "hi" and langs.related_language("hi") is None and langs.tier_languages(2) == [] and langs.iso_code("hi") == "hi"
    path = tmp_path / "task.json"
    path.write_text(json.dumps(task.to_dict() | {"languages": {"en": "English"}}))
    assert load_config(str(path)) == (task, LanguageConfig({"en": "English"}))
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "task.toml")) if (tmp_path / "task.toml").write_text("x") else None


def test_prompts(spark):
    task = TaskSpec("t", {0: "a", 1: "b"}, "d", custom_prompts={"direct": "Custom: generate {label_name} in {language}"})
    df = spark.createDataFrame([(1,)], "label int")
    assert df.select(PromptRenderer(task).render("direct", "German", F.col("label"))).head()[0] == "Custom: generate b in German"
    got = df.select(PromptRenderer(TASK).render("contrastive", "English", F.col("label"), topic=F.lit(None).cast("string"))).head()[0]
    assert '"positive"' in got and '"negative"' in got and "any relevant topic" in got and "20 to 80" in got
    with pytest.raises(ValueError):
        PromptRenderer(TASK).render("unknown", "English")


def test_direct_is_balanced(spark):
    df = DatasetBuilder(Run(spark, TASK, ECHO)).raw("en", 20)
    assert {r[0]: r[1] for r in df.groupBy("label").count().collect()} == {0: 10, 1: 10}
    assert df.columns == ["ord", "id", "text", "label", "source", "language", "metadata"] and df.where("text NOT LIKE 'a text %'").count() == 0


def test_strategies_need_what_they_need(spark):
    run = Run(spark, TASK, ECHO)
    for name, what in (("paraphrase", "original_df"), ("pivot", "translator"), ("backtranslation", "translator"), ("unknown", "unknown strategy")):
        with pytest.raises(ValueError, match=what):
            DatasetBuilder(run).raw("en", 4, [name])
    with pytest.raises(ValueError, match="binary"):
        DatasetBuilder(Run(spark, TaskSpec("t", {0: "a", 1: "b", 2: "c"}, "d"), ECHO)).raw("en", 4, ["contrastive"])
    with pytest.raises(ValueError, match="unknown"):
        DatasetBuilder(run).plan(1, ["direct", "nothing"], [1, 0])


def test_contrastive_cap_and_labels(spark):
    answer = ColumnProvider(lambda p: F.lit("positive: Great thing\nnegative: Bad thing"))
    got = DatasetBuilder(Run(spark, TASK, answer)).raw("en", 5, ["contrastive"]).orderBy("ord").collect()
    assert [(r["label"], r["text"]) for r in got] == [(0, "Bad thing"), (1, "Great thing")] * 2 + [(0, "Bad thing")]


def test_backtranslation_and_pivot(spark):
    run = Run(spark, TASK, ECHO, TAG, LanguageConfig({"en": "English", "de": "German"}, related_languages={"de": "fr"}))
    got = DatasetBuilder(run).raw("de", 7, ["backtranslation"], original=original(spark), pivots=("en", "de", "fr")).orderBy("ord").collect()
    assert [r["metadata"]["pivot_language"] for r in got] == ["en", "fr"] * 3 + ["en"] and all(r["text"].endswith(" de") for r in got)
    same = Run(spark, TASK, ECHO, ColumnProvider(lambda t, a, b: t))
    assert DatasetBuilder(same).raw("de", 7, ["backtranslation"], original=original(spark)).count() == 0
    got = DatasetBuilder(run).raw("de", 10, ["pivot"], cross_lingual=True).orderBy("ord").collect()
    assert [r["metadata"]["cross_lingual"] for r in got] == [True] * 3 + [False] * 7 and got[9]["metadata"]["english_original"]


def test_python_provider_retries_and_keeps_errors(spark):
    class Flaky:
        def __init__(self):
            self.calls = 0

        def generate(self, prompt, **_):
            self.calls += 1
            if "negative" in prompt.split("class is")[1].split("\n")[0] or self.calls % 2:
                raise RuntimeError("no")
            return "A text"

    run = Run(spark, TASK, Flaky)
    from corpusmill.plans.strategies import labelled_plan

    plan = labelled_plan(run, 8).withColumn("prompt", run.prompts.render("direct", "English", F.col("label"), topic="x"))
    got = providers.answered(plan, Flaky, base_delay=0).collect()
    assert len(got) == 8 and all((r["raw"] is None) == (r["label"] == 0) == (r["error"] is not None) for r in got)
    waits = []
    with pytest.raises(RuntimeError):
        providers.with_retry(lambda: (_ for _ in ()).throw(RuntimeError()), 3, 1.0, waits.append)
    assert len(waits) == 2 and 1 <= waits[0] < 2 <= waits[1] < 3
    with pytest.raises(ValueError):
        providers.resolved("nobody")


def test_parameters_are_renamed_once():
    class Completions:
        def __init__(self):
            self.seen = []

        def create(self, **asked):
            self.seen.append(asked)
            if "max_tokens" in asked:
                raise RuntimeError("Unsupported parameter: max_tokens")
            if "temperature" in asked:
                raise RuntimeError("Unsupported value: temperature, only the default")
            message = type("M", (), {"content": " hi "})
            return type("R", (), {"choices": [type("C", (), {"message": message})]})

    own = Completions()
    client = type("Client", (), {"chat": type("Chat", (), {"completions": own})})
    assert providers.OpenAIProvider(client=client).generate("p", system_prompt="s") == "hi"
    assert own.seen[-1].keys() == {"model", "messages", "max_completion_tokens"} and len(own.seen[-1]["messages"]) == 2


def test_questions_and_restyling(spark):
    answer = ColumnProvider(lambda p: F.lit('Ok {"qa_pairs": [{"question": "q", "answer": "a"}, {"question": " ", "answer": "b"}, {"question": "r", "answer": "b"}]}'))
    chunks = spark.createDataFrame([("1", " chunk "), ("2", "  "), ("3", None)], "chunk_id string, text string")
    got = questions(Run(spark, TASK, answer), chunks, 2).collect()
    assert [(r["question"], r["metadata"]["chunk_preview"]) for r in got] == [("q", "chunk"), ("r", "chunk")] and len({r["id"] for r in got}) == 2
    assert questions(Run(spark, TASK, ColumnProvider(lambda p: F.lit("not json"))), chunks, 2).columns == ["id", "question", "answer", "source", "metadata"]
    with pytest.raises(ValueError, match="greater than zero"):
        questions(Run(spark, TASK, answer), chunks, 0)
    run = Run(spark, TASK, ColumnProvider(lambda p: F.lit('{"samples": [{"text": "Text: one"}, {"text": ""}, {"wrong": 1}, "two"]}')))
    assert [r[0] for r in restyled(run, chunks, "a", "b", "c", 5).select("text").collect()] == ["one", "two"]
    assert restyled_one(run, "x", "a", "b", "c") == "one"
    with pytest.raises(ValueError, match="non-empty"):
        restyled_one(run, " ", "a", "b", "c")


def test_files(spark, tmp_path):
    path = tmp_path / "in" / "de.csv"
    path.parent.mkdir()
    path.write_text('text,y\n"a ""quoted""\nline",1.9\nNA,1\n  ok  ,0\nx,None\n')
    df = files.load_samples(spark, str(path), "y").orderBy("text")
    assert [(r["text"], r["label"]) for r in df.collect()] == [("  ok  ", 0), ('a "quoted"\nline', 1)] and "id" in df.columns
    with pytest.raises(ValueError):
        files.load_samples(spark, str(path))
    both = files.load_by_language(spark, str(path.parent), ["en", "de"], "y")
    assert {r["language"] for r in both.collect()} == {"de"} and files.load_by_language(spark, str(path.parent), ["en"]) is None
    assert files.filtered_path("/a.b/c.csv") == "/a.b/c_filtered.csv" and files.stamped_path("o/", "en", "1") == "o/en_synthetic_1.csv"


def test_builder_and_command_line(spark, tmp_path, capsys):
    config = tmp_path / "task.json"
    config.write_text(json.dumps(TASK.to_dict() | {"languages": {"en": "English", "de": "German"}}))
    assert main(["generate", "-c", str(config), "-l", "en", "-n", "6", "-o", str(tmp_path / "out"), "--no-filter"], spark, ECHO) == 0
    assert files.read_csv(spark, str(tmp_path / "out/en_synthetic.csv")).count() == 6
    assert main(["filter", "-c", str(config), "-i", str(tmp_path / "out/en_synthetic.csv"), "-o", str(tmp_path / "kept"), "--no-embeddings"], spark) == 0
    assert files.read_csv(spark, str(tmp_path / "kept")).count() == 6
    assert main(["generate", "-c", str(config), "--all", "-n", "4", "-o", str(tmp_path / "all"), "--no-filter"], spark, ECHO) == 0
    (tmp_path / "chunk.txt").write_text("some text")
    answer = ColumnProvider(lambda p: F.lit('{"qa_pairs": [{"question": "q", "answer": "a"}]}'))
    assert main(["rag-qa", "-i", str(tmp_path / "chunk.txt")], spark, answer) == 0
    assert '"question": "q"' in capsys.readouterr().out
    df, errors = DatasetBuilder(Run(spark, TASK, ECHO, languages=LanguageConfig({"en": "English", "de": "German"}))).generate_all(4, ["pivot"])
    assert df.count() == 0 and set(errors) == {"en", "de"} and df.columns[0] == "ord"


def test_stream(spark, tmp_path):
    from corpusmill.operators.filters import BasicFilter, FilterPipeline, LeakageFilter
    from corpusmill.operators.similarity import SimilarityDeduplicator

    rows = spark.createDataFrame([("a good text", 1), ("label: x and more", 1), (None, 0)], "text string, label int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = run_stream(filtered_stream(stream, FilterPipeline(BasicFilter(), LeakageFilter())), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a good text"]
    with pytest.raises(ValueError):
        filtered_stream(stream, FilterPipeline(SimilarityDeduplicator()))
    timed = stream.withColumn("at", F.current_timestamp())
    assert counted_stream(timed, "at").isStreaming


def test_filters_with_backends(spark):
    from corpusmill import FilterPipeline
    from corpusmill.operators.filters import JudgeFilter, TranslationQualityFilter
    from corpusmill.operators.similarity import sentence_encoder
    from corpusmill.plans.strategies import judge_of, questions_about, translate_back_of

    good = '{"realistic": true, "label_correct": true, "natural_language": true, "no_artifacts": '
    judge = ColumnProvider(lambda p: F.when(p.contains("bad text"), F.lit(good + "false}")).otherwise(F.lit(good + "true}")))
    run = Run(spark, TASK, judge, ColumnProvider(lambda t, a, b: F.concat(t, F.lit(" "), a)))
    df = spark.createDataFrame([(0, "0", "a good text", 1, "a good text de"), (1, "1", "a bad text", 0, "other words")], "ord long, id string, text string, label int, english_original string")
    kept = FilterPipeline(JudgeFilter(judge_of(run))).run(df)
    assert [r["ord"] for r in kept.collect()] == [0] and kept.columns == df.columns
    assert [r["ord"] for r in TranslationQualityFilter(translate_back_of(run, "de")).apply(df).collect()] == [0]
    with pytest.raises(ValueError, match="non-empty"):
        questions_about(run, " ", 1)
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="sentence-transformers"):
            sentence_encoder()


def test_all_rows_as_json(spark):
    df = spark.range(2500).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    assert sorted(r["id"] for r in json.loads(files.as_json(df))) == list(range(2500)) and json.loads(files.as_json(df.limit(0))) == []


def test_ids_from_zero(spark, tmp_path):
    files.save_csv(spark.range(1000).repartition(7).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 5 > 0, 1).alias("label")), str(tmp_path / "in"))
    got = files.load_samples(spark, str(tmp_path / "in"))
    ids = [int(r["id"]) for r in got.collect()]
    assert len(set(ids)) == 800 and max(ids) < 1000 and got.where("label <> 1").isEmpty()


def test_errors_are_whole(spark):
    class Broken:
        def generate(self, prompt, **_):
            raise RuntimeError("x" * 2000)

    got = providers.answered(spark.range(1).select(F.lit("p").alias("prompt")), Broken, base_delay=0).head()
    assert got["raw"] is None and got["error"] == "RuntimeError: " + "x" * 2000


def test_a_client_without_json_mode():
    class Plain:
        def generate(self, prompt, *, temperature=0.9):
            return prompt

    class Typed(Plain):
        def generate(self, prompt, **_):
            raise TypeError("something else")

    assert providers.asked(Plain(), "p", {"temperature": 0.1, "response_format": {"type": "json_object"}}) == "p"
    with pytest.raises(TypeError, match="something else"):
        providers.asked(Typed(), "p", {"response_format": {}})


def test_own_renderer_and_strategy(spark):
    from corpusmill.plans import strategies as S
    from corpusmill.plans.prompts import PromptRenderer

    class Short(PromptRenderer):
        def render(self, strategy, language, label=None, **values):
            return F.concat(F.lit(f"{strategy}:"), label.cast("string"))

    echo = ColumnProvider(lambda p: p)
    run = Run(spark, TASK, echo, renderer=Short(TASK))
    assert sorted(r["text"] for r in DatasetBuilder(run).raw("en", 3).collect()) == ["direct:0", "direct:0", "direct:1"]

    def constant(run, language, n, **_):
        plan = S.labelled_plan(run, n).withColumn("text", F.concat(F.lit("text "), F.col("ord").cast("string")))
        return S.samples(run, plan, "const", "constant", language)

    S.register("constant", constant)
    try:
        assert DatasetBuilder(run).raw("en", 4, ["constant", "direct"]).where("source = 'constant'").count() == 2
        with pytest.raises(ValueError, match="there is a strategy"):
            S.register("direct", constant)
    finally:
        del S.STRATEGIES["constant"]


def test_a_run_tells_its_filters(spark):
    from corpusmill.operators.filters import Filter, FilterPipeline

    class Own(Filter):
        def __init__(self, language=None):
            self.language = language

        def within(self, language=None, **_):
            return Own(language)

        def predicate(self):
            return F.col("text") != F.lit(self.language)

    df = spark.createDataFrame([("en",), ("de",)], "text string")
    assert [r[0] for r in FilterPipeline(Own()).run(df, original=None, language="de").collect()] == ["en"]


def test_languages_are_filtered_by_themselves(spark, tmp_path):
    same = ColumnProvider(lambda p: F.lit("a text that all languages share"))
    run = Run(spark, TASK, same, languages=LanguageConfig({"en": "English", "de": "German", "fr": "French"}))
    (tmp_path / "fr.csv").write_text("text,label\na text that all languages share,0\n")
    df, errors = DatasetBuilder(run).generate_all(6, ["direct"], data_dir=str(tmp_path))
    assert not errors and sorted((r["language"], r["ord"]) for r in df.collect()) == [("de", 0), ("en", 0)]
    assert DatasetBuilder(run).generate("fr", 6, original=files.load_samples(spark, str(tmp_path / "fr.csv"))).count() == 0


def test_no_command(capsys):
    assert main([]) == 1 and "generate" in capsys.readouterr().out


def test_counts_of_a_stream_go_on_after_a_restart(spark, tmp_path):
    from corpusmill.streaming.filters import counts_to, latest_counts

    schema = "at timestamp, label int"

    def run(rows, k):
        spark.createDataFrame(rows, "at string, label int").selectExpr("CAST(at AS timestamp) AS at", "label").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        counts_to(counted_stream(stream, "at", "1 hour", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        return {(r["window"]["start"].hour, r["label"]): r["n"] for r in latest_counts(spark, str(tmp_path / "out")).collect()}

    assert run([("2024-01-01 10:00:00", 1), ("2024-01-01 10:30:00", 1), ("2024-01-01 10:59:00", 0)], 0) == {(10, 1): 2, (10, 0): 1}
    assert run([("2024-01-01 10:58:00", 1), ("2024-01-01 12:30:00", 0)], 1) == {(10, 1): 3, (10, 0): 1, (12, 0): 1}
    # Two hours late: its window is closed, and it is dropped.
    assert run([("2024-01-01 10:10:00", 1), ("2024-01-01 12:40:00", 0)], 2) == {(10, 1): 3, (10, 0): 1, (12, 0): 2}


def test_an_encoder_of_texts(spark, tmp_path, monkeypatch):
    """With a stand-in for the model, which each task loads."""
    from corpusmill.operators.similarity import SimilarityDeduplicator, sentence_encoder

    module = tmp_path / "sentence_transformers.py"
    module.write_text("import numpy as np\n\n\nclass SentenceTransformer:\n    def __init__(self, name):\n        pass\n\n    def encode(self, texts):\n        return np.array([[t.count('a'), t.count('b')] for t in texts], np.float32)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(module))
    df = spark.createDataFrame([(0, "aa"), (1, "aaab"), (2, "b"), (3, None), (4, "a")], "ord long, text string")
    kept = SimilarityDeduplicator(0.9, encoder=sentence_encoder()).apply(df)
    assert sorted(r["ord"] for r in kept.collect()) == [0, 2, 3]
