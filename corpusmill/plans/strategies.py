"""Strategies: each plans rows with prompts or texts, has them answered, and makes samples of the answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.config import LanguageConfig, TaskSpec
from corpusmill.functions.arithmetic import answer_budget, label_counts
from corpusmill.functions.jsonparse import contrastive_pair_of, question_pairs_of, sample_texts_of
from corpusmill.functions.text import clean_generated, content_hash, not_blank, preview, sample_id, strip
from corpusmill.operators.sampling import balanced_with_replacement, topic_of, with_replacement
from corpusmill.plans.prompts import PromptRenderer
from corpusmill.sources.providers import answered, resolved, translated

SAMPLE = ("ord", "id", "text", "label", "source", "language", "metadata")
# Metadata keys.
META = {
    "generated_at": "string", "language": "string", "topic": "string", "label_name": "string", "original_id": "string", "pair_id": "int", "pivot_language": "string",
    "source_language": "string", "cross_lingual": "boolean", "english_original": "string", "chunk_hash": "string", "chunk_preview": "string", "source_topic": "string",
    "target_topic": "string", "style": "string", "source_text_hash": "string", "source_text_preview": "string",
}


def metadata(**values: Column) -> Column:
    """The one struct of all strategies; what a strategy does not know is null."""
    return F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in META.items()])


@dataclass
class Run:
    """What a strategy works with. run_id and run_at stand for the run in ids and metadata."""

    spark: SparkSession
    task: TaskSpec
    provider: object = None
    translator: object = None
    languages: LanguageConfig = field(default_factory=LanguageConfig.single)
    seed: int = 42
    run_id: str = "run"
    run_at: str = "1970-01-01T00:00:00+00:00"
    model: str | None = None
    renderer: PromptRenderer | None = None

    @property
    def prompts(self) -> PromptRenderer:
        return self.renderer or PromptRenderer(self.task)

    def ask(self, df: DataFrame, **options) -> DataFrame:
        if self.provider is None:
            raise ValueError("this strategy needs a provider")
        options = {k: v for k, v in (options | {"model": self.model}).items() if v is not None}
        return answered(df, resolved(self.provider), **options)

    def translate(self, df: DataFrame, *columns: str) -> DataFrame:
        if self.translator is None:
            raise ValueError("this strategy needs a translator")
        return translated(df, resolved(self.translator), *columns)


def labelled_plan(run: Run, n: int, ratios: dict[int, float] | None = None) -> DataFrame:
    """ord and label of ``n`` samples, labels in blocks, in order."""
    label, first = F.lit(None).cast("int"), 0
    for value, many in label_counts(n, run.task.label_indices, ratios).items():
        label = F.when((F.col("ord") >= first) & (F.col("ord") < first + many), F.lit(value)).otherwise(label)
        first += many
    return run.spark.range(n).withColumnRenamed("id", "ord").withColumn("label", label.cast("int"))


def _name(run: Run, label: Column) -> Column:
    out = F.lit(None).cast("string")
    for i in run.task.label_indices:
        out = F.when(label == i, F.lit(run.task.label_name(i))).otherwise(out)
    return out


def samples(run: Run, df: DataFrame, prefix: str, source: str, language: str, **meta: Column) -> DataFrame:
    """The columns SAMPLE of ``df`` (ord, text, label); ids by prefix, source and ord."""
    meta = {"generated_at": F.lit(run.run_at), "language": F.lit(language)} | meta
    return df.select("ord", sample_id(prefix, source, F.col("ord"), run.run_id).alias("id"), "text", F.col("label").cast("int").alias("label"), F.lit(source).alias("source"), F.lit(language).alias("language"), metadata(**meta).alias("metadata"))


def direct(run: Run, language: str, n: int, *, ratios: dict[int, float] | None = None, **_) -> DataFrame:
    """A new text for each planned label and topic."""
    plan = labelled_plan(run, n, ratios).withColumn("topic", topic_of(run.task.topics, run.seed, F.col("ord")))
    plan = plan.withColumn("prompt", run.prompts.render("direct", run.languages.language_name(language), F.col("label"), topic=F.col("topic")))
    got = run.ask(plan, temperature=0.9).withColumn("text", clean_generated(F.col("raw"))).where("text <> ''")
    return samples(run, got, "direct", "direct", language, topic=F.col("topic"), label_name=_name(run, F.col("label")))


def _originals(original: DataFrame | None) -> DataFrame:
    if original is None:
        raise ValueError("this strategy needs original_df, with columns text and label")
    if "id" not in original.columns:
        original = original.withColumn("id", F.monotonically_increasing_id().cast("string"))
    return original.select(F.col("id").cast("string").alias("id"), "text", F.col("label").cast("int").alias("label"))


def paraphrase(run: Run, language: str, n: int, *, original: DataFrame | None = None, **_) -> DataFrame:
    """Rows of the original data, drawn with replacement, in other words."""
    drawn = with_replacement(_originals(original), n, run.seed).withColumnsRenamed({"draw_no": "ord", "text": "src"})
    plan = drawn.withColumn("prompt", run.prompts.render("paraphrase", run.languages.language_name(language), F.col("label"), text=F.col("src")))
    got = run.ask(plan, temperature=0.7).withColumn("text", clean_generated(F.col("raw"))).where("text <> ''")
    return samples(run, got.withColumnRenamed("id", "original_id"), "para", "paraphrase", language, original_id=F.coalesce("original_id", F.concat(F.lit("unknown_"), F.col("ord").cast("string"))), label_name=_name(run, F.col("label")))


def contrastive(run: Run, language: str, n: int, **_) -> DataFrame:
    """Pairs of texts that differ in label; the first ``n`` texts of the pairs that could be read."""
    if not run.task.is_binary:
        raise ValueError("the contrastive strategy needs a binary task")
    first, second = run.task.label_indices
    names = (run.task.label_name(first), run.task.label_name(second))
    plan = run.spark.range((n + 1) // 2).select(F.col("id").cast("int").alias("pair_id"), F.lit(first).alias("label"))
    plan = plan.withColumn("topic", topic_of(run.task.topics, run.seed, F.col("pair_id")))
    plan = plan.withColumn("prompt", run.prompts.render("contrastive", run.languages.language_name(language), F.col("label"), topic=F.col("topic")))
    got = run.ask(plan, temperature=0.8, response_format={"type": "json_object"})
    pairs = got.withColumn("pair", contrastive_pair_of(F.col("raw"), names)).where("pair IS NOT NULL").drop("label")
    both = pairs.select("pair_id", "topic", F.posexplode("pair").alias("side", "raw_text"))
    both = both.withColumn("label", F.when(F.col("side") == 0, first).otherwise(second)).withColumn("text", clean_generated(F.col("raw_text"))).where("text <> ''")
    both = both.withColumn("ord", (2 * F.col("pair_id") + F.col("side")).cast("long"))
    # At most n + 1 rows can be there: then no row is missing, and the last is one too many.
    cap = both.where(F.col("ord") < n) if n % 2 and both.count() > n else both
    return samples(run, cap, "contrast", "contrastive", language, pair_id=F.col("pair_id"), topic=F.col("topic"), label_name=_name(run, F.col("label")))


def backtranslation(run: Run, language: str, n: int, *, original: DataFrame | None = None, pivots: tuple[str, ...] = ("en",), class_balanced: bool = True, **_) -> DataFrame:
    """Rows of the original data to another language and back, where that changes them."""
    if run.translator is None:
        raise ValueError("the backtranslation strategy needs a translator")
    rows = _originals(original)
    drawn = (balanced_with_replacement(rows, n, seed=run.seed) if class_balanced else with_replacement(rows, n, run.seed)).withColumnsRenamed({"draw_no": "ord", "text": "src", "id": "original_id"})
    ways = [p for p in pivots if p != language] or ["en"]
    plan = drawn.withColumn("pivot", F.element_at(F.array(*[F.lit(run.languages.iso_code(p)) for p in ways]), (F.pmod("ord", F.lit(len(ways))) + 1).cast("int"))).withColumn("own", F.lit(run.languages.iso_code(language)))
    there = run.translate(plan, "src", "own", "pivot", "there").where("there IS NOT NULL")
    back = run.translate(there, "there", "pivot", "own", "back").withColumn("text", strip(F.col("back"))).where("text <> '' AND text <> src")
    return samples(run, back, "bt", "backtranslation", language, pivot_language=F.col("pivot"), original_id=F.coalesce("original_id", F.concat(F.lit("unknown_"), F.col("ord").cast("string"))))


def pivot(run: Run, language: str, n: int, *, source_language: str = "en", ratios: dict[int, float] | None = None, cross_lingual: bool = False, cross_lingual_ratio: float = 0.3, **_) -> DataFrame:
    """Texts written in another language, then translated; the first ones from a related language, if asked."""
    if run.translator is None:
        raise ValueError("the pivot strategy needs a translator")
    related = run.languages.related_language(language) if cross_lingual else None
    many = round(n * cross_lingual_ratio) if related and related != language else 0
    plan = labelled_plan(run, n, ratios).withColumn("topic", topic_of(run.task.topics, run.seed, F.col("ord"))).withColumn("cross", F.col("ord") < many)
    name = F.when(F.col("cross"), F.lit(run.languages.language_name(related or source_language))).otherwise(F.lit(run.languages.language_name(source_language)))
    plan = plan.withColumn("prompt", run.prompts.render("direct", name, F.col("label"), topic=F.col("topic")))
    got = run.ask(plan, temperature=0.9).withColumn("src", clean_generated(F.col("raw"))).where("src <> ''")
    got = got.withColumn("from", F.when(F.col("cross"), F.lit(run.languages.iso_code(related or source_language))).otherwise(F.lit(run.languages.iso_code(source_language)))).withColumn("to", F.lit(run.languages.iso_code(language)))
    out = run.translate(got, "src", "from", "to", "there").withColumn("text", clean_generated(F.col("there"))).where("text <> ''")
    return samples(run, out, "pivot", "pivot", language, source_language=F.col("from"), topic=F.col("topic"), cross_lingual=F.col("cross"), label_name=_name(run, F.col("label")), english_original=F.when(F.col("from") == "en", F.col("src")))


#: By name: functions of a Run, a language, a number of samples and options (original and others), which give the
#: columns SAMPLE. ord says in which order samples come; it is below 2 * n + 2.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {"direct": direct, "paraphrase": paraphrase, "contrastive": contrastive, "backtranslation": backtranslation, "pivot": pivot}


def register(name: str, make: Callable[..., DataFrame]) -> None:
    """A strategy of one's own, for builders and the command line."""
    if name in STRATEGIES and STRATEGIES[name] is not make:
        raise ValueError(f"there is a strategy {name!r}")
    STRATEGIES[name] = make


def strategy(name: str) -> Callable[..., DataFrame]:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[name]


def _positive(n: int) -> None:
    if n <= 0:
        raise ValueError("the number of samples must be greater than zero")


def questions(run: Run, chunks: DataFrame, n: int, language: str = "English", *, max_tokens: int | None = None, temperature: float = 0.2) -> DataFrame:
    """id, question, answer, source and metadata: up to ``n`` valid pairs of each chunk (chunk_id, text). Blank chunks have none."""
    _positive(n)
    plan = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), strip(F.col("text")).alias("chunk")).where(not_blank(F.col("chunk")))
    plan = plan.withColumn("prompt", run.prompts.render("rag_qa", language, chunk=F.col("chunk"), num_samples=n))
    got = run.ask(plan, temperature=temperature, max_tokens=max_tokens or answer_budget(n, 500), response_format={"type": "json_object"})
    pairs = got.select("chunk_id", "chunk", F.posexplode(F.slice(question_pairs_of(F.col("raw")), 1, n)).alias("k", "pair"))
    return pairs.select(
        sample_id("ragqa", "rag_qa", F.concat_ws("/", "chunk_id", "k"), run.run_id).alias("id"),
        "pair.question", "pair.answer", F.lit("rag_qa").alias("source"),
        metadata(generated_at=F.lit(run.run_at), language=F.lit(language), chunk_hash=content_hash(F.col("chunk")), chunk_preview=preview(F.col("chunk"))).alias("metadata"),
    )


def restyled(run: Run, texts: DataFrame, source_topic: str, target_topic: str, style: str, n: int = 1, language: str = "English", *, max_tokens: int | None = None, temperature: float = 0.7) -> DataFrame:
    """id, text, source and metadata: up to ``n`` new texts in the style of each source text (chunk_id, text)."""
    _positive(n)
    for what, value in (("source topic", source_topic), ("target topic", target_topic), ("style", style)):
        if not value.strip():
            raise ValueError(f"a non-empty {what} is needed")
    plan = texts.select(F.col("chunk_id").cast("string").alias("chunk_id"), strip(F.col("text")).alias("src")).where(not_blank(F.col("src")))
    plan = plan.withColumn("prompt", run.prompts.render("templated_generation", language, text=F.col("src"), source_topic=source_topic, target_topic=target_topic, style=style, num_samples=n))
    got = run.ask(plan, temperature=temperature, max_tokens=max_tokens or answer_budget(n, 800), response_format={"type": "json_object"})
    clean = F.filter(F.transform(sample_texts_of(F.col("raw")), clean_generated), lambda t: t != "")
    made = got.select("chunk_id", "src", F.posexplode(F.slice(clean, 1, n)).alias("k", "text"))
    return made.select(
        sample_id("templated", "templated_generation", F.concat_ws("/", "chunk_id", "k"), run.run_id).alias("id"),
        "text", F.lit("templated_generation").alias("source"),
        metadata(generated_at=F.lit(run.run_at), language=F.lit(language), source_topic=F.lit(source_topic), target_topic=F.lit(target_topic), style=F.lit(style), source_text_hash=content_hash(F.col("src")), source_text_preview=preview(F.col("src"))).alias("metadata"),
    )


def restyled_one(run: Run, text: str, source_topic: str, target_topic: str, style: str, **options) -> str:
    """One new text, or an empty one."""
    if not text.strip():
        raise ValueError("a non-empty text is needed")
    own = run.spark.createDataFrame([("0", text)], "chunk_id string, text string")
    got = restyled(run, own, source_topic, target_topic, style, 1, **options).select("text").head()
    return got[0] if got else ""


def questions_about(run: Run, text: str, n: int, language: str = "English", **options) -> DataFrame:
    """questions of one text."""
    if not text.strip():
        raise ValueError("a non-empty text is needed")
    return questions(run, run.spark.createDataFrame([("0", text)], "chunk_id string, text string"), n, language, **options)


def judge_of(run: Run, language: str = "en") -> Callable[[DataFrame], DataFrame]:
    """What JudgeFilter takes: adds raw, the backend's answer about text and label."""

    def judge(df: DataFrame) -> DataFrame:
        prompt = run.prompts.render("judge", run.languages.language_name(language), F.col("label"), text=F.col("text"))
        return run.ask(df.withColumn("prompt", prompt), temperature=0.3, response_format={"type": "json_object"})

    return judge


def translate_back_of(run: Run, language: str) -> Callable[[DataFrame], DataFrame]:
    """What TranslationQualityFilter takes: adds back_translated, text in English."""

    def translate(df: DataFrame) -> DataFrame:
        own = df.withColumn("_from", F.lit(run.languages.iso_code(language))).withColumn("_to", F.lit("en"))
        return run.translate(own, "text", "_from", "_to", "back_translated").drop("_from", "_to")

    return translate
