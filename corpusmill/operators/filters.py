"""Quality filters: each maps a DataFrame of samples to the rows that pass."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import TaskSpec
from corpusmill.functions.jsonparse import criteria_of
from corpusmill.functions.text import draw, is_ascii, jaccard, not_blank
from corpusmill.operators.similarity import SimilarityDeduplicator
from corpusmill.shared import written

# Patterns of texts that tell their own label, in lower case.
LEAKAGE_PATTERNS = {
    "generic": [r"label\s*[:=]", r"class\s*[:=]", r"category\s*[:=]", r"classification\s*[:=]", r"sentiment\s*[:=]"],
    "en": [
        r"this\s+(is|was)\s+(a|an)\s+(positive|negative|neutral)\s+(example|sample|text)",
        r"the\s+label\s+(is|for this)",
        r"classified\s+as\s*[:=]?",
        r"belongs?\s+to\s+(class|category)",
    ],
}
# What a judge is asked about a sample.
CRITERIA = ("realistic", "label_correct", "natural_language", "no_artifacts")


class Filter(ABC):
    """Rows that pass; a subclass with a condition of one row gives predicate() alone.

    A filter that needs to know of the run it is part of gives within() too.
    """

    @property
    def name(self) -> str:
        return type(self).__name__

    @abstractmethod
    def predicate(self) -> Column:
        """True for the rows to keep; a null keeps nothing. Conditions that could stand alone are joined by &, cheap ones first."""

    def within(self, **run) -> Filter:
        """The filter to use in a run of which ``run`` says what is known: original, language."""
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate())


class BasicFilter(Filter):
    """Text that is not blank, of a length in code points from min_length to max_length; a label that is known."""

    def __init__(self, valid_labels: Sequence[int] | None = None, min_length: int = 10, max_length: int = 1000) -> None:
        self.valid_labels, self.min_length, self.max_length = valid_labels, min_length, max_length

    def predicate(self) -> Column:
        text = F.col("text")
        keep = F.length(text).between(self.min_length, self.max_length) & not_blank(text)
        return keep if self.valid_labels is None else keep & F.col("label").isin([int(v) for v in self.valid_labels])


class LeakageFilter(Filter):
    """Drops texts that name their label. Null texts pass.

    With ``by``, a column of languages, each text meets the patterns of its own;
    otherwise all meet those of ``language``.
    """

    def __init__(self, task_labels: dict[int, str] | None = None, patterns: dict[str, list[str]] | None = None, language: str = "en", by: str | None = None) -> None:
        self.own, self.by = patterns or LEAKAGE_PATTERNS, by
        self.named = [rf"(?:label|class|category|classified\s+as)\s*[:=]?\s*{re.escape(n.lower())}" for n in (task_labels or {}).values()]
        self.patterns = self._patterns(language)

    def _patterns(self, language: str) -> list[str]:
        return [*self.own.get("generic", []), *(self.own.get(language, []) if language != "generic" else []), *self.named]

    def _found(self, patterns: list[str]) -> Column:
        if not patterns:
            return F.lit(False)
        # One alternation: the text is read once. Both flags, Unicode case and classes, say nothing of ASCII texts.
        text, any_of = F.lower("text"), "|".join(f"(?:{p})" for p in patterns)
        return F.coalesce(F.when(is_ascii(F.col("text")), text.rlike(f"(?i){any_of}")).otherwise(text.rlike(f"(?iU){any_of}")), F.lit(False))

    def predicate(self) -> Column:
        if self.by is None:
            return ~self._found(self.patterns)
        found = self._found(self._patterns("generic"))
        for language in self.own:
            if language != "generic":
                found = F.when(F.col(self.by) == language, self._found(self._patterns(language))).otherwise(found)
        return ~found


class MarkerFilter(Filter):
    """Texts of a label that has keywords must contain min_markers of them."""

    def __init__(self, task: TaskSpec, min_markers: int = 1) -> None:
        self.keywords, self.min_markers = {k: v for k, v in (task.marker_keywords or {}).items() if v}, min_markers

    def predicate(self) -> Column:
        text = F.lower(F.coalesce("text", F.lit("")))
        keep = F.lit(True)
        for label, listed in self.keywords.items():
            found = reduce(lambda a, b: a + b, [text.contains(k.lower()).cast("int") for k in listed])
            keep = F.when(F.col("label") == label, found >= self.min_markers).otherwise(keep)
        return keep


class BlocklistFilter(Filter):
    """Drops texts with any of some substrings: an example of a filter of one's own."""

    def __init__(self, blocked: Sequence[str]) -> None:
        self.blocked = [b.lower() for b in blocked]

    def predicate(self) -> Column:
        text = F.lower(F.coalesce("text", F.lit("")))
        return ~reduce(lambda a, b: a | b, [text.contains(b) for b in self.blocked], F.lit(False))


class JudgeFilter(Filter):
    """Keeps what a judge finds good by min_passing criteria.

    ``judge`` adds a column raw with the judge's answer (null where the call
    failed: those rows pass) to a DataFrame. With a sample_rate under 1 exactly
    max(1, int(n * rate)) rows are judged, chosen by a hash of id and seed, and
    the others pass. An answer that can't be read passes nothing, unless
    on_unparsed is "keep".
    """

    def __init__(self, judge, sample_rate: float = 1.0, min_passing: int = 4, seed: int = 42, on_unparsed: str = "drop") -> None:
        self.judge, self.sample_rate, self.min_passing = judge, min(max(sample_rate, 0.0), 1.0), min_passing
        self.seed, self.on_unparsed = seed, on_unparsed

    def predicate(self) -> Column:
        count = criteria_of(F.col("raw"), CRITERIA)
        keep = F.col("raw").isNull() | (count >= self.min_passing)
        return keep | (~F.col("raw").contains("{")) if self.on_unparsed == "keep" else keep

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows to judge and the others, cut at the k-th draw: found by counts of draws, then in one of 4096 slices."""
        if self.sample_rate >= 1:
            return df, df.limit(0)
        drawn = df.withColumn("_draw", draw(self.seed, F.col("id")))
        slice_ = F.shiftright("_draw", 20)
        counts = sorted(tuple(r) for r in drawn.groupBy(slice_.alias("s")).count().collect())
        left = max(1, int(sum(n for _, n in counts) * self.sample_rate))
        for at, n in counts:
            if left <= n:
                last = drawn.where(slice_ == at).orderBy("_draw", "id").select("_draw", "id").offset(left - 1).limit(1).collect()[0]
                cut = (F.col("_draw") < last["_draw"]) | ((F.col("_draw") == last["_draw"]) & (F.col("id") <= last["id"]))
                return drawn.where(cut).drop("_draw"), drawn.where(~cut).drop("_draw")
            left -= n
        return df, df.limit(0)

    def apply(self, df: DataFrame) -> DataFrame:
        judged, others = self.split(df)
        return self.judge(judged).where(self.predicate()).select(*df.columns).unionByName(others)


class TranslationQualityFilter(Filter):
    """Keeps texts whose translation into English shares threshold of its words with english_original.

    ``translate`` adds back_translated (null where the call failed: those rows
    pass); without it the column must be there. Without english_original all pass.
    """

    def __init__(self, translate=None, threshold: float = 0.70) -> None:
        self.translate, self.threshold = translate, threshold

    def predicate(self) -> Column:
        return F.col("back_translated").isNull() | (jaccard(F.col("back_translated"), F.col("english_original")) >= self.threshold)

    def apply(self, df: DataFrame) -> DataFrame:
        if "english_original" not in df.columns:
            return df
        seen = self.translate(df) if self.translate else df
        return seen.where(self.predicate()).select(*df.columns)


class FilterPipeline:
    """Filters in turn; conditions of one row that follow each other are one stage to Spark."""

    def __init__(self, *filters) -> None:
        self.filters = list(filters)

    def add(self, f) -> FilterPipeline:
        self.filters.append(f)
        return self

    def bound(self, **run) -> list:
        return [f.within(**run) for f in self.filters]

    def run(self, df: DataFrame, **run) -> DataFrame:
        """The rows that pass all filters; ``run`` (original, language) is what they may know of it."""
        return reduce(lambda d, f: f.apply(d), self.bound(**run), df)

    def statistics(self, df: DataFrame, **run) -> DataFrame:
        """stage, name, n_before, n_after and n_removed, in one pass where all conditions are of one row."""
        spark, filters = df.sparkSession, self.bound(**run)
        if all(type(f).apply is Filter.apply for f in filters):
            keep, sums = F.lit(True), [F.count(F.lit(1)).alias("n0")]
            for i, f in enumerate(filters, 1):
                keep = keep & f.predicate()
                sums.append(F.coalesce(F.sum(keep.cast("long")), F.lit(0)).alias(f"n{i}"))
            counts = df.agg(*sums)
            rows = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(f.name).alias("name"), F.col(f"n{i - 1}").alias("n_before"), F.col(f"n{i}").alias("n_after")) for i, f in enumerate(filters, 1)])
            return counts.select(F.inline(rows)).withColumn("n_removed", F.col("n_before") - F.col("n_after"))
        rows, last = [], df.count()
        for i, f in enumerate(filters, 1):
            # Written, so that no stage runs those before it again.
            df = written(f.apply(df), "stage")
            now = df.count()
            rows.append((i, f.name, last, now, last - now))
            last = now
        return spark.createDataFrame(rows, "stage int, name string, n_before long, n_after long, n_removed long")

    @classmethod
    def default(cls, task: TaskSpec, *, language: str = "en", min_length: int = 10, max_length: int = 1000, use_embeddings: bool = True, dedup_threshold: float = 0.90, encoder=None, original: DataFrame | None = None, by: str | None = None) -> FilterPipeline:
        """The usual filters; with ``by``, a column of languages, each language is filtered by itself."""
        out = cls(BasicFilter(task.label_indices, min_length, max_length), LeakageFilter(task.labels, language=language, by=by))
        if use_embeddings:
            out.add(SimilarityDeduplicator(dedup_threshold, encoder=encoder, original=original, by=by))
        return out.add(MarkerFilter(task)) if task.marker_keywords else out
