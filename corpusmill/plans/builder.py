"""The whole way: shares of strategies, their samples, the filters, a table of all languages."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arithmetic import allocate, normalised
from corpusmill.operators.filters import FilterPipeline
from corpusmill.plans.strategies import META, Run, strategy
from corpusmill.sources.files import load_by_language, save_csv

SCHEMA = "ord long, id string, text string, label int, source string, language string, metadata struct<" + ",".join(f"{k}:{t}" for k, t in META.items()) + ">"

#: Languages planned side by side, and what their ords are apart while they are filtered together.
MOST_LANGUAGES, STRIDE = 8, 1 << 40


class DatasetBuilder:
    """Makes labelled samples for a Run."""

    def __init__(self, run: Run) -> None:
        self.run = run

    def plan(self, n: int, strategies: Sequence[str], weights: Sequence[float] | None = None) -> list[tuple[str, int]]:
        """Strategies with their number of samples; all names are checked, those with none too."""
        for name in strategies:
            strategy(name)
        return list(zip(strategies, allocate(n, normalised(weights, len(strategies))), strict=True))

    def raw(self, language: str, n: int, strategies: Sequence[str] = ("direct",), weights: Sequence[float] | None = None, original: DataFrame | None = None, **options) -> DataFrame:
        """Samples before filters, ord running through the strategies in their order."""
        parts, first = [], 0
        for name, many in self.plan(n, strategies, weights):
            if many > 0:
                part = strategy(name)(self.run, language, many, original=original, **options)
                parts.append(part.withColumn("ord", F.col("ord") + first))
                first += 2 * many + 2
        return reduce(DataFrame.unionByName, parts) if parts else self.run.spark.createDataFrame([], SCHEMA)

    def generate(self, language: str, n: int = 1000, strategies: Sequence[str] = ("direct",), weights: Sequence[float] | None = None, original: DataFrame | None = None, apply_filters: bool = True, filters: FilterPipeline | None = None, save_path: str | None = None, **options) -> DataFrame:
        df = self.raw(language, n, strategies, weights, original, **options)
        if apply_filters:
            # Texts too similar to the original ones go as well.
            df = (filters or FilterPipeline.default(self.run.task, language=language)).run(df, original=original, language=language)
        if save_path:
            save_csv(df.drop("ord"), save_path)
        return df

    def generate_all(self, n: int, strategies: Sequence[str] = ("direct",), weights: Sequence[float] | None = None, data_dir: str | None = None, label_column: str = "label", apply_filters: bool = True, output_dir: str | None = None, **options) -> tuple[DataFrame, dict[str, str]]:
        """All languages in one table, and what went wrong by language: such a language has no rows.

        Languages are planned, and their backends called, side by side; filters
        run once over all, each language by itself.
        """
        codes = self.run.languages.all_language_codes()
        found = load_by_language(self.run.spark, data_dir, codes, label_column) if data_dir else None

        def plan(code: str) -> DataFrame:
            own = found.where(F.col("language") == code) if found is not None else None
            return self.raw(code, n, strategies, weights, own, **options)

        parts, errors = [], {}
        with ThreadPoolExecutor(max(1, min(MOST_LANGUAGES, len(codes)))) as pool:
            for k, (code, made) in enumerate([(code, pool.submit(inheritable_thread_target(self.run.spark)(plan), code)) for code in codes]):
                try:
                    parts.append(made.result().withColumn("ord", F.col("ord") + k * STRIDE))
                except Exception as e:
                    errors[code] = f"{type(e).__name__}: {e}"
        df = reduce(DataFrame.unionByName, parts) if parts else self.run.spark.createDataFrame([], SCHEMA)
        if apply_filters and parts:
            df = FilterPipeline.default(self.run.task, by="language").run(df, original=found)
        df = df.withColumn("ord", F.pmod("ord", F.lit(STRIDE)))
        if output_dir:
            save_csv(df.drop("ord"), output_dir, by="language")
        return df, errors
