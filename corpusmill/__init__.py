"""Spark-native planning, generation and curation of labelled text corpora."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster
# needs no copy of it beside the driver's.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from corpusmill.config import LanguageConfig, TaskSpec  # noqa: E402
from corpusmill.operators.filters import FilterPipeline  # noqa: E402
from corpusmill.plans.builder import DatasetBuilder  # noqa: E402
from corpusmill.plans.prompts import PromptRenderer  # noqa: E402
from corpusmill.plans.strategies import Run, questions, restyled  # noqa: E402

__all__ = ["DatasetBuilder", "FilterPipeline", "LanguageConfig", "PromptRenderer", "Run", "TaskSpec", "questions", "restyled"]
