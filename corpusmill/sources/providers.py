"""Backends that write or translate text, and the stage that calls them.

A backend is either a ColumnProvider, which is an expression, or an object with
generate() or translate(), of which each task makes one and calls it row by row.
Answers are written to the shared folder before anything is made of them: a
call costs money and is not repeated because a later stage lost an executor.
"""

from __future__ import annotations

import random
import time
from abc import ABC, abstractmethod
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.shared import written


class LLMProvider(ABC):
    @abstractmethod
    def generate(self, prompt: str, *, model: str | None = None, temperature: float = 0.9, max_tokens: int = 250, system_prompt: str | None = None, response_format: dict | None = None) -> str: ...


class TranslationProvider(ABC):
    @abstractmethod
    def translate(self, text: str, source_lang: str, target_lang: str) -> str: ...

    def backtranslate(self, text: str, source_lang: str, pivot_lang: str = "en") -> str:
        return self.translate(self.translate(text, source_lang, pivot_lang), pivot_lang, source_lang)


class ColumnProvider:
    """A backend that is an expression of the prompt (or of text, source and target)."""

    def __init__(self, answer: Callable[..., Column]) -> None:
        self.answer = answer


def with_retry(call: Callable[[], str], attempts: int = 3, base_delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """What ``call`` returns; waits base_delay * 2**n and up to a second more between attempts, not after the last."""
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n + 1 == attempts:
                raise
            sleep(base_delay * 2**n + random.random())
    raise ValueError("at least one attempt is needed")


def _called(df: DataFrame, make: Callable[[], object], call: Callable[[object, dict], str | None], inputs: list[str], attempts: int, base_delay: float) -> DataFrame:
    """``df`` with raw and error: one client for each task, rows in turn."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("raw", StringType()), StructField("error", StringType())])
    arrow = to_arrow_schema(schema)
    at = [df.columns.index(c) for c in inputs]

    def work(batches):
        client = None
        for batch in batches:
            client = client or make()
            raw, errors = [], []
            for row in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                values = dict(zip(inputs, row, strict=True))
                try:
                    raw.append(with_retry(lambda v=values: call(client, v), attempts, base_delay))
                    errors.append(None)
                except Exception as e:
                    raw.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)], pa.array(raw, pa.string()), pa.array(errors, pa.string())], schema=arrow)

    return written(df.mapInArrow(work, schema), "answers")


def asked(client: LLMProvider, prompt: str, options: dict) -> str:
    """The client's answer; a client that has no response_format is asked without it."""
    try:
        return client.generate(prompt, **options)
    except TypeError as e:
        if "response_format" not in options or "response_format" not in str(e):
            raise
        return client.generate(prompt, **{k: v for k, v in options.items() if k != "response_format"})


def answered(df: DataFrame, provider: ColumnProvider | Callable[[], LLMProvider], *, attempts: int = 3, base_delay: float = 1.0, **options) -> DataFrame:
    """``df`` (with prompt) with raw, the answer, and error; a call that fails for good has raw null.

    options (model, temperature, max_tokens, system_prompt, response_format) go to
    every call. ``provider`` is a ColumnProvider or what makes an LLMProvider.
    """
    if isinstance(provider, ColumnProvider):
        return df.withColumn("raw", provider.answer(F.col("prompt"))).withColumn("error", F.lit(None).cast("string"))
    return _called(df, provider, lambda client, v: asked(client, v["prompt"], options), ["prompt"], attempts, base_delay)


def translated(df: DataFrame, provider: ColumnProvider | Callable[[], TranslationProvider], text: str, source: str, target: str, into: str, *, attempts: int = 3, base_delay: float = 1.0) -> DataFrame:
    """``df`` with column ``into``: column ``text`` from language ``source`` to ``target`` (columns); null where the call failed."""
    if isinstance(provider, ColumnProvider):
        return df.withColumn(into, provider.answer(F.col(text), F.col(source), F.col(target)))
    out = _called(df, provider, lambda client, v: client.translate(v[text], v[source], v[target]), [text, source, target], attempts, base_delay)
    return out.withColumnRenamed("raw", into).drop("error")


class OpenAIProvider(LLMProvider):
    """Chat completions. Parameters that the model refuses are renamed or left out, each once."""

    def __init__(self, api_key: str | None = None, model: str = "gpt-4o-mini", client=None) -> None:
        if client is None:
            try:
                from openai import OpenAI
            except ImportError as e:
                raise ImportError("this provider needs the openai package") from e
            client = OpenAI(api_key=api_key)
        self.client, self.model = client, model

    def generate(self, prompt, *, model=None, temperature=0.9, max_tokens=250, system_prompt=None, response_format=None):
        messages = [{"role": "system", "content": system_prompt}] * bool(system_prompt) + [{"role": "user", "content": prompt}]
        asked = {"model": model or self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}
        if response_format:
            asked["response_format"] = response_format
        while True:
            try:
                return (self.client.chat.completions.create(**asked).choices[0].message.content or "").strip()
            except Exception as e:
                said = str(e).lower()
                if "unsupported" in said and "max_tokens" in said and "max_tokens" in asked:
                    asked["max_completion_tokens"] = asked.pop("max_tokens")
                elif "unsupported" in said and "temperature" in said and "temperature" in asked:
                    del asked["temperature"]
                else:
                    raise


class GoogleTranslateProvider(TranslationProvider):
    def __init__(self, project_id: str, credentials_path: str | None = None, client=None) -> None:
        if client is None:
            try:
                from google.cloud import translate_v3
            except ImportError as e:
                raise ImportError("this provider needs the google-cloud-translate package") from e
            client = translate_v3.TranslationServiceClient.from_service_account_file(credentials_path) if credentials_path else translate_v3.TranslationServiceClient()
        self.client, self.parent = client, f"projects/{project_id}/locations/global"

    def translate(self, text, source_lang, target_lang):
        got = self.client.translate_text(request={"parent": self.parent, "contents": [text], "mime_type": "text/plain", "source_language_code": source_lang, "target_language_code": target_lang})
        return got.translations[0].translated_text


REGISTRY: dict[str, Callable[[], LLMProvider]] = {"openai": OpenAIProvider}


def resolved(provider) -> ColumnProvider | Callable[[], LLMProvider]:
    """A name in REGISTRY, an instance, a class or a ColumnProvider, as what the stages above take."""
    if isinstance(provider, str):
        if provider not in REGISTRY:
            raise ValueError(f"unknown provider {provider!r}; there are {', '.join(sorted(REGISTRY))}")
        return REGISTRY[provider]
    if isinstance(provider, ColumnProvider) or callable(provider):
        return provider
    return lambda: provider
