"""What a dataset is about: its task and its languages."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


def _int_keys(value: dict | None) -> dict | None:
    return {int(k): v for k, v in value.items()} if value else None


@dataclass(frozen=True)
class TaskSpec:
    """A classification task. Labels are numbered; the numbers need not be dense."""

    name: str
    labels: dict[int, str]
    description: str
    label_descriptions: dict[int, str] | None = None
    topics: dict[str, list[str]] | None = None
    text_domain: str = "social media post"
    language_name: str = "English"
    word_count_range: tuple[int, int] = (20, 80)
    marker_keywords: dict[int, list[str]] | None = None
    custom_prompts: dict[str, str] | None = None

    def __post_init__(self) -> None:
        if len(self.labels) < 2:
            raise ValueError("a task requires at least 2 labels")
        object.__setattr__(self, "label_descriptions", self.label_descriptions or {})

    @property
    def label_indices(self) -> list[int]:
        return sorted(self.labels)

    @property
    def num_classes(self) -> int:
        return len(self.labels)

    @property
    def is_binary(self) -> bool:
        return self.num_classes == 2

    def label_name(self, index: int) -> str:
        return self.labels[index]

    def label_description(self, index: int) -> str:
        return self.label_descriptions.get(index, self.labels[index])

    def other_label(self, index: int) -> int | None:
        """The opposite label of a binary task."""
        return next((i for i in self.label_indices if i != index), None) if self.is_binary else None

    def prompt(self, strategy: str) -> str | None:
        return (self.custom_prompts or {}).get(strategy)

    def to_dict(self) -> dict:
        return asdict(self) | {"word_count_range": list(self.word_count_range)}

    @classmethod
    def from_dict(cls, data: dict) -> TaskSpec:
        own = {f.name: data[f.name] for f in fields(cls) if data.get(f.name) is not None}
        for name in ("labels", "label_descriptions", "marker_keywords"):
            if name in own:
                own[name] = _int_keys(own[name]) or {}
        if "word_count_range" in own:
            own["word_count_range"] = tuple(own["word_count_range"])
        return cls(**own)


@dataclass(frozen=True)
class LanguageConfig:
    """Languages by code, with what providers and strategies need to know of them."""

    languages: dict[str, str]
    iso_map: dict[str, str] = field(default_factory=dict)
    tiers: dict[int, list[str]] = field(default_factory=dict)
    related_languages: dict[str, str] = field(default_factory=dict)
    imbalanced: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def single(cls, code: str = "en", name: str = "English") -> LanguageConfig:
        return cls({code: name})

    def iso_code(self, code: str) -> str:
        return self.iso_map.get(code, code)

    def language_name(self, code: str) -> str:
        return self.languages.get(code, code)

    def all_language_codes(self) -> list[str]:
        return list(self.languages)

    def tier_languages(self, tier: int) -> list[str]:
        return list(self.tiers.get(tier, []))

    def related_language(self, code: str) -> str | None:
        return self.related_languages.get(code)

    def imbalance_info(self, code: str) -> dict | None:
        return self.imbalanced.get(code)

    @classmethod
    def from_dict(cls, data: dict) -> LanguageConfig:
        own = {f.name: data[f.name] for f in fields(cls) if data.get(f.name) is not None}
        if "tiers" in own:
            own["tiers"] = _int_keys(own["tiers"])
        return cls(**own)


def load_config(path: str) -> tuple[TaskSpec, LanguageConfig | None]:
    """A task, and languages where the file has them, of a JSON or YAML file."""
    kind, text = Path(path).suffix.lower(), Path(path).read_text(encoding="utf-8")
    if kind == ".json":
        data = json.loads(text)
    elif kind in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ImportError("reading YAML needs the PyYAML package") from e
        data = yaml.safe_load(text)
    else:
        raise ValueError(f"config must be .json, .yaml or .yml, not {kind or 'without a suffix'}")
    languages = data.get("languages")
    if isinstance(languages, dict) and "languages" not in languages:
        languages = {k: data.get(k) for k in ("languages", "iso_map", "tiers", "related_languages", "imbalanced")}
    return TaskSpec.from_dict(data), LanguageConfig.from_dict(languages) if languages else None


def load_task(path: str) -> TaskSpec:
    return load_config(path)[0]
