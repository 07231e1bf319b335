"""Prompts of the strategies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.config import TaskSpec
from corpusmill.functions.template import compiled

ANY_TOPIC = "any relevant topic"

TEMPLATES = {
    "direct": (
        "You write training examples for the task {task_name} in {language}.\nWhat the task is about: {task_description}\n"
        "Write one believable {text_domain} in {language} whose class is \"{label_name}\" ({label_description}).\n"
        "Length: {word_min} to {word_max} words. Subject: {topic}.\nAnswer with nothing but the {text_domain}."
    ),
    "paraphrase": (
        "Say the following {language} text in other words.\nIt belongs to the task: {task_description}\n"
        "Its class is \"{label_name}\" and must stay so; sound natural in {language}.\nText:\n{text}\nAnswer with nothing but the new text."
    ),
    "contrastive": (
        "Write the same {language} {text_domain} about {topic} twice.\nThe task: {task_description}\n"
        "First as \"{label_name}\" ({label_description}), then as \"{other_label_name}\" ({other_label_description}).\n"
        "Each has {word_min} to {word_max} words and differs from the other in class alone.\n"
        "Answer in JSON: {{\"{label_name}\": \"...\", \"{other_label_name}\": \"...\"}}"
    ),
    "judge": (
        "Judge an example made for the task {task_name}: {task_description}\nText: {text}\nIts class: {label_name}\nIts language: {language}\n"
        "Is it a realistic {text_domain}; is the class right; is the language natural; is it free of traces of its making?\n"
        "Answer in JSON: {{\"realistic\": true/false, \"label_correct\": true/false, \"natural_language\": true/false, \"no_artifacts\": true/false}}"
    ),
    "rag_qa": (
        "Write {num_samples} questions in {language} that the text below answers, each with its answer from that text alone.\n"
        "Text:\n{chunk}\nAnswer in JSON: {{\"qa_pairs\": [{{\"question\": \"...\", \"answer\": \"...\"}}]}}"
    ),
    "templated_generation": (
        "Take over the style of the text below, written about {source_topic}, for {num_samples} new {language} text(s) about {target_topic}.\n"
        "What to keep of its style: {style}\nText:\n{text}\nTake no facts from it. Answer in JSON: {{\"samples\": [{{\"text\": \"...\"}}]}}"
    ),
}


class PromptRenderer:
    """Fills the task's own template of a strategy, or else the one above."""

    def __init__(self, task: TaskSpec) -> None:
        self.task = task

    def template(self, strategy: str) -> str:
        own = self.task.prompt(strategy)
        if own is None and strategy not in TEMPLATES:
            raise ValueError(f"no prompt for the strategy {strategy!r}")
        return own or TEMPLATES[strategy]

    def render(self, strategy: str, language: Column | str, label: Column | None = None, **values: Column | str | int) -> Column:
        """The prompt of each row; ``label`` is its label's number, values are what the strategy adds."""
        task = self.task
        low, high = task.word_count_range
        known = {"language": language, "task_name": task.name, "task_description": task.description, "text_domain": task.text_domain, "word_min": low, "word_max": high}
        if label is not None:
            known |= {"label_name": self._by_label(label, task.label_name), "label_description": self._by_label(label, task.label_description)}
            if task.is_binary:
                known |= {"other_label_name": self._by_label(label, lambda i: task.label_name(task.other_label(i))), "other_label_description": self._by_label(label, lambda i: task.label_description(task.other_label(i)))}
        if "topic" in values and isinstance(values["topic"], Column):
            values["topic"] = F.coalesce(values["topic"], F.lit(ANY_TOPIC))
        return compiled(self.template(strategy), known | values)

    def _by_label(self, label: Column, text) -> Column:
        out = F.lit(None).cast("string")
        for i in self.task.label_indices:
            out = F.when(label == i, F.lit(text(i))).otherwise(out)
        return out
