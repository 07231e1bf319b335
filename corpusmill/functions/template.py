"""Format strings as column expressions."""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def compiled(template: str, values: Mapping[str, Column | str | int]) -> Column:
    """``template`` with its {fields} filled in; doubled braces are braces.

    A field without a value is an error when the plan is made, not in a task.
    Null values are empty.
    """
    parts: list[Column] = []
    for text, name, spec, conversion in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        if spec or conversion or name not in values:
            raise KeyError(f"the prompt template asks for {name!r}; there are {', '.join(sorted(values))}")
        value = values[name]
        parts.append(F.coalesce(value.cast("string"), F.lit("")) if isinstance(value, Column) else F.lit(str(value)))
    return F.concat(*parts) if parts else F.lit("")
