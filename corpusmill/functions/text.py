"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.strip sees it.
_SPACE = r"[\s\x1c-\x1f]"
# What models put before the text asked for, in the order tried.
PREFIXES = ("Here is", "Here's", "Social media post:", "Post:", "Text:", "Output:", "Result:", "Translation:", "Rewritten:", "Version:")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def not_blank(c: Column) -> Column:
    return c.isNotNull() & c.rlike(r"(?U)[^\s\x1c-\x1f]")


def _any_case(text: str) -> str:
    return "".join(f"[{ch.lower()}{ch.upper()}]" if ch.isascii() and ch.isalpha() else f"\\{ch}" if not ch.isalnum() and ch != " " else ch for ch in text)


def clean_generated(c: Column) -> Column:
    """A model's answer without lead-in and quotes; null is empty.

    Each prefix is tried once, in order, and takes one colon or hyphen behind it
    along; then one pair of quotes around the whole goes.
    """
    lead_in = "".join(rf"(?:{_any_case(p)}{_SPACE}*+(?:[:\-]{_SPACE}*+)?+)?+" for p in PREFIXES)
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U)\A{_SPACE}*+{lead_in}|{_SPACE}+\z", "")
    return strip(F.regexp_replace(bare, r"(?s)\A(?:\"(.*)\"|'(.*)'|[\"'])\z", "$1$2"))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def tokens(c: Column) -> Column:
    """The lower-case words between white space, in order; of ASCII texts by a pattern that costs less and says the same."""
    low = F.lower(c)
    return F.array_remove(F.when(is_ascii(c), F.split(low, r"[\s\x1c-\x1f]+")).otherwise(F.split(low, r"(?U)[\s\x1c-\x1f]+")), "")


def words(c: Column) -> Column:
    """The distinct lower-case words between white space."""
    return F.array_distinct(tokens(c))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 1 for two empty texts, 0 for one. Each text is split once."""

    def share(s: Column) -> Column:
        shared = F.size(F.array_intersect(s["x"], s["y"]))
        every = F.size(s["x"]) + F.size(s["y"]) - shared
        return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)

    sets = F.struct(words(F.coalesce(a, F.lit(""))).alias("x"), words(F.coalesce(b, F.lit(""))).alias("y"))
    return F.element_at(F.transform(F.array(sets), share), 1)


def preview(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def sample_id(prefix: str, source: str, index: Column, run_id: str) -> Column:
    """An id that is the same in every run with the same run_id."""
    return F.concat(F.lit(f"{prefix}_syn_"), F.substring(F.md5(F.concat_ws("_", F.lit(prefix), F.lit(source), index.cast("string"), F.lit(run_id)).cast("binary")), 1, 12))


def draw(*parts: Column | str) -> Column:
    """A number from 0 to 2**32 - 1 that looks random and depends on ``parts`` alone."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def pick(values: Column, number: Column) -> Column:
    """The element of an array that a drawn number falls on; null of an empty one."""
    return F.when(F.size(values) > 0, F.element_at(values, (F.pmod(number, F.greatest(F.size(values), F.lit(1))) + 1).cast("int")))
