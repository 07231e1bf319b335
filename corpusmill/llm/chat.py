"""Chat formatting with typed content parts, in DataFrame operations only.

A visitor turns each part of a turn into text: neighbouring texts are joined and
escaped together, image, audio and document parts become placeholders and leave,
in the same order, an attachment (kind, reference, token count). A turn is

    <s>ROLE[TEXT]BODY</s>

Control strings inside role and body are broken by a backslash behind their
first character, also where parts make them together, and backslashes are
doubled, so the text can be read back exactly. The loss mask says, for each turn,
where its body begins and, in turns, how many characters are text, which is
learned, and how many a placeholder, which is not.

Turns are formatted and put together in runs of RUN turns before they meet their
conversation, so a long conversation moves few rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
OPEN, TEXT, CLOSE = "<s>", "[TEXT]", "</s>"
CONTROL = r"</?s>|\[/?(?:TEXT|INST|IMAGE|AUDIO|DOCUMENT)\]"
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
#: Tokens that a part of each kind stands for where it does not say so itself.
PART_TOKENS = {"image": 576, "audio": 750, "document": 1024}
HOLE = r"\[(?:IMAGE|AUDIO|DOCUMENT)\]"
#: Characters of text that count as a token where no rule is given.
CHARS_A_TOKEN = 4
LEARNED = "assistant"
#: Turns, by number, that are put together first: 2**RUN_BITS.
RUN_BITS = 6

PART = "struct<type:string,text:string,ref:string,tokens:long>"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"(?=(?:{CONTROL}))(.)", r"$1\\")


def unescape(text: Column) -> Column:
    """What escape() was given: a backslash goes, and what follows it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The parts of a turn that is text alone."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def quarters(text: Column) -> Column:
    """Tokens of a text by its length."""
    return F.ceil(F.length(text) / CHARS_A_TOKEN)


def pretokens(text: Column) -> Column:
    """Tokens of a text by the rule that tokenizers split words with: runs of letters, single digits, runs of signs."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]+"))


def _visit(part: Column, count: Callable[[Column], Column]) -> Column:
    """text, placeholder (null for text), attachment (null for text) and expanded tokens of a part; an unknown type is text."""
    kind = F.lower(part["type"])
    placeholder = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in PLACEHOLDERS.items()])
    own = F.coalesce(part["tokens"], *[F.when(kind == k, F.lit(n)) for k, n in PART_TOKENS.items()]).cast("long")
    text = F.coalesce(part["text"], F.lit(""))
    return F.struct(
        text.alias("text"),
        placeholder.alias("placeholder"),
        F.when(placeholder.isNotNull(), F.struct(kind.alias("kind"), part["ref"].alias("ref"), own.alias("tokens"))).alias("attachment"),
        F.when(placeholder.isNotNull(), own).otherwise(count(text).cast("long")).alias("tokens"),
    )


def _runs(visited: Column) -> Column:
    """The texts between placeholders, joined and escaped, each with the placeholder after it, which is empty at the end."""
    n = F.size(visited)
    holes = F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(visited, i)["placeholder"].isNotNull())).otherwise(F.array().cast("array<int>"))
    ends = F.concat(holes, F.array(n + 1))
    begins = F.concat(F.array(F.lit(0)), holes)
    return F.zip_with(begins, ends, lambda a, b: F.struct(
        escape(F.array_join(F.transform(F.slice(visited, a + 1, b - a - 1), lambda v: v["text"]), "")).alias("text"),
        F.when(b <= n, F.element_at(visited, F.least(b, n))["placeholder"]).otherwise(F.lit("")).alias("hole"),
    ))


def format_turns(turns: DataFrame, count: Callable[[Column], Column] = quarters) -> DataFrame:
    """conv_id, turn, body, mask, attachments and tokens of each row (conv_id, turn, role, parts); ``count`` says how many tokens a text is."""
    seen = turns.withColumn("visited", F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: _visit(p, count)))
    seen = seen.withColumn("runs", _runs(F.col("visited")))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(TEXT))
    inner = F.array_join(F.transform("runs", lambda r: F.concat(r["text"], r["hole"])), "")
    learned = F.coalesce(F.col("role") == LEARNED, F.lit(False))
    return seen.select(
        "conv_id",
        F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.concat(head, inner, F.lit(CLOSE)).alias("body"),
        F.struct(learned.alias("learned"), F.length(head).alias("start"), F.transform("runs", lambda r: F.struct(F.length(r["text"]).alias("text"), F.length(r["hole"]).alias("hole"))).alias("runs")).alias("mask"),
        F.transform(F.filter("visited", lambda v: v["attachment"].isNotNull()), lambda v: v["attachment"]).alias("attachments"),
        F.aggregate("visited", F.lit(0).cast("long"), lambda n, v: n + v["tokens"]).alias("tokens"),
    )


def format_conversations(turns: DataFrame, count: Callable[[Column], Column] = quarters) -> DataFrame:
    """One row for each conversation: conv_id, formatted, mask, attachments, n_tokens.

    turns: conv_id, turn, role, parts. Turns go by number; turns of one number by
    role, then text; a null number comes first. Null roles and texts are empty,
    turns without parts too; null conv_id is one conversation. Repeated rows are
    turns of their own. mask has for each turn whether it is learned, where its
    body starts in the turn, and the lengths of texts and placeholders there, in
    code points. A conversation is one row, so its length is bounded by Spark's
    bound on a row (2 GB). Other columns take no part.
    """
    made = format_turns(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "parts"), count)
    row = F.struct("turn", "role", "body", "mask", "attachments", "tokens")
    runs = made.groupBy("conv_id", F.shiftright("turn", RUN_BITS).alias("run")).agg(F.sort_array(F.collect_list(row)).alias("t"))
    runs = runs.select("conv_id", F.struct("run", F.array_join("t.body", "").alias("body"), F.col("t.mask").alias("mask"), F.flatten("t.attachments").alias("attachments"), F.aggregate("t.tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("tokens")).alias("r"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return whole.select("conv_id", F.array_join("r.body", "").alias("formatted"), F.flatten("r.mask").alias("mask"), F.flatten("r.attachments").alias("attachments"), F.aggregate("r.tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text with its placeholders) and learned (texts under the mask), from formatted and mask alone."""
    turn = F.split(F.col("formatted"), CLOSE)
    cut = formatted.select("conv_id", "formatted", "mask", F.slice(turn, 1, F.size(turn) - 1).alias("raw"))
    at = F.transform("raw", lambda t: F.struct(unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), TEXT, 1)).alias("role"), unescape(F.substring_index(t, TEXT, -1)).alias("text")))
    def under(z: Column) -> Column:
        # Control strings in texts are broken, so what reads as a placeholder is one.
        size = F.aggregate(z["mask"]["runs"], F.lit(0), lambda n, r: n + r["text"] + r["hole"])
        return unescape(F.regexp_replace(F.substr(z["raw"], z["mask"]["start"] + 1, size), HOLE, ""))

    learned = F.transform(F.filter(F.arrays_zip("raw", "mask"), lambda z: z["mask"]["learned"]), under)
    return cut.select("conv_id", "formatted", at.alias("turns"), learned.alias("learned"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """The digests of what is read back."""
    back = read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
