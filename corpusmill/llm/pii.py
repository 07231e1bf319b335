"""Personal data, also where it is disguised.

Transducers rewrite a text and keep for each character they emit the span of
source characters it came from: homoglyphs and full-width forms become ASCII,
invisible characters go, runs of spelled digits become digits, and "at" and
"dot" in their disguises become @ and a full stop. Identifiers found in the
rewritten text are mapped back to source spans. Texts without a sign of such
disguise are not rewritten, as the transducers would copy them.
"""

from __future__ import annotations

import re
import string
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.kernels import arrow_map, byte_values, text_bytes, word_hashes, words

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # behind a digit it has begun before
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
_LOCAL_CHARACTERS = string.ascii_letters + string.digits + "._%+-"
_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

# Characters that look like ASCII ones.
CYRILLIC = ("аеорсухіјѕкмтвнАЕОРСУХІЈЅКМТВН", "aeopcyxijskmtbhAEOPCYXIJSKMTBH")
GREEK = ("οαινρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaivpuABEZHIKMNOPTYX")
OTHERS = ("․·∙•＠﹫。｡‐‑‒–—−", "....@@..------")
INVISIBLE = "​‌‍⁠﻿­"
# Digits as words.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Spelled digits in a row that are read as a number.
MIN_SPELLED = 4

#: What compatibility forms (full-width, bold, circled and others) stand for, by Unicode's own tables.
_FORMS = {chr(i): n for i in (*range(0x80, 0x3400), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)) if len(n := unicodedata.normalize("NFKC", chr(i))) == 1 and n.isascii() and (n.isalnum() or n in "@.+-_")}
_LOOKALIKE = _FORMS | {a: b for src, dst in (CYRILLIC, GREEK, OTHERS) for a, b in zip(src, dst, strict=True)} | {c: "" for c in INVISIBLE}
_LOOKS = re.compile("[" + re.escape("".join(_LOOKALIKE)) + "]")
#: The same in two parts, of which each is a fast search.
_LOW_LOOKS, _HIGH_LOOKS = re.compile("[" + re.escape("".join(c for c in _LOOKALIKE if c < "\U00010000")) + "]"), re.compile("[\U0001d400-\U0001d7ff]")
_NUMBER = "|".join(sorted(SPELLED, key=len, reverse=True))
_DIGITS = re.compile(rf"(?<![^\W_])(?:plus[\s\-]+)?(?:(?:{_NUMBER}|[0-9])[\s,\-]+){{{MIN_SPELLED - 1},}}(?:{_NUMBER}|[0-9])(?![^\W_])", re.IGNORECASE)
_DIGIT = re.compile(rf"plus|{_NUMBER}|[0-9]", re.IGNORECASE)
_DOT = r"(?:\s*+[\[({<]\s*+(?:dot|\.|punkt|punto|point)\s*+[\])}>]\s*+|\s++(?:dot|punkt|punto|point)\s++|_dot_)"
#: The same, read from the end.
_TOD = r"(?:\s*+[\])}>]\s*+(?:tod|\.|tknup|otnup|tniop)\s*+[\[({<]\s*+|\s++(?:tod|tknup|otnup|tniop)\s++|_tod_)"
#: An @ in its disguises, without the white space around it.
_AT = re.compile(r"[\[({<]\s*+(?:at|@|arroba|arobase)\s*+[\])}>]|(?<=\s)(?:at|arroba|arobase)(?=\s)|_at_|@", re.IGNORECASE)
#: What stands before an @, from there to the left: an underscore may be part of a disguise.
_LOCAL = re.compile(rf"(?:[a-z0-9%+-]|_(?!tod_|ta_))++(?:(?:\.|{_TOD})(?:[a-z0-9%+-]|_(?!tod_|ta_))++)*(?![a-z0-9._%+-])", re.IGNORECASE | re.ASCII)
_DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)+", re.IGNORECASE)
_NUMBERS = re.compile(rf"(?<![0-9])[0-9]++(?:(?:\.|{_DOT})[0-9]++){{3}}", re.IGNORECASE)
_STOP = re.compile(_DOT, re.IGNORECASE)
_SPACES = re.compile(r"\s*")
_BRACKETS = re.compile(r"[\[({<]\s*(?:\.|@|at|arroba|arobase)\s*[\])}>]|_at_|\s@|@\s", re.IGNORECASE)
#: "AT" and "At", which need no disguised full stop as "at" does.
_CAPITAL_AT = re.compile(r"\s(?!(?:at|arroba|arobase)\s)(?i:at|arroba|arobase)\s+[A-Za-z0-9-]+\.")
#: White space and letters that the patterns take as ASCII ones, and signs() does not.
_WIDE = re.compile("[" + "".join(chr(i) for i in range(0x80, 0x3001) if chr(i).isspace()) + "\u0130\u0131\u017f\u212a]")
_DOT_WORDS = ("dot", "punkt", "punto", "point")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches of EMAIL, each @ looked at once.

    A match has one @ and begins as far left of it as its characters go, but not
    before the last match ends; searching from the left would read a long run of
    such characters again from each of them.
    """
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = _AFTER_AT.match(text, at + 1)
        if domain:
            # As many characters as the text between has: the run before the @, from the right.
            begin = len(text[last:at].rstrip(_LOCAL_CHARACTERS)) + last
            if begin < at:
                out.append((begin, domain.end()))
                last = domain.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """Kind, start and end of the spans of the base patterns, by kind, then start."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in emails(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


class Tape:
    """A rewritten text; character i came from source characters [start[i], end[i])."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans by texts; each emitted character maps to the whole span."""
        if not edits:
            return
        out, start, end, last = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[last:a], new]
            start += self.start[last:a]
            end += self.end[last:a]
            if new:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            last = b
        out.append(self.text[last:])
        self.text, self.start, self.end = "".join(out), start + self.start[last:], end + self.end[last:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _DIGITS.finditer(text):
        parts = [d[0].lower() for d in _DIGIT.finditer(m[0])]
        if sum(p in SPELLED for p in parts) >= MIN_SPELLED - 1:
            edits.append((m.start(), m.end(), "".join("+" if p == "plus" else SPELLED.get(p, p) for p in parts)))
    return edits


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Disguised @ and full stops of what reads as an address then; each @ is looked at once, to both sides."""
    edits, last, n, back = [], 0, len(text), text[::-1]
    for m in _AT.finditer(text):
        a, b = m.span()
        if a < last:
            continue
        if text[a] != "_":
            a, b = len(text[last:a].rstrip()) + last, b + len(_SPACES.match(text, b)[0])
        domain = _DOMAIN.match(text, b)
        local = domain and _LOCAL.match(back, n - a)
        if not local or n - local.end() < last:
            continue
        begin, word = n - local.end(), text[a:b].strip()
        stops = [(j.start(), j.end(), ".") for x, y in ((begin, a), (b, domain.end())) for j in _STOP.finditer(text, x, y)]
        if text[a:b] == "@" and not stops:
            continue
        if word in ("at", "arroba", "arobase") and not stops:
            continue  # "at" between words needs a disguised full stop too
        edits += [*stops, *([(a, b, "@")] if text[a:b] != "@" else [])]
        last = domain.end()
    return edits


def _joints(text: str) -> list[tuple[int, int, str]]:
    """Disguised @ and full stops inside what reads as an address or as four numbers then."""
    edits = _addresses(text)
    for m in _NUMBERS.finditer(text):
        edits += [(j.start(), j.end(), ".") for j in _STOP.finditer(text, m.start(), m.end())]
    edits.sort()
    return [e for k, e in enumerate(edits) if not k or e[0] >= edits[k - 1][1]]


def signs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row has two number words in a row, and whether it has a word for a full stop."""
    data, at = text_bytes(column)
    ends = np.zeros(256, bool)
    ends[:128] = [not chr(i).isalnum() for i in range(128)]
    begin, end, rows = words(data, at, ends)
    own = word_hashes(data, begin, end, byte_values(True))
    number, stop = (np.isin(own, _hashes(w)) for w in ((*SPELLED, "fÜnf", *"0123456789"), _DOT_WORDS))
    row = np.searchsorted(rows, np.arange(len(own)), "right") - 1
    pair = number[:-1] & number[1:] & (row[:-1] == row[1:]) if len(own) else np.zeros(0, bool)
    return tuple(np.bincount(row[: len(x)][x], minlength=len(column)) > 0 for x in (pair, stop))


def _hashes(listed: tuple[str, ...]) -> np.ndarray:
    data, at = text_bytes(pa.array(listed))
    return word_hashes(data, at[:-1], at[1:], byte_values(True))


def disguised(text: str, spelled: bool | None = None, stop: bool | None = None) -> list[tuple[int, int, int]]:
    """Kind and source span of the identifiers that only the rewritten text shows.

    spelled, stop: what signs() says of the text, where that is known.
    """
    if spelled is None or stop is None:
        spelled, stop = (bool(x[0]) for x in signs(pa.array([text])))
    if not text.isascii() and _WIDE.search(text):
        spelled = stop = True
    looks = not text.isascii() and bool(_LOW_LOOKS.search(text) or _HIGH_LOOKS.search(text))
    joints = stop or any(c in text for c in "[({<@_") and bool(_BRACKETS.search(text)) or bool(_CAPITAL_AT.search(text))
    if not (looks or spelled or joints):
        return []
    tape = Tape(text)
    if looks:
        tape.rewrite([(m.start(), m.end(), _LOOKALIKE[m[0]]) for m in _LOOKS.finditer(tape.text)])
    if spelled or looks:
        tape.rewrite(_spelled(tape.text))
    if joints or looks:
        tape.rewrite(_joints(tape.text))
    out = []
    for kind, a, b in identifiers(tape.text):
        s, e = tape.source(a, b)
        if text[s:e] != tape.text[a:b]:
            out.append((kind, s, e))
    return out


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """All spans: the base ones, and disguised ones that touch no base span; by kind, then start."""
    text = text or ""
    base = identifiers(text)
    added = [(k, s, e) for k, s, e in disguised(text) if not any(s < b and a < e for _, a, b in base)]
    return sorted(base + added)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans and base as array<struct<kind, start, end>>, for each row of ``docs``.

    Null and empty texts have none; repeated rows give repeated rows; other
    columns take no part, whatever their names.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("spans", pa.list_(span))])

    def named(found):
        return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in found]

    def work(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        base = [identifiers(t) for t in texts]
        every = [sorted(b + [x for x in disguised(t, *sign) if not any(x[1] < e and s < x[2] for _, s, e in b)]) for t, b, sign in zip(texts, base, zip(*signs(batch.column(1)), strict=True), strict=True)]
        return {"doc_id": batch.column(0), "base": [named(b) for b in base], "spans": [named(x) for x in every]}

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(arrow_map(work, schema), f"doc_id long, base {kind}, spans {kind}")
