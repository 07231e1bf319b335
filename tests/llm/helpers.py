"""Small tables with what is hard: nulls, blanks, ties, repeated rows, clashing columns."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "key long, node long, score double, row_key long, fp long, n long, place long, words string, spans string, keep_id long"


def documents(spark, texts, ids=None):
    """doc_id and text, with columns named as operators name theirs."""
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    for name in ("key", "node", "score", "row_key", "fp", "n", "place", "words", "spans", "keep_id", "_gone", "lang", "source"):
        df = df.selectExpr("*", f"7L AS {name}")
    return df


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((v is not None, v) for v in r))


def ink(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


HARD = [None, "", "   ", "one", "One", "a b c d e", "A b c d E", "ß É é 日本 😀", "x " * 5000, "a b c d e"]
