"""Benchmark passages in documents by a prefix-filtered set join, in DataFrame operations only.

A window is WINDOW words in a row of an item; an item of fewer words is one
window. The shingles of a window are its pairs of neighbouring words, ordered by
how rare they are in the corpus. An occurrence of the window has its rarest pair
at its place, so the join on that pair alone is enough to find it. Windows of an
item that have the same rarest pair overlap and are one segment, 24 words at
most; segments that items share are one too. The pair's places in document and
segment align the two, length and position bound what may match there, and the
windows of the aligned words are compared word by word.

Words are met as 32-bit hashes of their lower case, which are written once and
read by each pass. Lower case is that of all letters, with one form of sigma,
whose lower case follows its context: that joins no fewer than lower case of A-Z
alone. The comparison is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.shared import scratch, small, written

WINDOW = 13
# What stands between words: ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; the fast function where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def lower_loose(text: Column) -> Column:
    """All letters in lower case, each alike wherever it stands: the final sigma becomes the medial one."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def words_of(text: Column) -> Column:
    """The words of a text; splitting is much cheaper than extracting."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _hashes(text: Column) -> Column:
    return F.transform(words_of(lower_loose(text)), lambda w: F.hash(w))


def _pair(a: Column, b: Column) -> Column:
    """The two 32-bit hashes as one number; null without a second one."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def _pairs(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n, pos and pair of each two neighbouring words of column h."""
    both = F.zip_with("h", F.slice("h", 2, F.greatest(F.size("h"), F.lit(1))), _pair)
    return df.where("size(h) > 1").select(*keys, F.size("h").alias("n"), F.posexplode(F.slice(both, 1, F.size("h") - 1)).alias("pos", "pair"))


def _singles(df: DataFrame, *keys: str) -> DataFrame:
    """The same for words alone."""
    return df.select(*keys, F.size("h").alias("n"), F.posexplode("h").alias("pos", "pair")).withColumn("pair", F.col("pair").cast("long"))


def _meeting(words: DataFrame, own: DataFrame, *keys: str) -> DataFrame:
    """Words joined to ``own`` (pair, alone, ...): those of one-word items, which are alone, and all others by pairs."""
    met = _pairs(words, *keys).join(small(own.where("NOT alone")), "pair")
    alone = own.where("alone")
    return met if alone.isEmpty() else met.unionByName(_singles(words, *keys).join(small(alone), "pair"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, h, k (the size of a window) and item, a number, of each distinct item with words."""
    text = F.col("text").cast("string")
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(lower_ascii(text)).alias("words"), _hashes(text).alias("h")).where("size(words) > 0").distinct()
    return written(words.withColumn("k", F.least(F.size("words"), F.lit(WINDOW))).withColumn("item", F.monotonically_increasing_id()), "items")


def _segments(items: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Distinct segments (seg, pair, alone, off, k, part), the items of each (seg, item_id), and the tables that these read.

    off is where the pair stands in the segment's words, which are part.
    """
    own = _pairs(items, "item", "k").withColumn("alone", F.lit(False)).unionByName(_singles(items.where("size(h) = 1"), "item", "k").withColumn("alone", F.lit(True)))
    own = written(own, "item_pairs")
    counts = _meeting(words, own.select("pair", "alone").distinct()).groupBy("pair", "alone").agg(F.count(F.lit(1)).alias("often"))
    known = own.join(counts, ["pair", "alone"], "left").fillna(0, ["often"])
    window = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - F.greatest(F.col("k") - 2, F.lit(0))), F.least(F.col("pos"), F.col("n") - F.col("k"))))
    # Of equally rare pairs the first: then the windows of a pair follow each other.
    rarest = known.select("item", "pos", "pair", "alone", "often", window.alias("s")).groupBy("item", "s").agg(F.min(F.struct("often", "pos", "pair", "alone")).alias("p"))
    spans = rarest.groupBy("item", "p.pos", "p.pair", "p.alone").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    cut = spans.join(items.select("item", "item_id", "k", "words"), "item").select("item_id", "pair", "alone", "k", (F.col("pos") - F.col("low")).alias("off"), F.slice("words", F.col("low") + 1, F.col("high") - F.col("low") + F.col("k")).alias("part"))
    cut = written(cut.distinct(), "item_segments")
    same = ["pair", "alone", "k", "off", "part"]
    segments = written(cut.select(*same).distinct().withColumn("seg", F.monotonically_increasing_id()), "segments")
    return segments, cut.join(segments, same).select("seg", "item_id"), [segments, cut]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, row_key.

    Null and empty texts have no words and are clean, as all is beside an empty
    benchmark; items without words match nothing. Repeated items count by
    item_id; repeated documents get repeated rows. A long text is one row of
    hashes and of words, else nothing grows with a document but its number of
    rows. Other columns take no part.
    """
    # A row is told by doc_id (0 where it is null, which row_key tells apart) and a hash of both.
    row = ["own", "row_key"]
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("own", F.coalesce("doc_id", F.lit(0).cast("long")))
    with scratch() as keep:
        words = written(docs.select("doc_id", *row, _hashes(F.col("text")).alias("h")), "words")
        segments, members, parts = _segments(_items(benchmark), words)
        met = _meeting(words, segments.select("pair", "alone", "seg", "off", "k", F.size("part").alias("length")), *row).withColumn("delta", F.col("pos") - F.col("off"))
        inside = F.least(F.col("n"), F.col("delta") + F.col("length")) - F.greatest(F.lit(0), F.col("delta")) >= F.col("k")
        places = met.where(inside).groupBy(*row).agg(F.collect_set(F.struct("seg", "delta", "length")).alias("places"))
        places = written(places, "places")
        held = docs.join(small(places.select(*row)), row, "left_semi").select(*row, words_of(lower_ascii(F.col("text"))).alias("w")).join(places, row)
        first = F.greatest(F.lit(0), -F.col("delta"))
        aligned = held.select(*row, F.explode(F.transform("places", lambda p: F.struct(p["seg"].alias("seg"), p["delta"].alias("delta"), F.slice("w", F.greatest(p["delta"], F.lit(0)) + 1, p["length"] - F.greatest(F.lit(0), -p["delta"])).alias("here")))).alias("a")).select(*row, "a.*")
        both = aligned.join(small(segments.select("seg", "k", "part")), "seg").withColumn("first", first)
        hits = F.filter(F.sequence("first", F.col("first") + F.size("here") - F.col("k")), lambda s: F.slice("here", s - F.col("first") + 1, F.col("k")) == F.slice("part", s + 1, F.col("k")))
        found = written(both.select(*row, "seg", "delta", "k", hits.alias("hits")).where("size(hits) > 0"), "hits")
        keep(words, found, *parts)
    at = found.select(*row, F.explode(F.flatten(F.transform("hits", lambda s: F.sequence(F.col("delta") + s, F.col("delta") + s + F.col("k") - 1)))).alias("at"))
    n_hit = at.distinct().groupBy(*row).agg(F.count(F.lit(1)).alias("n_hit"))
    listed = found.select(*row, "seg").distinct().join(members, "seg").groupBy(*row).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    marks = n_hit.join(listed, row)
    out = words.select("doc_id", *row, F.size("h").cast("long").alias("n_words")).join(marks, row, "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "row_key")
