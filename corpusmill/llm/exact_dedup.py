"""Exact duplicates by counting quotient filters with byte verification.

A text's fingerprint is split into a block, a quotient and a remainder. Each
partition builds a counting quotient filter for each block: the quotient is the
home slot of a remainder, remainders of one quotient stand sorted in a run at or
after it, and a remainder that occurs more than once has its count in slots
behind it. One bit a slot says which quotients occur, where runs end and which
slots hold counts. Filters merge without loss: read in slot order they give
sorted remainders, equal ones meet and their counts add up. Texts whose
fingerprint counts more than one go on to verification, which groups them by
their bytes.

What is broadcast is a bitmap of the repeated fingerprints of bounded size: a
false hit only sends a text to verification that is found to be alone there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.bitmap import among, bitmap
from corpusmill.llm.kernels import arrow_map, released
from corpusmill.shared import dropped, heavy_join, small_batches, written

U = np.uint64
#: Fingerprints of a filter built at a time, in one partition.
FLUSH = 4 << 20
#: Fingerprints in a block of the merged filter, about.
BLOCK_ROWS = 1 << 18


def normal_bytes(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; null is empty."""
    return (text or "").encode().lower()


def _prints(texts: list[str | None]) -> tuple[list[int], list[str], list[bytes]]:
    norm = [normal_bytes(t) for t in texts]
    digests = [hashlib.sha256(n) for n in norm]
    return [int.from_bytes(d.digest()[:8], "big", signed=True) for d in digests], [d.hexdigest() for d in digests], norm


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, fingerprint and SHA-256 of each document's normalised text."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("fp", pa.int64()), ("text_sha256", pa.string())])

    def work(batch: pa.RecordBatch) -> dict:
        fp, sha, _ = _prints(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "row_key": batch.column(2), "fp": fp, "text_sha256": sha}

    return docs.withColumn("row_key", F.xxhash64("doc_id", "text")).mapInArrow(arrow_map(work, schema), "doc_id long, row_key long, fp long, text_sha256 string")


def slots(values: np.ndarray, counts: np.ndarray, quotient_bits: int, rest_bits: int) -> tuple[bytes, bytes, bytes, bytes]:
    """A filter of sorted distinct values: which quotients occur, run ends, count slots (bits), and what the slots hold."""
    home, rest = (values >> U(rest_bits)).astype(np.int64), values & U((1 << rest_bits) - 1)
    base, left, digits = 1 << rest_bits, counts.astype(np.int64) - 1, []
    while left.any():
        digits.append(np.where(left > 0, left % base, -1))
        left = left // base
    size = 1 + sum(((d >= 0).astype(np.int64) for d in digits), np.zeros(len(values), np.int64))
    before = np.cumsum(size) - size
    at = np.maximum.accumulate(home - before) + before
    n = max(1 << quotient_bits, int(at[-1] + size[-1])) if len(values) else 1 << quotient_bits
    occupied, ends, counter = np.zeros(1 << quotient_bits, bool), np.zeros(n, bool), np.zeros(n, bool)
    held = np.zeros(n, U)
    occupied[home] = True
    ends[(at + size - 1)[np.append(home[1:] != home[:-1], True)[: len(home)]]] = True
    held[at] = rest
    for k, d in enumerate(digits, 1):
        more = d >= 0
        held[at[more] + k], counter[at[more] + k] = d[more].astype(U), True
    width = -(-rest_bits // 8)
    return *(np.packbits(x).tobytes() for x in (occupied, ends, counter)), held.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].tobytes()


def read_slots(occupied: bytes, ends: bytes, counter: bytes, held: bytes, quotient_bits: int, rest_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of a filter and their counts."""
    width = -(-rest_bits // 8)
    wide = np.zeros((len(held) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(held, np.uint8).reshape(-1, width)
    slot, n = wide.reshape(-1).view("<u8").astype(U), len(wide)
    home = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8), count=1 << quotient_bits))
    last = np.flatnonzero(np.unpackbits(np.frombuffer(ends, np.uint8), count=n))
    first = np.maximum(home, np.concatenate([[0], last[:-1] + 1])[: len(home)])
    size = last - first + 1
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    counts = np.unpackbits(np.frombuffer(counter, np.uint8), count=n)[at].astype(bool)
    own = np.flatnonzero(~counts)
    many = np.ones(len(own), np.int64)
    which = np.cumsum(~counts) - 1
    digit = np.flatnonzero(counts)
    np.add.at(many, which[digit], slot[at[digit]].astype(np.int64) << (rest_bits * (digit - own[which[digit]] - 1)))
    return np.repeat(home, size)[own].astype(U) << U(rest_bits) | slot[at[own]], many


def build_filters(fps: np.ndarray, bits: int, width: int = 64) -> list[tuple]:
    """block, quotient bits and the parts of the filter of each block (the highest ``bits`` of ``width``)."""
    values, counts = np.unique(fps.astype(U), return_counts=True)
    block = (values >> U(width - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    rest = values & U((1 << (width - bits)) - 1)
    cuts = np.flatnonzero(np.diff(block)) + 1
    out = []
    for i, j in zip([0, *cuts], [*cuts, len(values)], strict=True):
        if j > i:
            # As many slots as values, or up to twice as many.
            quotient = min(int(j - i - 1).bit_length(), width - bits - 1)
            out.append((int(block[i]), quotient, *slots(rest[i:j], counts[i:j], quotient, width - bits - quotient)))
    return out


def merge_filters(parts: list[tuple], bits: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and their counts, of filters (quotient bits and parts) of one block."""
    every = [read_slots(*p[1:], p[0], width - bits - p[0]) for p in parts]
    rest, many = (np.concatenate(x) for x in zip(*every, strict=True))
    order = np.argsort(rest, kind="stable")
    rest, many = rest[order], many[order]
    first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
    return rest[first], np.add.reduceat(many, first)


def repeated(prints: DataFrame, rows: int, partitions: int) -> DataFrame:
    """Fingerprints that occur more than once, with their counts."""
    bits = max(0, int(np.ceil(np.log2(max(partitions, rows / BLOCK_ROWS, 1)))))
    parts = ["occupied", "ends", "counter", "held"]
    schema = pa.schema([("block", pa.int64()), ("quotient", pa.int64()), *((p, pa.binary()) for p in parts)])
    kind = "block long, quotient long, " + ", ".join(f"{p} binary" for p in parts)

    def build(batches):
        held, n = [], 0

        def flush():
            made = build_filters(np.concatenate(held), bits) if held else []
            for i in range(0, len(made), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made[i : i + 64], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            held.append(batch.column(0).to_numpy().astype(np.int64))
            n += len(held[-1])
            if n >= FLUSH:
                yield from flush()
                held, n = [], 0
        yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        rest, many = merge_filters(list(zip(*(table[c].to_pylist() for c in ("quotient", *parts)), strict=True)), bits)
        high = U(table["block"][0].as_py() << (64 - bits)) if bits else U(0)
        twice = many > 1
        return pa.table({"fp": (rest[twice] | high).astype(np.int64), "n": many[twice]})

    return prints.select("fp").mapInArrow(released(build), kind).groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, row_key.

    Null text is empty, and empty texts equal each other. Of equal texts the
    largest doc_id stays; rows that repeat that doc_id too are alike and all
    have kept set. A null doc_id stays only where no other row has its text.
    The memory of a task grows with the longest text, not with a group.
    Other columns of ``docs``, whatever their names, take no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = written(fingerprints(docs), "prints")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    again = written(repeated(prints, prints.count(), partitions), "repeated")
    twice = spark.sparkContext.broadcast(bitmap(again, "fp", again.count()))
    dropped(again)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("norm", pa.string())])

    def candidates(batch: pa.RecordBatch) -> dict | None:
        fp, _, norm = _prints(batch.column(1).to_pylist())
        take = np.flatnonzero(among(fp, twice.value))
        return {"doc_id": batch.column(0).take(pa.array(take)), "fp": [fp[i] for i in take], "norm": [norm[i].decode() for i in take]} if len(take) else None

    groups = (
        docs.mapInArrow(arrow_map(candidates, schema), "doc_id long, fp long, norm string")
        .groupBy("fp", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("fp", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    joined = heavy_join(prints, written(groups, "groups"), ["fp", "text_sha256"], "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "row_key")
