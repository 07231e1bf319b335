"""Packing along a Hilbert curve.

A document's hashed token counts are projected to DIMS dimensions; the cell it
falls in has a place on a Hilbert curve through them. Documents are range-sorted
by that place, so documents that resemble each other stand together, and their
ids, one document after the other, are cut into sequences. Only what is left at
a partition's end is shorter than a sequence; it is cut at powers of two, which
need no padding.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.kernels import arrow_map, kept, released
from corpusmill.shared import small_batches, written

SEQUENCE = 2048
END_ID = 1
DIMS, BITS = 3, 10
BUCKETS = 256
#: Words whose ids a worker remembers.
REMEMBERED = 400_000
# Fixed value: the words that the vocabulary's own pattern splits off, of lower-case text.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


class Memory(dict):
    """Ids of words; a word that is not remembered stands for itself and is noted."""

    def __init__(self) -> None:
        self.unknown: set[str] = set()

    def __missing__(self, word: str) -> str:
        self.unknown.add(word)
        return word


class WordTokenizer:
    """Ids of whole texts, as the tokenizer in ``path`` gives them.

    That tokenizer encodes each word by itself, so words are remembered. Texts
    with characters outside Latin letters, ASCII and common signs, or with a
    special token's string, are given to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        vocab = self.inner.get_vocab()
        if max(vocab.values()) > 0xFFFF:
            raise ValueError("ids must fit 16 bits")
        self.last = np.zeros(1 << 16, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        plain = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x180)) if c not in (0xAD, 0x130)]
        plain = [c for c in plain if unicodedata.is_normalized("NFC", c)] + list("–—‘’“”…")
        kinds = {k: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == k and c == c.lower()) for k in "LN"}
        self.strange = re.compile("[^" + re.escape("".join(plain)) + r"]|<\|(?:startoftext|endoftext)\|>")
        self.split = re.compile(rf"{CONTRACTIONS}|[{kinds['L']}]+|[{kinds['N']}]|[^\s{kinds['L']}{kinds['N']}]+").findall
        self.known = Memory()

    def _learn(self, unknown: list[str]) -> dict[str, bytes]:
        ids = np.array(self.inner.encode(" ".join(unknown), add_special_tokens=False).ids, np.uint16)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(unknown):
            return {w: np.array(self.inner.encode(w, add_special_tokens=False).ids, np.uint16).tobytes() for w in unknown}
        raw, cuts = ids.tobytes(), [0, *(2 * ends).tolist()]
        return {w: raw[a:b] for w, a, b in zip(unknown, cuts, cuts[1:], strict=False)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text."""
        get = self.known.__getitem__
        found = [None if self.strange.search(t) else list(map(get, self.split(t.lower()))) for t in texts]
        unknown = list(self.known.unknown)
        self.known.unknown.clear()
        new: dict[str, bytes] = {}
        for i in range(0, len(unknown), 4096):
            new |= self._learn(unknown[i : i + 4096])
        if len(self.known) + len(new) <= REMEMBERED:
            self.known.update(new)
        whole = self.inner.encode
        return [np.array(whole(t, add_special_tokens=False).ids, np.uint16).tobytes() if ids is None else b"".join([i if i.__class__ is bytes else new[i] for i in ids]) for t, ids in zip(texts, found, strict=True)]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on a Hilbert curve of each row of ``cells``, each of them below 2**bits.

    The cells' bits are turned, from the highest down, by what the bits above
    them say about the curve's direction; then the Gray code is undone and the
    bits of all dimensions are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for d in range(dims):
            high = x[d] >> level & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(high, below, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | (x[d] >> level & 1)
    return out


def _projection() -> np.ndarray:
    return np.random.default_rng(31337).normal(size=(BUCKETS, DIMS))


def places(ids: list[np.ndarray]) -> np.ndarray:
    """Each document's place on the curve, from its ids alone."""
    bucket = np.random.default_rng(99).integers(0, BUCKETS, 1 << 16)
    counts = np.stack([np.bincount(bucket[i], minlength=BUCKETS) for i in ids]).astype(float) if ids else np.zeros((0, BUCKETS))
    counts = np.sqrt(counts)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    share = 1 / (1 + np.exp(-1.7 * (counts @ _projection())))
    return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, place, n, and ids (16 bits each, END_ID behind them) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def work(batch: pa.RecordBatch) -> dict:
        tokenizer = kept(("tokenizer", path), lambda: WordTokenizer(path))
        end = np.array([END_ID], np.uint16).tobytes()
        ids = [i + end for i in tokenizer.encode([t or "" for t in batch.column(1).to_pylist()])]
        return {"doc_id": batch.column(0), "place": places([np.frombuffer(i, np.uint16) for i in ids]), "n": [len(i) // 2 for i in ids], "ids": ids}

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(arrow_map(work, schema), "doc_id long, place long, n long, ids binary")


class Packer:
    """Cuts a stream of documents into sequences; gives pieces when their sequence is full."""

    def __init__(self, first: int, size: int = SEQUENCE) -> None:
        self.sequence, self.size = first, size
        self.open: list[tuple] = []
        self.filled = 0
        self.done: list[tuple] = []

    def _close(self) -> None:
        offset = 0
        for doc_id, start, ids, total in self.open:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        self.open, self.filled = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray, start: int = 0, total: int | None = None, limit: int | None = None) -> None:
        limit, total, at = limit or self.size, total or len(ids), 0
        while at < len(ids):
            take = min(len(ids) - at, limit - self.filled)
            self.open.append((doc_id, start + at, ids[at : at + take], total))
            self.filled += take
            at += take
            if self.filled == limit:
                self._close()

    def finish(self) -> None:
        """Cut what is left at falling powers of two."""
        rest, left = self.open, self.filled
        self.open, self.filled = [], 0
        for doc_id, start, ids, total in rest:
            at = 0
            while at < len(ids):
                room = (1 << left.bit_length() - 1) - self.filled
                take = min(len(ids) - at, room)
                limit = room + self.filled
                self.add(doc_id, ids[at : at + take], start + at, total, limit)
                at += take
                if not self.filled:
                    left -= limit


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Equal documents stand beside each
    other, by doc_id; rows that repeat are packed again. Other columns take no
    part, whatever their names. A sequence is SEQUENCE ids, or a power of two
    below it at a partition's end; sequence_id is unique, not dense.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table = written(tokenized(docs, path), "tokens")
    schema = pa.schema([(f.split()[0], pa.int64()) for f in PIECE.split(", ")])

    def work(batches):
        packer = Packer(TaskContext.get().partitionId() << 32)

        def out():
            done, packer.done = packer.done, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.frombuffer(ids.as_buffer(), np.uint16))
                if len(packer.done) >= 10_000:
                    yield out()
        packer.finish()
        if packer.done:
            yield out()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["place", "doc_id", "n"]
    return table.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(released(work), PIECE)
