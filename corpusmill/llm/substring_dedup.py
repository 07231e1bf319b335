"""Repeated passages by recompression.

A text is a row of word names. In each round runs of one name and pairs of two
names of opposite classes get a name of their own, which is a hash of what it
stands for: so names are the same in every document and task, and a round needs
no exchange. With each name goes its context, the span of words that its shape
depends on. A window owns the names whose context lies inside it; where the same
words stand elsewhere, the same names stand there. So a window of which one
owned name occurs once in the corpus is no repeat, and only windows without such
a name are verified: by 96 bits of hash of their words, compared over the corpus.
Of 2e13 windows, what 100 TB of text may hold, 0.003 pairs that differ are expected to agree in them.

Nothing gathers by a passage: a partition sends each distinct name or window
once, with whether it occurs again there, and gets back one bit for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.bitmap import among, bitmap
from corpusmill.llm.kernels import arrow_map, byte_values, chunks, mix, released, space_table, text_bytes, window_hashes, word_hashes, words
from corpusmill.shared import dropped, small_batches, written

U = np.uint64
WINDOW = 35
ROUNDS = 4
#: Names or windows that a task holds before it sends them; for each block, as many at least as PER_BLOCK.
FLUSH, PER_BLOCK = 1 << 20, 64
#: Bytes of input for which there is a block, and the bits of the most blocks.
BLOCK_BYTES, BLOCK_BITS = 32 << 20, 18


class Parse:
    """Names after some rounds: cover [a, b) and context [cs, ce), in words of the chunk."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        n = len(hashes)
        self.name = hashes
        self.doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        self.cs, self.ce = np.arange(n), np.arange(1, n + 1)
        self.rows = rows

    def round(self, k: int) -> None:
        """Name runs, and pairs of single names of a left and a right class."""
        s, n = self.name, len(self.name)
        if not n:
            return
        tied = np.zeros(n + 1, bool)
        tied[1:n] = self.doc[1:] == self.doc[:-1]
        again = np.zeros(n + 1, bool)
        again[1:n] = tied[1:n] & (s[1:] == s[:-1])
        single = ~(again[:-1] | again[1:])
        right = (mix(s ^ U(0x1F83D9ABFB41BD6B * (k + 1) & (1 << 64) - 1)) & U(1)).astype(bool)
        pair = np.zeros(n + 1, bool)
        pair[:-2] = (single & ~right)[:-1] & (single & right)[1:] & tied[1:n]
        inner = again.copy()
        inner[1:] |= pair[:-1]
        i = np.flatnonzero(~inner[:-1])
        j = np.append(i[1:], n)
        size = j - i
        name = s[i]
        run, two = again[np.minimum(i + 1, n)], pair[i]
        name = np.where(run, mix(name * U(0x9E6C63D0876A9A47) + size.astype(U) * U(0xD1B54A32D192ED03)), name)
        p = i[two]
        name[two] = mix(mix(s[p] + U(0x8CB92BA72F3D8DD7)) + s[p + 1] * U(0xAEF17502108EF2D9))
        edge = self.rows
        before, behind = tied[i], tied[j]
        cs = np.where(before, self.cs[np.maximum(i - 1, 0)], edge[self.doc[i]] - 1)
        ce = np.where(behind, self.ce[np.minimum(j, n - 1)], edge[self.doc[i] + 1] + 1)
        # A single name beside one of the other class that is in a run: that run's second name decides too.
        alone = ~run & ~two
        far = alone & ~right[i] & behind & right[np.minimum(j, n - 1)]
        ce[far] = self.ce[np.minimum(j[far] + 1, n - 1)]
        far = alone & right[i] & before & ~right[np.maximum(i - 1, 0)]
        cs[far] = self.cs[np.maximum(i[far] - 2, 0)]
        self.name, self.doc, self.cs, self.ce = name, self.doc[i], cs, ce


def parse(hashes: np.ndarray, rows: np.ndarray) -> Parse:
    out = Parse(hashes, rows)
    for k in range(ROUNDS):
        out.round(k)
    return out


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_bytes(column)
    begin, end, rows = words(data, at, space_table())
    return word_hashes(data, begin, end, byte_values(False)), rows


def _named(names: np.ndarray) -> np.ndarray:
    """48 bits of each name, as an int64: enough for a filter."""
    return (names >> U(16)).astype(np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and whether each occurs more than once."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values))) > 1


def planes(values: np.ndarray) -> bytes:
    """Integers byte by byte, the lowest bytes of all first: zeros stand together and compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def repeated_names(docs: DataFrame, bits: int) -> DataFrame:
    """Names (48 bits) that occur more than once in the corpus."""
    width = (48 - bits + 7) // 8
    schema = pa.schema([("block", pa.int64()), ("names", pa.binary()), ("twice", pa.binary())])

    def send(batches):
        held: list[np.ndarray] = []

        def flush():
            value, twice = _distinct(np.concatenate(held))
            block = value >> (48 - bits)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(value)]
            rest = (value & ((1 << (48 - bits)) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
            parts = [(int(block[a]), rest[a:b].tobytes(), np.packbits(twice[a:b]).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for i in range(0, len(parts), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts[i : i + 256], strict=True), schema, strict=True)], schema=schema)

        for chunk in chunks(batches):
            hashes, rows = _hashed(chunk.column(0))
            names = _named(parse(hashes, rows).name)
            if len(names):
                held.append(names)
            if sum(map(len, held)) >= max(FLUSH, PER_BLOCK << bits):
                yield from flush()
                held = []
        if held:
            yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        every, twice = [], []
        for names, flags in zip(table["names"].to_pylist(), table["twice"].to_pylist(), strict=True):
            raw = np.frombuffer(names, np.uint8).reshape(-1, width)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :width] = raw
            every.append(wide.reshape(-1).view("<u8").astype(np.int64))
            twice.append(every[-1][np.unpackbits(np.frombuffer(flags, np.uint8), count=len(raw)).astype(bool)])
        value, again = _distinct(np.concatenate(every))
        found = np.union1d(value[again], np.concatenate(twice))
        return pa.table({"name": found | (table["block"][0].as_py() << (48 - bits))})

    sent = docs.select("text").mapInArrow(released(send), "block long, names binary, twice binary")
    return sent.groupBy("block").applyInArrow(merge, "name long")


def _windows(hashes: np.ndarray, rows: np.ndarray, known: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts, in words of the chunk, and rows of the windows that may be repeats."""
    n = np.maximum(np.diff(rows) - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(rows[:-1], n)
    got = parse(hashes, rows)
    once = np.concatenate([[0], np.cumsum(~among(_named(got.name), known))])
    low = np.searchsorted(np.maximum.accumulate(got.cs), start, "left") if len(got.cs) else start
    high = np.searchsorted(np.maximum.accumulate(got.ce), start + WINDOW, "right") if len(got.ce) else start
    keep = (low >= high) | (once[high] == once[np.minimum(low, len(once) - 1)])
    return start[keep], row[keep]


def _sent(docs: DataFrame, known: bytes, bits: int) -> DataFrame:
    """Two kinds of rows. block >= 0: a task's distinct windows of that block. block -1: where its windows stand."""
    shipped = docs.sparkSession.sparkContext.broadcast(known)
    names = ["block", "src", "h1", "h2", "twice", "keys", "counts", "pos", "index"]
    schema = pa.schema([(n, pa.int64() if n in ("block", "src") else pa.binary()) for n in names])

    def send(batches):
        task, turn = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush():
            h1, h2, pos = (np.concatenate([h[k] for h in held]) for k in range(3))
            keys, counts = (np.concatenate([h[k] for h in held]) for k in (3, 4))
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            index = np.empty(len(order), np.uint32)
            index[order] = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            twice = np.diff(np.append(first, len(a))) > 1
            a, b = a[first], b[first]
            block = (a >> U(64 - bits)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(a)]
            src = task << 32 | turn
            step = np.diff(pos, prepend=np.int32(0))
            rows = [(-1, src, None, None, None, keys.tobytes(), planes(counts), planes(step), planes(index))]
            rows += [(int(block[i]), src, planes(np.diff(a[i:j], prepend=U(0))), b[i:j].tobytes(), np.packbits(twice[i:j]).tobytes(), None, None, None, None) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            for k in range(0, len(rows), 128):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 128], strict=True), schema, strict=True)], schema=schema)

        for chunk in chunks(batches):
            hashes, rows = _hashed(chunk.column(2))
            start, row = _windows(hashes, rows, shipped.value)
            if len(start):
                h1 = window_hashes(hashes, WINDOW)[start]
                h2 = (window_hashes(hashes ^ U(0x3C6EF372FE94F82B), WINDOW, 0x4F1BBCDCBFA53E0B)[start] >> U(32)).astype(np.uint32)
                which, counts = np.unique(row, return_counts=True)
                keys = np.stack([chunk.column(0).to_numpy()[which], chunk.column(1).to_numpy()[which]], 1)
                held.append((h1, h2, (start - rows[row]).astype(np.int32), keys, counts))
            if sum(len(h[0]) for h in held) >= max(FLUSH, PER_BLOCK << bits):
                yield from flush()
                held, turn = [], turn + 1
        if held:
            yield from flush()

    kinds = ", ".join(f"{n} {'long' if n in ('block', 'src') else 'binary'}" for n in names)
    return docs.select("own", "key", "text").mapInArrow(released(send), kinds)


def _verdicts(table: pa.Table) -> pa.Table:
    """For each sender of a block, a bit for each of its windows: whether it occurs again."""
    src = table["src"].to_pylist()
    h1 = [np.cumsum(from_planes(x, U), dtype=U) for x in table["h1"].to_pylist()]
    many = np.array([len(x) for x in h1])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(table["twice"].to_pylist(), many, strict=True)])
    a, b = np.concatenate(h1), np.concatenate([np.frombuffer(x, np.uint32) for x in table["h2"].to_pylist()])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    met = np.zeros(len(a), bool)
    met[1:] |= same
    met[:-1] |= same
    out = np.empty(len(a), bool)
    out[order] = met
    out |= twice
    ends = np.cumsum(many)
    return pa.table({"src": pa.array(src, pa.int64()), "block": pa.array([table["block"][0].as_py()] * len(src), pa.int64()), "n": pa.array(many, pa.int64()), "bits": pa.array([np.packbits(out[e - n : e]).tobytes() for e, n in zip(ends, many, strict=True)], pa.binary())})


def _spans(places: pa.Table, verdicts: pa.Table) -> pa.Table:
    """For each document of a sender, the merged spans of words that repeats cover."""
    schema = pa.schema([("own", pa.int64()), ("key", pa.int64()), ("begins", pa.binary()), ("ends", pa.binary())])
    out: list[tuple] = []
    if places.num_rows and verdicts.num_rows:
        verdicts = verdicts.sort_by("block")
        bits = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(verdicts["bits"].to_pylist(), verdicts["n"].to_pylist(), strict=True)]).astype(bool)
        keys, counts = np.frombuffer(places["keys"][0].as_py(), np.int64).reshape(-1, 2), from_planes(places["counts"][0].as_py(), np.int64)
        pos = np.cumsum(from_planes(places["pos"][0].as_py(), np.int32), dtype=np.int64)
        hit = bits[from_planes(places["index"][0].as_py(), np.uint32)]
        doc, start = np.repeat(np.arange(len(keys)), counts)[hit], pos[hit]
        if len(doc):
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + WINDOW)])
            first = np.flatnonzero(new)
            begin, end, own = start[first], start[np.append(first[1:], len(doc)) - 1] + WINDOW, doc[first]
            cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
            out = [(*keys[own[i]].tolist(), begin[i:j].tobytes(), end[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ([], [], [], []), schema, strict=True)], schema=schema)


def _kept(text: bytes, begins: bytes | None, ends: bytes | None) -> tuple[int, int, str]:
    own = text.split()
    n, gone = len(own), 0
    if begins:
        left, last = [], 0
        for a, b in zip(np.frombuffer(begins, np.int64).tolist(), np.frombuffer(ends, np.int64).tolist(), strict=True):
            left += own[last:a]
            last = b
        own = left + own[last:]
        gone = n - len(own)
    return n, gone, b" ".join(own).decode()


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, text.

    Words stand between ASCII white space. Every word that a window of WINDOW
    words covers whose words also start elsewhere, in the same document or in
    another, is removed, in all places; rows that repeat are each other's
    repeats. Null and empty texts have no words. The memory of a task grows with
    the longest text. Other columns take no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # A row is told by doc_id (0 where it is null, which key tells apart) and a hash of both.
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("own", F.coalesce("doc_id", F.lit(0).cast("long")))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(size, 1 << 60) // BLOCK_BYTES)
    bits = min(BLOCK_BITS, max(6, int(np.ceil(np.log2(blocks)))))
    names = written(repeated_names(docs, bits), "names")
    known = bitmap(names, "name", names.count())
    dropped(names)
    sent = written(_sent(docs, known, bits), "windows")
    verdicts = sent.where("block >= 0").select("block", "src", "h1", "h2", "twice").groupBy("block").applyInArrow(_verdicts, "src long, block long, n long, bits binary")
    places = sent.where("block < 0").select("src", "keys", "counts", "pos", "index")
    spans = places.groupBy("src").cogroup(verdicts.groupBy("src")).applyInArrow(_spans, "own long, key long, begins binary, ends binary")
    spans = written(spans.dropDuplicates(["own", "key"]), "spans")
    dropped(sent)
    touched = spark.sparkContext.broadcast(bitmap(spans, "key", spans.count()))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
    kind = "doc_id long, n_words long, n_removed long, text string"

    def whole(batch: pa.RecordBatch) -> dict | None:
        batch = batch.filter(pa.array(~among(batch.column(2).to_numpy(), touched.value)))
        if not batch.num_rows:
            return None
        n, gone, text = zip(*[_kept((t or "").encode(), None, None) for t in batch.column(1).to_pylist()], strict=True)
        return {"doc_id": batch.column(0), "n_words": n, "n_removed": gone, "text": text}

    packed = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary()), ("size", pa.int64()), ("own", pa.int64()), ("key", pa.int64())])

    def rest(batch: pa.RecordBatch) -> dict | None:
        batch = batch.filter(pa.array(among(batch.column(2).to_numpy(), touched.value)))
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "packed": [pa.compress(t, "zstd", asbytes=True) for t in texts], "size": [len(t) for t in texts], "own": batch.column(3), "key": batch.column(2)} if texts else None

    def cut(batches):
        made, held = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                doc_id, data, size, begins, ends = (batch.column(k)[at].as_py() for k in range(5))
                n, gone, text = _kept(pa.decompress(data, size, "zstd", asbytes=True), begins, ends)
                made.append((doc_id, n, gone, text))
                held += len(text)
                if held >= 1 << 20 or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
                    made, held = [], 0

    clean = docs.mapInArrow(arrow_map(whole, schema), kind)
    # Texts go through the shuffle packed. The same join at every size: spans grow with the input.
    others = docs.mapInArrow(arrow_map(rest, packed), "doc_id long, packed binary, size long, own long, key long").join(spans.hint("merge"), ["own", "key"], "left").select("doc_id", "packed", "size", "begins", "ends")
    return clean.unionByName(others.mapInArrow(released(cut), kind))

