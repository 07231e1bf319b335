"""Toxicity by a convolutional text classifier in numpy.

A word is three table rows, found by two hashes of its letters and one of its
first four bytes; their sum is its embedding. Filters over one, two and three
words are followed by the maximum over the whole text and a linear layer. A word
that training saw in few documents keeps the zero embedding. The threshold of each language, told from
the text's own function words, is calibrated on training rows and subtracted
before the logistic function, so that 0.5 divides the classes everywhere.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.llm.kernels import arrow_map, byte_values, cache, chunks, kept, released, text_bytes, word_hashes, words
from corpusmill.shared import dropped, give_back, small_batches, written

U = np.uint64
BITS = 16
DIM = 8
#: Hashes of a word, and the bytes that the last of them takes.
N_HASHES, STEM = 3, 4
WIDTHS = (1, 2, 3)
PER_WIDTH = 8
#: Labelled rows of each class that training takes at most, and their words.
MAX_ROWS, MAX_WORDS = 3000, 4_000_000
#: Documents that must hold a word before training gives it an embedding.
MIN_DOCS = 5
EPOCHS = 4
#: Bytes of text scored together: each word takes a row of responses.
SCORED = 512 << 10
# Common function words that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to is that with for",
    "de": "der die und das ist nicht ein mit",
    "fr": "le les des et que une dans pour",
    "es": "el los y por una con del se",
}
LANGS = (*FUNCTION_WORDS, "other")


def _separators() -> np.ndarray:
    """Every ASCII byte but letters ends a word."""
    table = np.zeros(256, bool)
    table[:128] = True
    table[65:91] = table[97:123] = False
    return table


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For the words of all rows, A-Z in lower case, BITS bits of each of their hashes, and where each row's start."""
    data, at = text_bytes(column)
    begin, end, rows = words(data, at, _separators())
    values, mask = byte_values(True), U((1 << BITS) - 1)
    whole = word_hashes(data, begin, end, values)
    stem = word_hashes(data, begin, np.minimum(end, begin + STEM), values)
    return whole & mask | (whole >> U(BITS) & mask) << U(BITS) | (stem & mask) << U(2 * BITS), rows


def language(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The index in LANGS of each row's language."""
    known = cache().get("function words")
    if known is None:
        listed = [(w, i) for i, s in enumerate(FUNCTION_WORDS.values()) for w in s.split()]
        ids = word_ids(pa.array([w for w, _ in listed]))[0]
        order = np.argsort(ids)
        known = cache()["function words"] = ids[order], np.array([i for _, i in listed])[order]
    at = np.minimum(np.searchsorted(known[0], hashes), len(known[0]) - 1)
    hit = np.flatnonzero(known[0][at] == hashes)
    doc = np.searchsorted(rows, hit, "right") - 1
    counts = np.zeros((len(rows) - 1, len(LANGS)), np.int64)
    np.add.at(counts, (doc, known[1][at[hit]]), 1)
    return np.where(counts.sum(1) > 0, counts.argmax(1), len(LANGS) - 1)


def _buckets(ids: np.ndarray) -> list[np.ndarray]:
    return [(ids >> U(k * BITS) & U((1 << BITS) - 1)).astype(np.int64) for k in range(N_HASHES)]


def _padded(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word, with two words of zeros behind each row, and where rows start."""
    n = len(rows) - 1
    out = np.full((N_HASHES, len(ids) + 2 * n), 1 << BITS, np.int64)
    out[:, np.arange(len(ids)) + 2 * np.repeat(np.arange(n), np.diff(rows))] = _buckets(ids)
    return out, rows[:-1] + 2 * np.arange(n)


@dataclass
class Model:
    """embed: a table for each hash; conv: by width, (width, DIM, PER_WIDTH); cut: by language."""

    embed: np.ndarray
    conv: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    cut: np.ndarray
    mark: str = field(default_factory=lambda: uuid.uuid4().hex)

    def table(self) -> np.ndarray:
        """For each hash, each bucket's part in each filter at each of its places."""
        filters = np.concatenate([c[j] for c in self.conv for j in range(len(c))], axis=1)
        return (self.embed @ filters).astype(np.float32)

    def pooled(self, table: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each row."""
        own, start = _padded(hashes, rows)
        part = table[0][own[0]]
        for k in range(1, N_HASHES):
            part += table[k][own[k]]
        best, at = [], 0
        for width in WIDTHS:
            total = part[:, at : at + PER_WIDTH].copy()
            for j in range(1, width):
                total[:-j] += part[j:, at + j * PER_WIDTH : at + (j + 1) * PER_WIDTH]
            at += width * PER_WIDTH
            best.append(np.maximum.reduceat(total, start, axis=0))
        return np.concatenate(best, axis=1)

    def logits(self, table: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if len(rows) < 2:
            return np.zeros(0)
        return np.maximum(self.pooled(table, hashes, rows) + self.bias, 0) @ self.out + self.out_bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _first_embeddings(ids: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Log odds of each bucket in the first place, small noise in the others, zeros for what is rare."""
    size = (1 << BITS) + 1
    embed = rng.normal(0, 0.1, (N_HASHES, size, DIM)).astype(np.float32)
    for k in range(N_HASHES):
        seen = np.zeros((2, size))
        for x, label in zip(ids, y, strict=True):
            seen[int(label), np.unique(_buckets(x)[k])] += 1
        share = (seen + 1) / (np.array([[np.sum(y == 0)], [np.sum(y == 1)]]) + 2)
        embed[k, :, 0] = np.clip(np.log(share[1] / share[0]), -3, 6) / N_HASHES
        embed[k, seen.sum(0) < MIN_DOCS] = 0
        embed[k, -1] = 0
    return embed


def fit(ids: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """A model of rows of word hashes and their labels; a fifth of them calibrates."""
    rng = np.random.default_rng(seed)
    n_filters = len(WIDTHS) * PER_WIDTH
    cut = np.zeros(len(LANGS))
    if len(set(y.tolist())) < 2:
        level = 4.0 if len(y) and y[0] == 1 else -4.0
        return Model(np.zeros((N_HASHES, (1 << BITS) + 1, DIM), np.float32), [np.zeros((w, DIM, PER_WIDTH), np.float32) for w in WIDTHS], np.zeros(n_filters), np.zeros(n_filters), level, cut)
    held = rng.random(len(y)) < 0.2
    train = np.flatnonzero(~held & (np.array([len(x) for x in ids]) > 0))
    if not len(train):
        held[:] = True
    embed = _first_embeddings([ids[i] for i in train], y[train], rng)
    conv = [rng.normal(0, 0.2, (w, DIM, PER_WIDTH)).astype(np.float32) for w in WIDTHS]
    for c in conv:
        c[:, 0, : PER_WIDTH // 2] = 1.0 / len(c)
    model = Model(embed, conv, np.full(n_filters, -2.5), np.full(n_filters, 0.2), -2.0, cut)
    usable = embed.any(axis=2)
    squares: dict[str, np.ndarray] = {"out": np.full(n_filters, 1e-2), "bias": np.full(n_filters, 1e-2), "b0": np.full(1, 1e-2)}
    conv_sq = [np.full(c.shape, 1e-2, np.float32) for c in conv]
    weight = np.where(y == 1, np.sum(y == 0) / max(1, np.sum(y == 1)), 1.0) ** 0.5
    for epoch in range(EPOCHS):
        rate = 0.05 / (1 + epoch)
        for i in rng.permutation(train):
            own, _ = _padded(ids[i], np.array([0, len(ids[i])]))
            x = sum(embed[k, own[k]] for k in range(N_HASHES))
            z, where = [], []
            for c in conv:
                w = len(c)
                full = np.concatenate([x[j : len(x) - w + 1 + j] for j in range(w)], axis=1) @ c.reshape(w * DIM, PER_WIDTH)
                k = full.argmax(0)
                where.append(k)
                z.append(full[k, np.arange(PER_WIDTH)])
            h = np.concatenate(z) + model.bias
            r = np.maximum(h, 0)
            g = float(_sigmoid(np.array(r @ model.out + model.out_bias)) - y[i]) * weight[i]
            g_r = g * model.out * (h > 0)
            for name, grad, value in (("out", g * r + 1e-5 * model.out, model.out), ("bias", g_r, model.bias)):
                squares[name] += grad**2
                value -= rate * grad / np.sqrt(squares[name])
            squares["b0"] += g * g
            model.out_bias -= float(rate * g / np.sqrt(squares["b0"][0]))
            for m, c in enumerate(conv):
                w, part = len(c), g_r[m * PER_WIDTH : (m + 1) * PER_WIDTH]
                for f in np.flatnonzero(part):
                    at = where[m][f] + np.arange(w)
                    grad = part[f] * x[at]
                    move = part[f] * c[:, :, f]
                    conv_sq[m][:, :, f] += grad**2
                    c[:, :, f] -= rate * grad / np.sqrt(conv_sq[m][:, :, f])
                    for k in range(N_HASHES):
                        row = own[k, at]
                        ok = usable[k, row]
                        embed[k, row[ok]] -= 0.01 * move[ok]
    _calibrate(model, [ids[i] for i in np.flatnonzero(held)], y[held])
    return model


def _calibrate(model: Model, ids: list[np.ndarray], y: np.ndarray) -> None:
    """The logit of each language above which most calibration rows are told apart right."""
    if not ids:
        return
    table, logits, langs = model.table(), [], []
    for k in range(0, len(ids), 32):  # a few texts at a time: each word takes a row of responses
        part = ids[k : k + 32]
        hashes, rows = np.concatenate(part), np.concatenate([[0], np.cumsum([len(x) for x in part])])
        logits.append(model.logits(table, hashes, rows))
        langs.append(language(hashes, rows))
    logits, langs = np.concatenate(logits), np.concatenate(langs)

    def best(z: np.ndarray, t: np.ndarray) -> float:
        order = np.argsort(z)
        z, t = z[order], t[order]
        wrong = np.concatenate([[np.sum(t == 0)], np.sum(t == 0) - np.cumsum(t == 0) + np.cumsum(t == 1)])
        edges = np.concatenate([[z[0] - 2], (z[:-1] + z[1:]) / 2, [z[-1] + 2]])
        least = np.flatnonzero(wrong == wrong.min())
        return float(edges[least[len(least) // 2]])

    whole = best(logits, y)
    for k in range(len(LANGS)):
        own = langs == k
        model.cut[k] = best(logits[own], y[own]) if min(np.sum(y[own] == 0), np.sum(y[own] == 1)) >= 20 else whole


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows of ``docs`` that are not held out.

    Of each class at most MAX_ROWS rows are taken, those whose doc_id has the
    smallest hash, and of these as many as hold MAX_WORDS words together.
    Labels that are null or without a document are left out.
    """
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.where(~held_out(F.col("doc_id"))).withColumn("draw", F.xxhash64("doc_id"))
    taken = own.where("toxic = 1").orderBy("draw", "doc_id").limit(MAX_ROWS).unionByName(own.where("toxic = 0").orderBy("draw", "doc_id").limit(MAX_ROWS))
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("draw", pa.int64()), ("n_words", pa.int64()), ("ids", pa.binary())])

    def hashed(batch: pa.RecordBatch) -> dict:
        ids, rows = word_ids(batch.column(3))
        return {"doc_id": batch.column(0), "toxic": batch.column(1), "draw": batch.column(2), "n_words": np.diff(rows), "ids": [ids[i:j].tobytes() for i, j in zip(rows[:-1], rows[1:], strict=True)]}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(taken), "doc_id").select("doc_id", "toxic", "draw", "text")
    whole = table = written(rows.mapInArrow(arrow_map(hashed, schema), "doc_id long, toxic int, draw long, n_words long, ids binary"), "labelled")
    sizes = table.select("draw", "doc_id", "n_words").orderBy("draw", "doc_id").limit(4 * MAX_ROWS).toArrow()
    fits = int(np.searchsorted(np.cumsum(sizes["n_words"].to_numpy()), MAX_WORDS, "right"))
    if 0 < fits < len(sizes):
        table = table.where(F.col("draw") <= sizes["draw"][fits - 1].as_py())
    got = table.orderBy("draw", "doc_id", "n_words").limit(4 * MAX_ROWS).toArrow()
    dropped(whole)
    model = fit([np.frombuffer(x, U) for x in got["ids"].to_pylist()], got["toxic"].to_numpy().astype(np.int64))
    del got
    give_back(spark)
    return model


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """``docs`` doc_id with held_out, score and predicted; with ``keep`` all rows of ``docs`` that pass.

    Null and empty texts are scored as texts without words. Rows that repeat
    get the same score. Only the text column is read for the score.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def scores(column: pa.Array) -> np.ndarray:
        m = shipped.value
        table = kept(("toxicity", m.mark), m.table)
        hashes, rows = word_ids(column)
        return _sigmoid(m.logits(table, hashes, rows) - m.cut[language_of(column)])

    if keep:
        fields = docs.schema
        schema = to_arrow_schema(fields)
        at = fields.fieldNames().index("text")

        def passing(batches):
            for chunk in chunks(batches, "text", SCORED):
                left = chunk.filter(pa.array(scores(chunk.column(at)) < 0.5))
                if left.num_rows:
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(left.columns, schema, strict=True)], schema=schema)

        return docs.mapInArrow(released(passing), fields)

    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def work(batches):
        for chunk in chunks(batches, "text", SCORED):
            yield pa.RecordBatch.from_arrays([chunk.column(0).cast(pa.int64()), pa.array(scores(chunk.column(1)))], schema=schema)

    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(work), "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def language_of(column: pa.Array) -> np.ndarray:
    hashes, rows = word_ids(column)
    return language(hashes, rows) if len(column) else np.zeros(0, np.int64)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    return score(docs, train(docs, labels))
