"""Vectorised hashing of words and word windows over Arrow string columns.

All sums and products are of unsigned 64-bit integers and wrap.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from corpusmill.shared import trim

U = np.uint64
#: Bytes of text handled together; a longer document is handled alone.
CHUNK = 1 << 20


def cache() -> dict:
    """What a Python worker keeps between tasks."""
    return sys.__dict__.setdefault("_corpusmill_cache", {})


def kept(key: object, make: Callable[[], object]) -> object:
    """One large thing that a worker keeps between tasks: another key takes its place."""
    if cache().get("kept", (None,))[0] != key:
        cache()["kept"] = None, None
        cache()["kept"] = key, make()
    return cache()["kept"][1]


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work``, a function for mapInArrow, after which the worker gives freed memory back.

    Workers live on between tasks and stages; what their allocators hold counts
    against the executor.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on every input bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    x = x ^ (x >> U(29))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n at least."""
    key = ("powers", base)
    got = cache().get(key)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        up, down = (np.full(size, b, U) for b in (base, inverse))
        up[0] = down[0] = 1
        got = np.cumprod(up), np.cumprod(down)
        if size <= 4 * CHUNK:
            cache()[key] = got
    return got


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, 9, 10, 11, 12, 13]] = True
    return table


def byte_values(lower: bool) -> np.ndarray:
    """A random value for each byte; with ``lower`` A-Z have those of a-z."""
    values = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    return values


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts and the last ends; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds ``most`` bytes of text or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(at, at[begin] + most, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def words(data: np.ndarray, at: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and where each row's words start among them."""
    inside = ~is_space[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = at[:-1][at[:-1] < at[1:]]
    before[edges] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[at[1:][at[:-1] < at[1:]] - 1] = False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(begin, at)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, wherever the word stands."""
    up, down = powers(0x5851F42D4C957F2D, len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U))


def window_hashes(hashes: np.ndarray, size: int, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """A hash of each run of ``size`` hashes, by where it starts; rows are not told apart."""
    if len(hashes) < size:
        return np.zeros(0, U)
    up, down = powers(base, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(hashes) - size + 1])


def arrow_map(work: Callable[[pa.RecordBatch], dict[str, object] | None], schema: pa.Schema, text: str = "text"):
    """A function for mapInArrow that applies ``work`` to chunks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text):
            out = work(chunk)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return released(run)
