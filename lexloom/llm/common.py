"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.shared import discard, shared_dir, shared_table, spread  # noqa: F401

U64 = np.uint64
#: LUT of the ASCII white space that separates words: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U64(0x9E3779B97F4A7C15)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores more as keep it apart from the columns of df (upper and lower case are one)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def carry(spark: SparkSession, obj):
    """A function that gives obj on executors, which need not have this package: classes travel by value."""
    sent, memo = spark.sparkContext.broadcast(cloudpickle.dumps(obj)), {}

    def get():
        if not memo:
            memo[0] = pickle.loads(sent.value)
        return memo[0]

    return get


def remembered(what: str) -> dict:
    """A dictionary that a Python worker, which serves many tasks, keeps from one to the next."""
    place = sys.modules.setdefault("_lexloom_worker", types.ModuleType("_lexloom_worker"))
    return place.__dict__.setdefault(what, {})


def slices(batches, rows: int = 1024):
    """The batches in smaller ones: what is made of their rows in Python objects stays small. At the end, what has been freed goes back to
    the system, as the worker may idle from there on."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        release()


def release() -> None:
    """Gives memory that Python, Arrow and C have freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Frees what the worker has kept for other operators."""
    sys.modules.pop("_lexloom_worker", None)


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column's UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def runs(texts: list[bytes], size: int = 1 << 20):
    """Slices of the list of about `size` bytes: what works on whole arrays of bytes takes some forty times their memory."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all white-space separated words of the texts, and the number of words of each text.

    Word equality is equality of bytes, after lower-casing A-Z if asked.
    """
    found = [_word_hashes(part, lower) for part in runs(texts)]
    return (np.concatenate([x[i] for x in found]) for i in (0, 1)) if found else (np.zeros(0, U64), np.zeros(0, np.int64))


def _word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8) if texts else np.zeros(0, np.uint8)
    if lower:
        buf = LOWER[buf]
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(texts), np.int64)
    longest = int((ends - starts).max())
    powers = np.empty(longest, dtype=U64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        done = 1
        while done < longest:
            step = min(done, longest - done)
            powers[done : done + step] = powers[:step] * (powers[done - 1] * BASE)
            done += step
        inside = np.flatnonzero(~gap)
        lengths = ends - starts
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        offset = np.arange(len(inside), dtype=np.int64) - np.repeat(first, lengths)
        sums = np.add.reduceat((buf[inside].astype(U64) + U64(1)) * powers[offset], first)
        hashes = mix64(sums + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return hashes, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hashes of the k-word windows of one text's word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * U64(0x100000001B3) + words[i : i + n])
    return out
