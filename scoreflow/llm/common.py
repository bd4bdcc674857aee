"""Helpers shared by the operators: words, rolling hashes, bounded batches, stored tables."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: Bytes of text that a task holds as words at once; one longer text is held whole.
SLICE_BYTES = 4 << 20
#: Words whose hash or ids a task remembers; the older half is forgotten beyond that.
REMEMBERED = 250_000
#: The same for hashes, which cost little to compute again.
HASHED_WORDS = 60_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
LOCAL_FOLDERS: list[tempfile.TemporaryDirectory] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """New folder in ``spark.checkpoint.dir``; a local one only for a local master without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    LOCAL_FOLDERS.append(tempfile.TemporaryDirectory(prefix="llm-"))
    return f"{LOCAL_FOLDERS[-1].name}/t"


def stored(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: later steps survive lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value) -> Callable:
    """Broadcast a value of bounded size; the result returns it in a task, whatever executors can import."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


class Generations(dict):
    """Cache of bounded size: when full, its entries become the old ones and those before are dropped."""

    def __init__(self, make: Callable, limit: int = REMEMBERED):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def word_hashes() -> Generations:
    """64-bit hash of each word (bytes)."""
    return Generations(xxhash.xxh3_64_intdigest, HASHED_WORDS)


def hashed(words: list[bytes], cache: Generations) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of each ``k`` consecutive word hashes, by doubling of the width."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    h, width = words, 1
    for bit in bin(k)[3:]:
        h = h[: len(h) - width] * base ** np.uint64(width) + h[width:]
        width *= 2
        if bit == "1":
            h = h[:-1] * base + words[width:]
            width += 1
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(texts: list[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text, one row at least."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def text_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Ranges of rows of about ``limit`` bytes of text with their texts; only one range is copied at a time."""
    pa.default_memory_pool().release_unused()
    column = batch.column("text").cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if len(sizes) > start:
        yield start, len(sizes), column.slice(start).to_pylist()


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: what bucket and partition counts are derived from."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
