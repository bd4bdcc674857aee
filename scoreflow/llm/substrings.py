"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

Words are runs of bytes other than space and 0x09-0x0D, unchanged. A word is removed if a window
that covers it has a word sequence that also starts earlier: in a document of smaller id, or
earlier in the same one. Windows are judged on the input.

1. Each task hashes every window (64 bits modulo 2**64) and, of windows that repeat within a slice
   of its texts, sends only the first; the others are known to be repeats. So a window in a third of
   all documents costs one entry for each slice, not for each document.
2. A window belongs to the bucket that the least hash of its sub-windows of ``SUB`` words names:
   neighbours mostly share it, so ids and positions are written once for a run. Buckets grow in
   number with the input, so each holds a bounded number of entries. There, all entries of a hash
   but the earliest are repeats. The bucket number comes from another hash, so a false
   repeat takes two words sequences that agree in 64 bits and in the bucket.
3. Repeats go back as runs of starts, grouped by document id, and merge into maximal intervals.

Texts, window entries and repeats are packed into binary rows of many documents each.

Defined cases: a null or empty text has no words; rows that share a doc_id count as one document
that starts at the same place (none is earlier), and removals found in one apply to the words of
all at that place; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.llm.common import hashed, mixed, power_of_two, rolling, slices, text_bytes, texts_of, word_hashes

WIDTH = 20
SUB = 8
#: Bytes of text for each bucket of window hashes, and for each group of documents.
BUCKET_BYTES = 4 << 20
GROUP_BYTES = 2 << 20
SLICE = 8 << 20
OTHER = np.uint64(0xC2B2AE3D27D4EB4F | 5)
RUNS = np.dtype([("doc", "<i8"), ("start", "<u4"), ("n", "<u4")])


def _runs(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Runs of consecutive starts of one document, in the order given."""
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(first)
    runs = np.empty(len(at), RUNS)
    runs["doc"], runs["start"], runs["n"] = doc[at], start[at], np.diff(np.append(at, len(doc)))
    return runs


def _spread(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of each window of the runs."""
    n = runs["n"].astype(np.int64)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(runs["doc"], n), np.repeat(runs["start"].astype(np.int64), n) + within


def _least(h: np.ndarray, k: int) -> np.ndarray:
    """Least of each ``k`` consecutive values."""
    done = 1
    while done < k:
        step = min(done, k - done)
        h = np.minimum(h[: len(h) - step], h[step:])
        done += step
    return h


def _grouped(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the rows that hold it, in their order."""
    order = np.argsort(key, kind="stable")
    bounds = np.flatnonzero(np.diff(key[order])) + 1
    for rows in np.split(order, bounds):
        if len(rows):
            yield int(key[rows[0]]), rows


def _group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _packed_runs(doc: np.ndarray, start: np.ndarray, groups: int, squeeze) -> Iterator[tuple[int, bytes]]:
    """Repeats as compressed runs, one row for each document group."""
    runs = _runs(doc, start)
    for group, rows in _grouped(_group_of(runs["doc"], groups)):
        yield group, squeeze.compress(runs[rows].tobytes())


def _record(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _entries(docs: DataFrame, width: int, buckets: int, groups: int) -> DataFrame:
    """Rows (bucket, runs, hashes) of first windows; bucket -1 - group holds known repeats."""
    sub = min(SUB, width)

    def emit(batches):
        cache, squeeze = word_hashes(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), texts_of(batch)
            for lo, hi in slices(texts, SLICE):
                order = lo + np.argsort(ids[lo:hi], kind="stable")
                docs_w = [hashed((texts[i] or b"").split(), cache) for i in order]
                lengths = np.array([len(w) for w in docs_w])
                words = np.concatenate(docs_w)
                if len(words) < width:
                    continue
                hashes = rolling(words, width)
                bucket = _least(mixed(rolling(words, sub, OTHER)), width - sub + 1) >> np.uint64(16)
                n_windows = np.maximum(lengths - width + 1, 0)
                begin = np.repeat(np.cumsum(lengths) - lengths, n_windows)
                start = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
                doc = np.repeat(ids[order].astype(np.int64), n_windows)
                hashes, bucket = hashes[begin + start], (bucket[begin + start] % np.uint64(buckets)).astype(np.int64)
                again = _repeats(hashes, doc, start)
                rows = [(-1 - g, blob, None) for g, blob in _packed_runs(doc[again], start[again], groups, squeeze)]
                kept = np.flatnonzero(~again)
                for b, at in _grouped(bucket[kept]):
                    at = kept[at]
                    runs = squeeze.compress(_runs(doc[at], start[at]).tobytes())
                    rows.append((b, runs, hashes[at].tobytes()))
                yield _record(rows, ["bucket", "runs", "hashes"], [pa.int64(), pa.binary(), pa.binary()])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "text").mapInArrow(
        emit, "bucket long, runs binary, hashes binary"
    )


def _repeats(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True where the same hash stands at a smaller (doc, start)."""
    order = np.lexsort((start, doc, hashes))
    h, d, s = hashes[order], doc[order], start[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.empty(len(h), bool)
    out[order] = (d > d[first]) | (s > s[first])
    return out


def repeated_windows(docs: DataFrame, width: int = WIDTH, size: int | None = None) -> DataFrame:
    """Rows (doc_group, runs): starts of windows whose word sequence also starts earlier."""
    size = text_bytes(docs) if size is None else size
    buckets, groups = power_of_two(size / BUCKET_BYTES), power_of_two(size / GROUP_BYTES)

    def judge(table: pa.Table) -> pa.Table:
        names, kinds = ["doc_group", "runs"], [pa.int64(), pa.binary()]
        squeeze, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        key, blobs = table.column("bucket")[0].as_py(), table.column("runs").to_pylist()
        if key < 0:
            return pa.Table.from_batches([_record([(-1 - key, b) for b in blobs], names, kinds)])
        runs = np.concatenate([np.frombuffer(open_.decompress(b), RUNS) for b in blobs])
        hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
        doc, start = _spread(runs)
        again = _repeats(hashes, doc, start)
        doc, start = doc[again], start[again]
        order = np.lexsort((start, doc))
        rows = list(_packed_runs(doc[order], start[order], groups, squeeze))
        return pa.Table.from_batches([_record(rows, names, kinds)])

    found = _entries(docs, width, buckets, groups)
    return found.groupBy("bucket").applyInArrow(judge, "doc_group long, runs binary")


def removal_intervals(starts: np.ndarray, counts: np.ndarray, width: int, n_words: int) -> list[tuple[int, int]]:
    """Maximal intervals [first, end) of words covered by runs of repeated windows."""
    out: list[list[int]] = []
    order = np.argsort(starts, kind="stable")
    for a, n in zip(starts[order].tolist(), counts[order].tolist()):
        end = min(a + n - 1 + width, n_words)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        elif a < end:
            out.append([a, end])
    return [(a, b) for a, b in out]


def _texts(docs: DataFrame, groups: int) -> DataFrame:
    """Rows (doc_group, ids, sizes, text): compressed texts of the documents of a group within a slice."""

    def emit(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), texts_of(batch)
            rows = []
            for group, at in _grouped(_group_of(ids, groups)):
                own = [texts[i] or b"" for i in at]
                sizes = np.array([len(t) for t in own], "<i8").tobytes()
                rows.append((group, ids[at].tobytes(), sizes, squeeze.compress(b"".join(own))))
            yield _record(rows, ["doc_group", "ids", "sizes", "text"], kinds)

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "text").mapInArrow(
        emit, "doc_group long, ids binary, sizes binary, text binary"
    )


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, removal intervals [first, end), kept text and its digest."""
    size = text_bytes(docs)
    groups = power_of_two(size / GROUP_BYTES)

    def finish(key, texts: pa.Table, marks: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        blobs = marks.column("runs").to_pylist()
        runs = np.concatenate([np.frombuffer(open_.decompress(b), RUNS) for b in blobs] or [np.zeros(0, RUNS)])
        runs = runs[np.argsort(runs["doc"], kind="stable")]
        rows = []
        for ids, sizes, blob in zip(*(texts.column(c).to_pylist() for c in ("ids", "sizes", "text"))):
            text, at = open_.decompress(blob), 0
            for doc, n in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(sizes, "<i8").tolist()):
                words = text[at : at + n].split()
                at += n
                lo, hi = np.searchsorted(runs["doc"], [doc, doc + 1])
                cut = removal_intervals(runs["start"][lo:hi].astype(np.int64), runs["n"][lo:hi], width, len(words))
                kept, last = [], 0
                for a, b in cut:
                    kept += words[last:a]
                    last = b
                kept = b" ".join(kept + words[last:])
                spans = [{"first": a, "end": b} for a, b in cut]
                removed = sum(b - a for a, b in cut)
                rows.append((doc, len(words), removed, spans, kept, hashlib.sha256(kept).hexdigest()))
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        names = ["doc_id", "n_words", "n_removed", "removed", "kept_text", "kept_sha256"]
        columns = list(zip(*rows)) or [[] for _ in names]
        kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays[4] = arrays[4].cast(pa.string())
        return pa.Table.from_arrays(arrays, names)

    marks = repeated_windows(docs, width, size).groupBy("doc_group")
    return _texts(docs, groups).groupBy("doc_group").cogroup(marks).applyInArrow(
        finish,
        "doc_id long, n_words long, n_removed long, removed array<struct<first:long,end:long>>, "
        "kept_text string, kept_sha256 string",
    )
