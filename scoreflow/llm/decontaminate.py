"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scanned over training texts.

Words are maximal runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters. A
window is ``n`` consecutive words of a benchmark item; an item of fewer words, but not none, is one
window. A document word inside an occurrence of a window is hit.

The n-gram set is broadcast while the benchmark has at most ``limit`` windows; beyond that a bitmap of fixed
size (16 MB) of their hashes is, and only the text windows that it lets pass are shuffled, to a join on their words.
Both ways compare words, not hashes, and give the same result.

Defined cases: a null or empty text has no words and no hits; an item without words is ignored, one without an id
has the empty id;
items that share a window all count; repeated rows are judged one by one; empty tables give empty
or clean results; other columns are not read, and ``decontaminate`` keeps them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.llm.common import ALNUM, hashed, mixed, rolling, shared, slices, stored, text_slices, texts_of, word_hashes

#: Benchmark windows that are broadcast at most (about 200 bytes each).
BROADCAST_WINDOWS = 200_000
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FILTER_BITS = 20
BITMAP_BITS = 27
HITS = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


class NgramSet:
    """Windows by their words, with the hashes that find them by length."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        found: dict[bytes, set[str]] = defaultdict(set)
        lengths: dict[int, set[bytes]] = defaultdict(set)
        for item, text in items:
            words = text.translate(ALNUM).split()
            width = min(n, len(words))
            for i in range(len(words) - width + 1 if width else 0):
                key = b" ".join(words[i : i + width])
                found[key].add(item)
                lengths[width].add(key)
        self.items = {k: sorted(v) for k, v in found.items()}
        self.hashes, self.seen = {}, {}
        for width, keys in lengths.items():
            cache = word_hashes()
            own = np.unique(np.concatenate([mixed(rolling(hashed(k.split(), cache), width)) for k in sorted(keys)]))
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[own >> np.uint64(64 - FILTER_BITS)] = True
            self.hashes[width], self.seen[width] = own, bits

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, length) where a hash is that of a window."""
        for width, own in self.hashes.items():
            h = mixed(rolling(words, width))
            at = np.flatnonzero(self.seen[width][h >> np.uint64(64 - FILTER_BITS)])
            if len(at):
                place = np.minimum(np.searchsorted(own, h[at]), len(own) - 1)
                for i in at[own[place] == h[at]].tolist():
                    yield i, width


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of hit words from (first word, length)."""
    runs: list[list[int]] = []
    for first, width in sorted(places):
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], first + width - 1)
        else:
            runs.append([first, first + width - 1])
    return [(a, b) for a, b in runs]


def scanned(grams: NgramSet, texts: list[bytes | None], cache) -> Iterator[tuple[int, list, list]]:
    """Of each text: number of words, runs of hit words, items hit."""
    for lo, hi in slices(texts):
        words = [(t or b"").translate(ALNUM).split() for t in texts[lo:hi]]
        flat = [w for x in words for w in x]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in words])])
        places, items = defaultdict(list), defaultdict(set)
        for i, width in grams.candidates(hashed(flat, cache)):
            d = int(np.searchsorted(starts, i, side="right")) - 1
            if i + width <= starts[d + 1] and (hit := grams.items.get(b" ".join(flat[i : i + width]))):
                places[d].append((i - int(starts[d]), width))
                items[d].update(hit)
        for d, x in enumerate(words):
            yield len(x), merged(places[d]) if d in places else [], sorted(items[d]) if d in items else []


def _bench(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")


def _windows_at_most(benchmark: DataFrame) -> int:
    """Upper bound of the number of windows: one for every two bytes."""
    return benchmark.agg(F.sum(F.expr("octet_length(text) div 2 + 1"))).first()[0] or 0


def gram_set(benchmark: DataFrame, n: int = 10) -> NgramSet:
    return NgramSet([(r.item, r.text.encode()) for r in _bench(benchmark).collect()], n)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, spans of hit words (first, last), items with occurring windows."""
    if _windows_at_most(benchmark) > limit:
        return _joined(docs, benchmark, n)
    grams = shared(docs.sparkSession, gram_set(benchmark, n))

    def scan(batches):
        own, cache = grams(), word_hashes()
        for batch in batches:
            found = list(scanned(own, texts_of(batch), cache))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[{"first": a, "last": b} for a, b in f[1]] for f in found],
                             pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array([f[2] for f in found], pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "spans", "items"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, HITS)


def _item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(words, width, place, item) of every window of the items; ``place``: that of its hash in the bitmap, from 1."""

    def emit(batches):
        cache = word_hashes()
        for batch in batches:
            items = batch.column("item")
            for lo, hi, texts in text_slices(batch):
                for i, text in zip(range(lo, hi), texts):
                    words = text.translate(ALNUM).split()
                    width = min(n, len(words))
                    if not width:
                        continue
                    at = mixed(rolling(hashed(words, cache), width)) >> np.uint64(64 - BITMAP_BITS)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b" ".join(words[j : j + width]) for j in range(len(at))], pa.binary()),
                         pa.array(np.full(len(at), width)), pa.array(at.astype(np.int64) + 1),
                         items.take(pa.array(np.full(len(at), i)))],
                        ["words", "width", "place", "item"],
                    )

    return _bench(benchmark).mapInArrow(emit, "words binary, width long, place long, item string")


def _bitmap(own: DataFrame) -> bytes:
    """Bitmap of the windows' hashes: at most 2 ** BITMAP_BITS / 32768 blocks of 4 KB."""
    blocks = own.groupBy(F.bitmap_bucket_number("place").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in blocks.collect():
        out[(r.block - 1) * 4096 : r.block * 4096] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _candidates(rows: DataFrame, widths: list[int], bitmap: bytes) -> DataFrame:
    """(key, first, width, words) of the text windows whose hash is in the bitmap."""
    sent = shared(rows.sparkSession, bitmap)

    def emit(batches):
        bits, cache = np.frombuffer(sent(), np.uint8), word_hashes()
        for batch in batches:
            keys = batch.column("key")
            for lo, _, texts in text_slices(batch):
                words = [(t or b"").translate(ALNUM).split() for t in texts]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in words])])
                flat = [w for x in words for w in x]
                hashes = hashed(flat, cache)
                for width in widths:
                    place = mixed(rolling(hashes, width)) >> np.uint64(64 - BITMAP_BITS)
                    seen = bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
                    at = np.flatnonzero(seen)
                    row = np.searchsorted(starts, at, side="right") - 1
                    whole = at + width <= starts[row + 1]
                    at, row = at[whole], row[whole]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(pa.array(lo + row)), pa.array(at - starts[row]), pa.array(np.full(len(at), width)),
                             pa.array([b" ".join(flat[i : i + width]) for i in at.tolist()], pa.binary())],
                            ["key", "first", "width", "words"],
                        )

    return rows.select("key", "text").mapInArrow(emit, "key string, first long, width long, words binary")


def _row_key() -> Column:
    """Rows of one id and text share their hits."""
    doc = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    return F.concat_ws(":", doc, F.xxhash64("text").cast("string"))


def _hits(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """(key, places, items) of the rows that are hit: candidates of a bitmap, verified by a join on the words."""
    rows = docs.select(_row_key().alias("key"), "text")
    own = stored(_item_windows(benchmark, n))
    # At most ``n`` widths.
    widths = sorted(r.width for r in own.select("width").distinct().collect())
    windows = stored(own.groupBy("words").agg(F.collect_set("item").alias("own")))
    hits = _candidates(rows, widths, _bitmap(own)).join(windows, "words")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("own"))))
    return hits.groupBy("key").agg(F.collect_set(F.struct("first", "width")).alias("places"), items.alias("items"))


def _joined(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The same by a shuffle join, for a benchmark too large to broadcast."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", _row_key())
    hits = _hits(docs, benchmark, n)

    def finish(batches):
        for batch in batches:
            texts = texts_of(batch)
            places = [[(p["first"], p["width"]) for p in x or []] for x in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len((t or b"").translate(ALNUM).split()) for t in texts], pa.int64()),
                    pa.array([[{"first": a, "last": b} for a, b in merged(x)] for x in places],
                             pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array([x or [] for x in batch.column("items").to_pylist()], pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "spans", "items"],
            )

    return rows.join(hits, "key", "left").select("doc_id", "text", "places", "items").mapInArrow(finish, HITS)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its hit runs, from the first byte of a run's first word to the last of its last."""
    bounds = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : bounds[first][0]])
        at = bounds[last][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, whole: float = 0.5) -> DataFrame:
    """Documents without their hit spans; one with a share of hit words of ``whole`` or more is dropped.

    All columns stay; ``n_chars``, where it is a column, is counted anew for changed texts. Hits and
    share are those of the input text, also for a benchmark too large to broadcast.
    """
    if _windows_at_most(benchmark) > BROADCAST_WINDOWS:
        hits = _hits(docs, benchmark, n).select(F.col("key").alias("_key"), F.col("places").alias("_places"))
        rows = docs.withColumn("_key", _row_key()).join(hits, "_key", "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_places")

        columns = docs.columns

        def clean(batches):
            for batch in batches:
                texts = texts_of(batch)
                places = [[(p["first"], p["width"]) for p in x or []] for x in batch.column("_places").to_pylist()]
                found = [(len((t or b"").translate(ALNUM).split()) if x else 0, merged(x)) for t, x in zip(texts, places)]
                yield _cut(batch.select(columns), texts, found, whole)

        return rows.mapInArrow(clean, docs.schema)
    grams = shared(docs.sparkSession, gram_set(benchmark, n))

    def scan(batches):
        own, cache = grams(), word_hashes()
        for batch in batches:
            texts = texts_of(batch)
            yield _cut(batch, texts, [f[:2] for f in scanned(own, texts, cache)], whole)

    return docs.mapInArrow(scan, docs.schema)


def _cut(batch: pa.RecordBatch, texts: list[bytes | None], found: list[tuple[int, list]], whole: float) -> pa.RecordBatch:
    """The rows of a batch after the runs in ``found`` (number of words, runs) are cut, without those that are mostly hit."""
    keep = []
    counts = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
    for i, (n_words, spans) in enumerate(found):
        if spans and sum(b - a + 1 for a, b in spans) >= whole * n_words:
            continue
        keep.append(i)
        if spans:
            texts[i] = without_spans(texts[i], spans)
            if counts:
                counts[i] = len(texts[i].decode())
    new = {"text": pa.array(texts, pa.binary()).cast(pa.string())}
    if counts is not None:
        new["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
    columns = [new.get(c, batch.column(c)) for c in batch.schema.names]
    return pa.RecordBatch.from_arrays(columns, batch.schema.names).take(pa.array(keep, pa.int64()))
