"""Packing: shortest-pack-first over the length histogram.

Each document becomes its token ids and an end id, cut into pieces of at most ``size`` ids. The
histogram of piece lengths (at most ``size`` bins) is packed on the driver: lengths are placed
longest first, each into the shortest open packs it fits, as counts of packing patterns. Pieces
then find their place by their rank among the pieces of their length. A rank is the number of
pieces in earlier salts plus the row number in the own salt, so a length that a third of all pieces
share is split.

Words between ASCII white space are encoded once and remembered: no pre-token spans white space,
so the ids of a text are those of its words one after another. Strings of special tokens in a text
are ordinary text.

Defined cases: a null or empty text is the end id alone; repeated rows are packed one by one;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scoreflow.llm.common import REMEMBERED, shared, stored, text_slices

SIZE = 4096
END = 2
#: Pieces of one length and salt that one window sorts, on average.
SALT_ROWS = 20_000
#: Special token that separates words while they are encoded; words that hold its start are encoded alone.
BETWEEN = "<|endoftext|>"
#: Byte-level symbols: printable Latin-1 characters stand for themselves, the others for those from U+0100 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
SYMBOLS = {b: 256 + i for i, b in enumerate(_HIDDEN) if b != 32}
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text that a task holds as words at once.
SLICE = 2 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECES}, sequence_id long, offset long"


class WordIds:
    """Little-endian 32-bit ids of whole texts, put together from remembered words.

    Of a word whose end is a digit or letter and then ASCII marks, the two parts are encoded apart: a pre-token
    never spans them. New parts of lower-case letters in composed form are pre-tokens as they are: all of a slice go to the
    model in one call, and the ids that end a word part them. Other new parts take the tokenizer's whole way, with a special
    token between them. Texts without combining marks are lower-cased first, as the tokenizer does itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(BETWEEN)
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, parts: list[bytes]) -> None:
        plain, other, single = [], [], []
        for part in parts:
            if part.isalpha() and part.islower() or self.is_plain(part):
                plain.append(part)
            else:
                (single if b"<|" in part else other).append(part)
        text = b" ".join(plain).decode("latin-1").translate(SYMBOLS)
        ids = self.ids(self.model, text)
        self.keep(plain, ids, np.flatnonzero(self.ends[ids]) + 1, 0)
        self.tokenizer.encode_special_tokens = False
        ids = self.ids(self.tokenizer, BETWEEN.join(p.decode() for p in other))
        self.keep(other, ids, np.append(np.flatnonzero(ids == self.mark), len(ids)), 1)
        self.tokenizer.encode_special_tokens = True
        for part in single:
            self.parts[part] = self.ids(self.tokenizer, part.decode()).tobytes()

    @staticmethod
    def ids(tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def is_plain(part: bytes) -> bool:
        text = part.decode()
        return text.isalpha() and max(text) < "\u0590" and text == text.lower() and unicodedata.is_normalized("NFC", text)

    def keep(self, parts: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        blob, at = ids.tobytes(), 0
        for part, end in zip(parts, (4 * ends).tolist()):
            self.parts[part] = blob[at:end]
            at = end + 4 * gap

    def learn(self, words: set[bytes]) -> None:
        if len(self.words) > REMEMBERED:
            self.old, self.words, self.parts = self.words, {}, {}
        split, old = [], self.old.get
        for word in words - self.words.keys():
            if (found := old(word)) is not None:
                self.words[word] = found
            elif (core := word.rstrip(MARKS)) != word and core and (core[-1:].isalnum() or self.is_plain(core)):
                split.append((word, core, word[len(core) :]))
            else:
                split.append((word, word, b""))
        self.encode(list(({s[1] for s in split} | {s[2] for s in split if s[2]}) - self.parts.keys()))
        self.parts[b""] = b""
        for word, core, tail in split:
            self.words[word] = self.parts[core] + self.parts[tail]

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        words = []
        for text in texts:
            text = text or b""
            words.append((text if b"\xcc" in text or b"\xcd" in text else text.lower()).split())
        self.learn(set().union(*words))
        return [b"".join(map(self.words.__getitem__, own)) for own in words]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of each document: start, length, checksum of the ids, tokens of the document."""

    def cut(batches):
        ids_of, last = WordIds(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for lo, hi, texts in text_slices(batch, SLICE):
                rows = []
                for key, ids in zip(keys[lo:hi], ids_of(texts)):
                    ids += last
                    total = len(ids) // 4
                    for at in range(0, total, size):
                        part = ids[4 * at : 4 * (at + size)]
                        rows.append((key, at, len(part) // 4, zlib.crc32(part), total))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def packing_patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packs: each length goes to the packs with the most room left."""
    room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
    for length in sorted(histogram, reverse=True):
        left, grown, gap = histogram[length], [], size
        while left and gap >= length:
            if not room[gap]:
                gap -= 1
                continue
            count, lengths = room[gap].pop()
            used = min(count, left)
            if used < count:
                room[gap].append((count - used, lengths))
            left -= used
            rest = gap - length
            # A pack with room for this length again is met again further down.
            (room[rest] if rest >= length else grown).append((used, (*lengths, length)))
        times = size // length
        for count, copies in ((left // times, times), (min(left % times, 1), left % times)):
            if count:  # new packs hold this length as often as it fits
                grown.append((count, (length,) * copies))
        for pack in grown:
            room[size - sum(pack[1])].append(pack)
    return sorted((p for packs in room for p in packs), key=lambda p: (p[1], p[0]), reverse=True)


class Places:
    """Where the pieces of each length go, by rank: at most one range for each pattern and length."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]):
        taken: dict[int, int] = defaultdict(int)
        rows, sequences = [], 0
        for count, lengths in patterns:
            offset = 0
            for length in dict.fromkeys(lengths):
                times = lengths.count(length)
                rows.append((length, taken[length], times, sequences, offset))
                taken[length] += count * times
                offset += times * length
            sequences += count
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.low, self.times, self.sequence, self.offset = table.T.copy()
        self.first = np.searchsorted(self.length, np.arange(int(self.length.max(initial=0)) + 2))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.empty(len(rank), np.int64)
        for value in np.unique(length):
            own = length == value
            lo, hi = self.first[value], self.first[value + 1]
            row[own] = lo + np.searchsorted(self.low[lo:hi], rank[own], side="right") - 1
        within = rank - self.low[row]
        times = self.times[row]
        return self.sequence[row] + within // times, self.offset[row] + within % times * length


def packed(found: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces with their sequence and offset."""
    counts = found.groupBy("length").count().collect()  # at most ``size`` rows
    histogram = {r["length"]: r["count"] for r in counts}
    places = shared(found.sparkSession, Places(packing_patterns(histogram, size)))
    salts = max(8, max(histogram.values(), default=0) // SALT_ROWS)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = salted.groupBy("length", "salt").count().select(
        "length", "salt",
        (F.sum("count").over(W.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"),
    )
    order = W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("row", F.row_number().over(order)).join(before, ["length", "salt"])

    def place(batches):
        place_of = places()
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset = place_of(length, batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("row") - 1).alias("rank")
    ).mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of all documents with sequence and offset; the pieces are stored once in between."""
    return packed(stored(pieces(docs, tokenizer, size, end)), size)
