"""Phrase collocation mining: phrases counted in HAT-tries, scored by their weakest cut.

Texts are lower-cased in A-Z, split into pieces at ``.,;:!?`` and line ends, and those into words at
spaces and tabs. Counts are per language.

1. Each task counts the phrases of its slices in one trie for each language. Inner nodes branch on
   digits of task-local word ids; leaves are hash containers that burst into a node of smaller
   containers when full. Beyond ``ENTRIES`` entries whole subtrees, the largest first, are spilled as
   sorted runs of phrases and counts; the rest is spilled at the end. Runs are cut by prefix partition.
2. All runs of a prefix partition (the first two words) meet in one group and are merged. So the most frequent phrase costs one entry
   for each run, and partitions grow in number with the input.
3. The first pass counts words and pairs. The second counts triples whose two pairs are both frequent enough: a triple is
   no more frequent than its pairs. Tasks look pairs up in a bitmap of ``FILTER_BITS`` bits of all frequent pairs,
   so some others are counted too and drop out later; whatever the size, none is missed. Pairs that start over
   1 / ``HOT`` of all pairs have their triples partitioned by the third word too; there are fewer than ``HOT`` of them.
4. Scores are joins of the counts, in whole numbers of up to 38 digits: exact while a phrase has under
   10**15 places. The best of each language are found in two steps, in salted parts and then among their best.

Defined cases: a null text is empty, a null language is ``und``; repeated rows count each; phrases do not
cross pieces or documents; a language without candidates gives no rows; empty tables give no rows; other
columns are not read. One text is held whole; counts are exact (words are compared, not hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreflow.llm.common import BASE, mixed, power_of_two, shared, stored, text_bytes, text_slices

LEAST = 10
BEST = 2000
#: Entries of a task's tries, and words they may name, before subtrees are spilled.
ENTRIES = 750_000
WORDS = 750_000
#: Entries of a container before it bursts.
BURST = 1 << 14
#: Bytes of text for each prefix partition.
PART_BYTES = 8 << 20
FILTER_BITS = 27
HOT = 1000
SALTS = 64
#: Lower-cases A-Z, turns the ends of pieces into line ends and tabs into spaces.
PIECES = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A phrase of up to three word ids in one number; 0 stands for no word.
ID_BITS = 21
ID_MASK = (1 << ID_BITS) - 1
DIGIT_BITS = 7
TOP_SHIFT = 3 * ID_BITS - DIGIT_BITS


class Branch:
    """Inner node: children by one digit of the key."""

    __slots__ = ("kids", "shift", "size")

    def __init__(self, shift: int):
        self.kids, self.shift, self.size = {}, shift, 0


class HatTrie:
    """Counts of 63-bit keys: containers (dicts) under a trie over the keys' digits from the top."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root = burst, Branch(TOP_SHIFT)

    @property
    def size(self) -> int:
        return self.root.size

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct keys in ascending order."""
        if len(keys):
            self._into(self.root, keys, counts)

    def _into(self, node: Branch, keys: np.ndarray, counts: np.ndarray) -> int:
        """Returns how many keys are new below ``node``."""
        digits = (keys >> node.shift) & ((1 << DIGIT_BITS) - 1)
        cuts = np.append(np.flatnonzero(np.diff(digits, prepend=-1)), len(keys)).tolist()
        before = node.size
        for lo, hi in zip(cuts, cuts[1:]):
            digit = int(digits[lo])
            kid = node.kids.get(digit)
            if kid is None:
                kid = node.kids[digit] = {}
            if isinstance(kid, Branch):
                node.size += self._into(kid, keys[lo:hi], counts[lo:hi])
                continue
            had, get = len(kid), kid.get
            for key, n in zip(keys[lo:hi].tolist(), counts[lo:hi].tolist()):
                kid[key] = get(key, 0) + n
            node.size += len(kid) - had
            if len(kid) > self.burst and node.shift:
                node.kids[digit] = self._parted(kid, node.shift - DIGIT_BITS)
        return node.size - before

    def _parted(self, container: dict, shift: int) -> Branch:
        node = Branch(shift)
        for key, n in container.items():
            node.kids.setdefault((key >> shift) & ((1 << DIGIT_BITS) - 1), {})[key] = n
        node.size = len(container)
        for digit, kid in node.kids.items():
            if len(kid) > self.burst and shift:
                node.kids[digit] = self._parted(kid, shift - DIGIT_BITS)
        return node

    def taken(self, share: float) -> Iterator[dict]:
        """Remove whole subtrees, the largest first, until ``share`` of the entries has gone; yields their containers."""
        goal = self.size * (1 - share)
        sized = sorted(((k.size if isinstance(k, Branch) else len(k), d) for d, k in self.root.kids.items()), reverse=True)
        for size, digit in sized:
            if self.root.size <= goal:
                return
            self.root.size -= size
            yield from self._containers(self.root.kids.pop(digit))

    def _containers(self, node) -> Iterator[dict]:
        if not isinstance(node, Branch):
            yield node
            return
        for kid in node.kids.values():
            yield from self._containers(kid)


class Ids(dict):
    """Numbers words from 1 as they are asked for; 0 is no word, -1 the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        new = self[word] = len(self) - 1
        return new


class Names:
    """Word ids of a task, their words and 64-bit hashes."""

    def __init__(self):
        self.ids, self.hashes = Ids({b"": 0, b"\n": -1}), np.zeros(1, np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        ids, n = self.ids, len(self.ids) - 1
        out = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        if len(ids) - 1 > n:
            new = list(ids)[n + 1 :]
            self.hashes = np.append(self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)))
        return out

    def words(self) -> list[bytes]:
        words = list(self.ids)
        del words[1]
        return words


def _language(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _paired(first: np.ndarray, second: np.ndarray, lang: np.uint64) -> np.ndarray:
    """Hash of a language's pairs of words."""
    return mixed((first * BASE + second) ^ lang)


def _runs(lang: str, containers, names: Names, parts: int, hot: np.ndarray) -> Iterator[list[tuple]]:
    """Sorted runs (part, lang, phrases, counts) of spilled subtrees, in lists of bounded size."""
    squeeze, words = zstandard.ZstdCompressor(level=1), names.words()
    held: list[dict] = []
    size = 0

    def run() -> list[tuple]:
        keys = np.concatenate([np.fromiter(c, np.int64, len(c)) for c in held])
        counts = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in held])
        a, b, c = keys >> (2 * ID_BITS), (keys >> ID_BITS) & ID_MASK, keys & ID_MASK
        prefix = _paired(names.hashes[a], names.hashes[b], _language(lang))
        if len(hot):
            split = np.isin(prefix, hot) & (c > 0)
            prefix[split] = _paired(prefix[split], names.hashes[c[split]], np.uint64(0))
        part = (prefix % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order)).tolist()
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            at = order[lo:hi]
            rows = sorted(
                (words[x] + b" " + words[y] + b" " + words[z] if z else words[x] + b" " + words[y] if y else words[x], n)
                for x, y, z, n in zip(a[at].tolist(), b[at].tolist(), c[at].tolist(), counts[at].tolist())
            )
            text = squeeze.compress(b"\n".join(p for p, _ in rows))
            out.append((int(part[at[0]]), lang, text, squeeze.compress(np.array([n for _, n in rows], "<i8").tobytes())))
        return out

    for container in containers:
        held.append(container)
        size += len(container)
        if size >= ENTRIES // 4:
            yield run()
            held, size = [], 0
    if held:
        yield run()


def _grams(ids: np.ndarray, names: Names, lang: str, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct keys of a slice with their counts, and its words. With a bitmap of pairs: triples, else words and pairs."""
    ids = ids[ids != 0]
    word = ids > 0
    pair = word[:-1] & word[1:]
    if bitmap is None:
        keys = np.concatenate([ids[word] << (2 * ID_BITS), ((ids[:-1] << ID_BITS | ids[1:]) << ID_BITS)[pair]])
    else:
        at = _paired(names.hashes[ids[:-1]], names.hashes[ids[1:]], _language(lang)) >> np.uint64(64 - FILTER_BITS)
        pair &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        triple = pair[:-1] & pair[1:]
        keys = ((ids[:-2] << ID_BITS | ids[1:-1]) << ID_BITS | ids[2:])[triple]
    keys, counts = np.unique(keys, return_counts=True)
    return keys, counts, int(word.sum())


def _counted(docs: DataFrame, least: int, lang: str, parts: int, bitmap=None, hot=None) -> DataFrame:
    """Rows (lang, phrase, n): words and pairs, or with a bitmap triples, with ``least`` places at least.

    Without a bitmap the row of phrase "" has all word occurrences of the language.
    """
    kinds = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])

    def count(batches) -> Iterator[pa.RecordBatch]:
        pairs, hashes = (np.frombuffer(bitmap(), np.uint8), hot()) if bitmap else (None, np.zeros(0, np.uint64))
        names, tries, total = Names(), {}, {}

        def spilled(share: float) -> Iterator[pa.RecordBatch]:
            for own, trie in tries.items():
                for rows in _runs(own, trie.taken(share), names, parts, hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)

        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                langs = batch.column("lang").slice(lo, hi - lo).to_pylist()
                for own in set(langs):
                    text = b"\n".join(t or b"" for t, x in zip(texts, langs) if x == own)
                    ids = names.of(text.translate(PIECES).replace(b"\n", b" \n ").split(b" "))
                    keys, counts, words = _grams(ids, names, own, pairs)
                    total[own] = total.get(own, 0) + words
                    tries.setdefault(own, HatTrie()).add(keys, counts)
                if len(names.ids) > WORDS:
                    yield from spilled(1.0)
                    names, tries = Names(), {}
                elif sum(t.size for t in tries.values()) > ENTRIES:
                    yield from spilled(0.5)
        yield from spilled(1.0)
        if pairs is None:
            sums = [
                {"part": int(_language(own) % np.uint64(parts)), "lang": own, "phrases": zstandard.compress(b""),
                 "counts": zstandard.compress(np.array([n], "<i8").tobytes())}
                for own, n in total.items()
            ]
            yield pa.RecordBatch.from_pylist(sums, kinds)

    def merge(runs: pa.Table) -> pa.Table:
        open_, entries = zstandard.ZstdDecompressor(), {}
        for own, text, counts in zip(*(runs.column(c).to_pylist() for c in ("lang", "phrases", "counts"))):
            numbers = np.frombuffer(open_.decompress(counts), "<i8").tolist()
            entries.setdefault(own, []).extend(zip(open_.decompress(text).split(b"\n"), numbers))
        found = []
        for own, rows in entries.items():
            rows.sort()  # merges the sorted runs it finds
            last, n = None, 0
            for phrase, m in rows:
                if phrase != last:
                    if n >= least or last == b"":
                        found.append((own, last, n))
                    last, n = phrase, 0
                n += m
            if n >= least or last == b"":
                found.append((own, last, n))
        columns = list(zip(*found)) or [[], [], []]
        arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()).cast(pa.string()), pa.array(columns[2], pa.int64())]
        return pa.Table.from_arrays(arrays, ["lang", "phrase", "n"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), "text")
    runs = rows.mapInArrow(count, "part long, lang string, phrases binary, counts binary")
    return runs.groupBy("part").applyInArrow(merge, "lang string, phrase string, n long")


def _words_in(phrase: str = "phrase"):
    """Words of a phrase: none in the empty one."""
    return F.when(F.col(phrase) == "", 0).otherwise(F.size(F.split(phrase, " ")))


def _bitmap(pairs: DataFrame) -> bytes:
    """Bitmap of the hashes of frequent pairs, put together from blocks of fixed size."""
    block_bits = 15

    def place(batches):
        for batch in batches:
            words = [p.split(b" ") for p in batch.column("phrase").cast(pa.binary()).to_pylist()]
            first, second = (np.array([xxhash.xxh3_64_intdigest(w[i]) for w in words], np.uint64) for i in (0, 1))
            lang = np.array([_language(x) for x in batch.column("lang").to_pylist()], np.uint64)
            at = (mixed((first * BASE + second) ^ lang) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> block_bits), pa.array((at & ((1 << block_bits) - 1)))], ["block", "bit"])

    def fill(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << block_bits, np.uint8)
        bits[rows.column("bit").to_numpy()] = 1
        own = pa.array([np.packbits(bits, bitorder="little").tobytes()])
        return pa.Table.from_arrays([rows.column("block").combine_chunks().slice(0, 1), own], ["block", "bits"])

    placed = pairs.select("lang", "phrase").mapInArrow(place, "block long, bit long").distinct()
    size = 1 << block_bits >> 3
    out = bytearray(1 << FILTER_BITS >> 3)
    for row in placed.groupBy("block").applyInArrow(fill, "block long, bits binary").toLocalIterator():
        out[row.block * size : (row.block + 1) * size] = row.bits
    return bytes(out)


def _hot_pairs(pairs: DataFrame) -> np.ndarray:
    """Hashes of the fewer than ``HOT`` pairs that have over 1 / HOT of all places of frequent pairs."""
    total = pairs.agg(F.sum("n")).first()[0] or 0
    rows = pairs.where(F.col("n") * HOT > total).collect()
    out = [_paired(*(np.array([xxhash.xxh3_64_intdigest(w.encode())], np.uint64) for w in r.phrase.split(" ")), _language(r.lang))[0] for r in rows]
    return np.array(out, np.uint64)


def phrase_counts(docs: DataFrame, least: int = LEAST, lang: str = "lang") -> DataFrame:
    """Rows (lang, phrase, words, n): words, pairs and triples with ``least`` places at least; phrase "" has
    all words of the language."""
    parts = power_of_two(text_bytes(docs) / PART_BYTES)
    short = stored(_counted(docs, least, lang, parts).withColumn("words", _words_in()))
    pairs = short.where("words = 2")
    bitmap, hot = shared(docs.sparkSession, _bitmap(pairs)), shared(docs.sparkSession, _hot_pairs(pairs))
    triples = _counted(docs, least, lang, parts, bitmap, hot).withColumn("words", F.lit(3))
    return stored(short.unionByName(triples).select("lang", "phrase", "words", "n"))


def scored(counts: DataFrame) -> DataFrame:
    """Rows (lang, phrase, a, l, r, score) of all candidates that no longer one makes needless."""
    words = F.split("phrase", " ")
    many = counts.where("words >= 2").withColumn("w", words)
    cut = F.sequence(F.lit(1), F.col("words") - 1)
    cuts = many.select("lang", "phrase", F.col("n").alias("a"), "w", "words", F.explode(cut).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    exact = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    score = F.expr("cast(1000000 as decimal(7,0)) * a15 * a15 div (l15 * r15)")
    rated = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumns(
        {f"{c}15": v for c, v in exact.items()}
    ).select("lang", "phrase", F.struct(score.alias("score"), "k", "l", "r").alias("cut"), "a")
    weakest = rated.groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.max("a").alias("a"))
    inner = F.array(F.slice("w", 1, 2), F.slice("w", 2, 2))
    longer = many.where("words = 3").select("lang", F.explode(inner).alias("w"), "n")
    longer = longer.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("n").alias("longer"))
    free = weakest.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 50 * a")
    return free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, lang: str = "lang") -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, least, lang)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored(counts).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    some = salted.withColumn("rank", place).where(F.col("rank") <= best).drop("rank", "salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    words = counts.where("words = 0").select(F.col("lang").alias("of"), F.col("n").alias("all_words"))
    return ranked.where(F.col("rank") <= best).join(words, F.col("lang") == F.col("of")).select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score"
    )
