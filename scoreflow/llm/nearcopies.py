"""MinHash near-dedup by min-max hashing over word shingles.

A document's set: the hashes of its distinct shingles of ``k`` words (runs of bytes other than space
and 0x09-0x0D, A-Z lower-cased); with fewer words, the whole sequence as one; without words, empty
and linked with nothing. Two sets are linked if 100 * |intersection| >= ``percent`` * |union|.

1. 64 permutations, of each both the minimum and the maximum over the set: a signature of 128
   values for 64 hash evaluations a shingle. Bands of 5 values; a pair at 0.8 shares one of the 25
   bands in all but 5 of 100,000 cases.
2. Documents of equal sets become one class.
3. In each bucket of a band, all members are compared with its leader (of least hash). Pairs pass a
   loose test on signatures, then the full sets decide.
4. Pairs of two members that do not lead are still open. Where the members of a bucket lie in
   several components, those outside its largest one are compared with all its members, full set by full set, in pairs of blocks of
   bounded size; a pair of blocks sends a spanning forest of the links it finds. So every pair that
   shares a band is compared or already connected, no bucket is met whole in one task, and no pair
   is sent but the leaders'.
5. Components of all links. Only texts of documents that share a bucket are ever sent, compressed.

Defined cases: null and empty texts have n_shingles 0 and stay alone; documents with one set (copies,
repeated rows) are linked; rows that share a doc_id are one document: what is near to any of their texts is
linked to it; rows with a null doc_id are not linked and get nulls; empty tables give no rows; other columns are not read, and ``without_copies`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.llm.common import hashed, mixed, rolling, stored, text_slices, word_hashes
from scoreflow.llm.components import Forest, components

K = 4
#: Row ids of texts that share an id with others start here.
OWN_ID = 1 << 62
PERCENT = 80
PERMUTATIONS = 64
BAND = 5
BANDS = 2 * PERMUTATIONS // BAND
BLOCK = 512
#: Estimates of linked pairs have a deviation of at most 0.035; four of them are allowed for.
SLACK = 0.14
SEED = 7


def shingle_set(words: list[bytes], cache, k: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    h = hashed(words, cache)
    return np.unique(mixed(rolling(h, min(k, len(h))))) if len(h) else h


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    def emit(batches):
        rng = np.random.default_rng(SEED)
        factor = rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
        cache = word_hashes()
        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                sets = [shingle_set((t or b"").lower().split(), cache, k) for t in texts]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                bands = [None] * len(sets)
                signs, digests = bands.copy(), np.zeros((len(sets), 2), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.cumsum(sizes[full]) - sizes[full]
                    sign = np.empty((len(full), 2 * PERMUTATIONS), np.uint64)
                    for p in range(PERMUTATIONS):
                        h = flat * factor[p] + shift[p]
                        sign[:, 2 * p] = np.minimum.reduceat(h, at)
                        sign[:, 2 * p + 1] = np.maximum.reduceat(h, at)
                    keys = np.zeros((len(full), BANDS), np.uint64)
                    for b in range(BANDS):
                        # Bands step over the values so that one permutation rarely gives two of a band.
                        for c in range(BAND):
                            keys[:, b] = mixed(keys[:, b] ^ sign[:, b + c * BANDS]) + np.uint64(b + 1)
                    small = (mixed(sign) >> np.uint64(56)).astype(np.uint8)
                    digests[full, 0] = np.add.reduceat(flat, at)
                    digests[full, 1] = np.add.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for i, key, s in zip(full.tolist(), keys.view(np.int64), small):
                        bands[i], signs[i] = key, s.tobytes()
                d = digests.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(d[:, 0]),
                     pa.array(d[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                    ["doc_id", "n_shingles", "s1", "s2", "bands", "sign"],
                )

    kept = docs.select(F.col("doc_id").cast("long"), "text")
    return kept.mapInArrow(emit, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sign binary")


def _set_key():
    return F.concat_ws(":", "s1", "s2", "n_shingles")


def _alike(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures (sign_a, sign_b) allow a similarity of ``least``."""

    def test(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS)
                    for c in ("sign_a", "sign_b"))
            near = (a == b).mean(axis=1) >= least
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(near))

    return rows.select("a", "b", "sign_a", "sign_b").mapInArrow(test, "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets are linked."""

    def confirm(batches):
        open_, cache = zstandard.ZstdDecompressor(), word_hashes()
        last = own = None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                if a != last:
                    last, own = a, shingle_set(open_.decompress(x).split(), cache, k)
                other = shingle_set(open_.decompress(y).split(), cache, k)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = texts.select(F.col("rep").alias("a"), F.col("blob").alias("x"))
    y = texts.select(F.col("rep").alias("b"), F.col("blob").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def _compressed(docs: DataFrame) -> DataFrame:
    def emit(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            blobs = [squeeze.compress((t or b"").lower()) for _, _, texts in text_slices(batch) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(blobs, pa.binary())], ["rep", "blob"])

    return docs.mapInArrow(emit, "rep long, blob binary")


def _with_signs(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    a = signs.select(F.col("rep").alias("a"), F.col("sign").alias("sign_a"))
    b = signs.select(F.col("rep").alias("b"), F.col("sign").alias("sign_b"))
    return pairs.join(a, "a").join(b, "b")


def shared_sizes(one: np.ndarray, flat: np.ndarray, starts: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one set with each of the sets in ``flat``.

    Sets hold small numbers; ``seen`` is a row of zeros, one for each number.
    """
    seen[one] = 1
    sizes = np.add.reduceat(seen[flat], starts)
    seen[one] = 0
    return sizes


def _open_links(members: DataFrame, leading: DataFrame, found: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components in a bucket that its leader has not covered.

    The full sets are compared inside the blocks; a block sends a spanning forest of its links.
    """
    rest = members.join(leading, ["key", "rep"], "left_anti")
    rest = rest.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    rest = rest.withColumn("component", F.coalesce("component", "rep"))
    by_comp = rest.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = by_comp.groupBy("key").agg(
        F.max(F.struct("n", "component"))["component"].alias("main"),
        F.count("*").alias("comps"),
        F.ceil(F.sum("n") / BLOCK).alias("blocks"),
        F.ceil((F.sum("n") - F.max("n")) / BLOCK).alias("stray_blocks"),
    ).where("comps > 1").drop("comps")
    rest = rest.join(main, "key").join(texts, "rep")
    h = F.xxhash64("rep")
    all_rows = rest.select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stray_blocks") - 1)).alias("i"),
        F.pmod(h, F.col("blocks")).alias("j"), F.lit(False).alias("stray"), "rep", "component", "blob",
    )
    strays = rest.where("component <> main").select(
        "key", F.pmod(h, F.col("stray_blocks")).alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"),
        F.lit(True).alias("stray"), "rep", "component", "blob",
    )

    def compare(table: pa.Table) -> pa.Table:
        open_, cache, forest, links = zstandard.ZstdDecompressor(), word_hashes(), Forest(), []
        stray = table.column("stray").to_numpy(zero_copy_only=False).astype(bool)
        rep, comp = table.column("rep").to_numpy(), table.column("component").to_numpy()
        sets = [shingle_set(open_.decompress(b).split(), cache, k) for b in table.column("blob").to_pylist()]
        numbers = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        sizes = np.array([len(s) for s in sets])
        sets = np.split(numbers, np.cumsum(sizes)[:-1])
        every = np.flatnonzero(~stray)
        if len(every):
            flat, starts = np.concatenate([sets[i] for i in every]), np.cumsum(sizes[every]) - sizes[every]
            seen = np.zeros(int(numbers.max()) + 1, np.int64)
            for i in np.flatnonzero(stray).tolist():
                both = shared_sizes(sets[i], flat, starts, seen)
                linked = 100 * both >= percent * (sizes[i] + sizes[every] - both)
                for o in every[linked & (comp[every] != comp[i])].tolist():
                    if forest.join(int(comp[i]), int(comp[o])):
                        links.append((max(rep[i], rep[o]), min(rep[i], rep[o])))
        columns = list(zip(*links)) or [[], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return all_rows.union(strays).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_copies(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Rows of an id that occurs more than once take part under an id of their own text, tied to the shared id.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared_ids = stored(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").drop("n"))
    if shared_ids.isEmpty():
        return _copies(ids, k, percent, None)
    # Above all real ids, so a component's least id is a real one.
    own = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(OWN_ID - 1)).bitwiseOR(F.lit(OWN_ID))
    marked = ids.join(shared_ids.withColumn("shared", F.lit(True)), "doc_id", "left")
    named = stored(marked.select(F.when(F.col("shared"), own).otherwise(F.col("doc_id")).alias("own"), "doc_id", "text", "shared"))
    ties = stored(named.where("shared").select(F.col("own").alias("a"), F.col("doc_id").alias("b")).distinct())
    return _copies(named.select(F.col("own").alias("doc_id"), "text"), k, percent, ties)


def _copies(docs: DataFrame, k: int, percent: int, ties: DataFrame | None) -> DataFrame:
    """The same where equal ids have equal texts. ``ties`` (a, b): id b that the row id a stands for."""
    least = percent / 100 - SLACK
    sets = stored(_signatures(docs, k))
    reps = sets.where("n_shingles > 0").groupBy(_set_key().alias("set")).agg(F.min("doc_id").alias("rep"))
    member_of = stored(
        sets.where("n_shingles > 0").select("doc_id", _set_key().alias("set0"))
        .join(reps.withColumnRenamed("set", "set0"), "set0").select("doc_id", "rep")
    )
    firsts = member_of.where("doc_id = rep").select("rep").distinct()
    classes = sets.where("n_shingles > 0").join(firsts, F.col("doc_id") == F.col("rep"), "left_semi")
    classes = classes.select(F.col("doc_id").alias("rep"), "bands", "sign")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stored(banded.join(shared, "key"))
    busy = members.select("rep").distinct()
    signs = stored(classes.select("rep", "sign").join(busy, "rep", "left_semi"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(busy, "rep", "left_semi")
    texts = stored(_compressed(texts).dropDuplicates(["rep"]))

    least_hash = F.min(F.struct(F.xxhash64(F.lit(1), "rep").alias("h"), "rep"))["rep"]
    leading = stored(members.groupBy("key").agg(least_hash.alias("rep")))
    led = members.join(leading.withColumnRenamed("rep", "leader"), "key").where("rep <> leader")
    first = led.select(F.greatest("leader", "rep").alias("a"), F.least("leader", "rep").alias("b")).distinct()
    links = stored(_linked(_alike(_with_signs(first, signs), least), texts, k, percent))
    found = stored(components(links))
    rest = stored(_open_links(members, leading, found, texts, k, percent))
    if not rest.isEmpty():
        edges = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = stored(components(edges.union(rest)))
    if ties is not None:
        edges = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        tied = member_of.join(ties, F.col("doc_id") == F.col("a")).select(F.col("rep").alias("a"), "b")
        found = stored(components(edges.union(tied)))
    rows = sets.select("doc_id", "n_shingles").join(
        member_of.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left"
    )
    rows = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    if ties is not None:
        back = ties.select(F.col("a").alias("doc_id"), F.col("b").alias("real"))
        rows = rows.join(back, "doc_id", "left").withColumn("doc_id", F.coalesce("real", "doc_id"))
    root = F.coalesce("component", "rep", "doc_id")
    return rows.select("doc_id", "n_shingles", root.alias("component_id"), (root == F.col("doc_id")).alias("kept"))


def without_copies(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The documents of smallest id of each component, with all columns; rows that repeat such an id stay."""
    gone = near_copies(docs, k, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
