"""Embedding near-dedup by sorted projection passes.

1. Equal vectors become one class with a weight; its id is the least ``vec_id``.
2. Each pass orders the classes lexicographically by concatenated random hashes (quantised random
   projections, the first one leading) and compares each with its next ``WINDOW`` neighbours by
   cosine in double precision. A task sends a spanning forest of the links it finds, so a group of
   near copies costs one link for each member and pass, not one for each pair. It also sends the first and
   last ``WINDOW`` rows of its partition; these, still in order, are compared in the same way in far fewer tasks,
   until one holds them all. So each window is compared whole, wherever a partition ends.
3. The links of all passes are united to components.
4. The windows are bounded, so links inside a component are completed exactly: its members are dealt
   into blocks, and each pair of blocks is multiplied and counted. No pair is sent. Every link
   lies inside a component, so ``n_links`` misses a link only if the passes miss the connection.

A pair at cosine 0.95 shares a hash with probability about 0.87, and about log2(n / WINDOW) / 1.9
hashes name its window: at 50,000 vectors a pass finds a lone pair in about 45 of 100 cases, 24
passes miss it once in a million. The number of passes follows from that estimate and the number of distinct vectors
(``passes_for``): ``PASSES`` at least, 79 at a thousand million.

Defined cases: null, empty or zero vectors and those with null or non-finite components link with
nothing (n_links 0, own component); so do vectors of other lengths with each other. Repeated rows
count as vectors of their own. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.llm.common import stored
from scoreflow.llm.components import Forest, components

LEAST = 0.95
PASSES = 24
WINDOW = 32
HASHES = 16
BLOCK = 512
#: Rows at partition borders that one task compares.
BORDER_ROWS = 1 << 16
#: Estimated chance that all passes miss a lone pair.
MISSED = 1e-6
SEED = 20240229


def passes_for(n: int, window: int = WINDOW) -> int:
    """Passes over ``n`` vectors after which a lone pair at ``LEAST`` is missed with a chance of ``MISSED`` by estimate."""
    found = 0.87 ** (max(0.0, math.log2(max(n, 1) / window)) / 1.9)
    return max(PASSES, math.ceil(math.log(MISSED) / math.log(1 - min(found, 0.9))))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def _classes(vectors: DataFrame) -> DataFrame:
    """(v, vec_id, weight) of each distinct usable vector."""
    v = F.col("embedding").cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(usable).groupBy("v").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")
    )


def _ordered(classes: DataFrame, passes: int) -> DataFrame:
    """A row for each class and pass with its sort key."""

    def emit(batches):
        made: dict[int, tuple] = {}
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_numpy(), batch.column("v").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                raw = np.array([vectors[i] for i in at], np.float64)
                if d not in made:
                    rng = np.random.default_rng([SEED, d])
                    width = 2 / np.sqrt(d)
                    made[d] = rng.standard_normal((d, passes * HASHES)) / np.sqrt(d), rng.random(passes * HASHES) * width, width
                directions, shift, width = made[d]
                level = np.clip(np.floor((_unit(raw) @ directions + shift) / width) + 8, 0, 15)
                level = level.astype(np.uint64).reshape(len(at), passes, HASHES)
                key = np.zeros((len(at), passes), np.uint64)
                for j in range(HASHES):
                    key = key << np.uint64(4) | level[:, :, j]
                blobs = [r.tobytes() for r in raw]
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p)), pa.array(np.full(len(at), d)),
                         pa.array((key[:, p] ^ np.uint64(1 << 63)).view(np.int64)), pa.array(ids[at]), pa.array(blobs, pa.binary())],
                        ["pass", "size", "key", "vec_id", "v"],
                    )

    return classes.select("vec_id", "v").mapInArrow(emit, "pass long, size long, key long, vec_id long, v binary")


ORDER = ["pass", "size", "key", "vec_id"]


def _neighbours(ordered: DataFrame, least: float, window: int) -> DataFrame:
    """Links (a, b) between window neighbours, as a spanning forest for each pass and task."""
    names = ["a", "b", *ORDER, "v"]
    kinds = dict.fromkeys(names, pa.int64()) | {"v": pa.binary()}

    def rows(count: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(count, kinds[c]) for c in names], names)

    def border(batch: pa.RecordBatch) -> pa.RecordBatch:
        return rows(batch.num_rows, **{c: batch.column(c).to_pylist() for c in names[2:]})

    def compare(batches):
        known = tail_ids = tail = None
        forest, seen, end = Forest(), 0, []
        for batch in batches:
            first = min(max(0, window - seen), batch.num_rows)
            seen += batch.num_rows
            if first:
                yield border(batch.slice(0, first))
            # The last rows after those; a few batches hold them.
            end.append(batch.slice(max(first, batch.num_rows - window)))
            while sum(b.num_rows for b in end[1:]) >= window:
                end.pop(0)
            ids, blobs = batch.column("vec_id").to_numpy(), batch.column("v").to_pylist()
            group = np.stack([batch.column("pass").to_numpy(), batch.column("size").to_numpy()], 1)
            bounds = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), len(ids)]
            links = []
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                own, x = ids[lo:hi], _unit(_matrix(blobs[lo:hi]))
                old = 0
                if (here := tuple(group[lo])) == known:
                    old, own, x = len(tail), np.concatenate([tail_ids, own]), np.concatenate([tail, x])
                else:
                    forest = Forest()
                for step in range(1, min(window, len(own) - 1) + 1):
                    first = max(0, old - step)
                    close = np.einsum("ij,ij->i", x[first : len(x) - step], x[first + step :]) >= least
                    for i in (first + np.flatnonzero(close)).tolist():
                        a, b = int(own[i]), int(own[i + step])
                        if forest.join(a, b):
                            links.append((a, b))
                known, tail_ids, tail = here, own[-window:], x[-window:]
            if links:
                a, b = zip(*links)
                yield rows(len(links), a=a, b=b)
        extra = sum(b.num_rows for b in end) - window
        for batch in end:
            cut = min(max(0, extra), batch.num_rows)
            extra -= cut
            if cut < batch.num_rows:
                yield border(batch.slice(cut))

    found, tasks = None, None
    schema = ", ".join(f"{c} {'binary' if c == 'v' else 'long'}" for c in names)
    while True:
        spread = ordered.repartitionByRange(*ORDER) if tasks is None else ordered.repartitionByRange(tasks, *ORDER)
        out = stored(spread.sortWithinPartitions(*ORDER).mapInArrow(compare, schema))
        links = out.where("a is not null").select("a", "b")
        found = links if found is None else found.union(links)
        ordered = out.where("a is null").select(*ORDER, "v")
        if tasks == 1 or not (left := ordered.count()):
            return found.distinct()
        tasks = -(-left // max(BORDER_ROWS, 8 * window))


def _links_within(classes: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(vec_id, links): weight of the other classes linked with each class of a component."""
    members = classes.join(found, classes["vec_id"] == found["node"]).select("vec_id", "weight", "v", "component")
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    dealt = members.join(sizes, "component").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    # Small components share a group, so that a group is not a pair of vectors.
    shared = F.when(F.col("blocks") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(1009)))
    dealt = dealt.select(
        shared.alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "component", "vec_id", "weight", "v",
    )

    def count(table: pa.Table) -> pa.Table:
        comp, own = table.column("component").to_numpy(), table.column("own").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, weight = table.column("vec_id").to_numpy(), table.column("weight").to_numpy()
        vectors, rows = table.column("v").to_pylist(), []
        order = np.argsort(comp, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            for size in {len(vectors[k]) for k in at}:
                same = [k for k in at if len(vectors[k]) == size]
                left = np.array([k for k in same if own[k] == i], np.int64)
                right = np.array([k for k in same if own[k] == j], np.int64)
                if not len(left) or not len(right):
                    continue
                a = _unit(np.array([vectors[k] for k in left], np.float64))
                b = _unit(np.array([vectors[k] for k in right], np.float64))
                close = a @ b.T >= least
                if i == j:
                    np.fill_diagonal(close, False)
                rows += zip(ids[left].tolist(), (close @ weight[right]).tolist())
                if i != j:
                    rows += zip(ids[right].tolist(), (weight[left] @ close).tolist())
        columns = list(zip(*rows)) or [[], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["vec_id", "links"])

    counted = dealt.groupBy("g", "i", "j").applyInArrow(count, "vec_id long, links long")
    return counted.groupBy("vec_id").agg(F.sum("links").alias("links"))


def near_vectors(
    vectors: DataFrame, least: float = LEAST, passes: int | None = None, window: int = WINDOW
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept. Without ``passes`` their number follows from that of the vectors."""
    classes = stored(_classes(vectors))
    passes = passes or passes_for(classes.count(), window)
    found = stored(components(_neighbours(_ordered(classes, passes), least, window)))
    links = _links_within(classes, found, least)
    ids = F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(7)).alias("h2")
    about = classes.select(*ids, F.col("vec_id").alias("rep"), "weight")
    about = about.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left")
    about = about.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.concat_ws(":", "h1", "h2").alias("k"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
        F.coalesce("component", "rep").alias("c"),
    )
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.select("vec_id", F.concat_ws(":", *ids).alias("k"))
    return rows.join(about, "k", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "vec_id").alias("component_id"), (F.coalesce("c", "vec_id") == F.col("vec_id")).alias("kept"),
    )
