"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Features are words (A-Z lower-cased runs of ASCII digits, letters and non-ASCII characters) and their
first 4, 5 and 6 bytes, so that inflected and compound forms meet. The feature set is the ``FEATURES`` best
by chi-square against the label in a bounded sample of labelled documents (``EXAMPLES`` of each label at most, by
a hash of the id), however small their chi-square is; a feature of a single example is left out, as no two examples share it.
The same sample is the set of examples. Document frequencies are counted over all documents.

The index holds, for each feature, its examples by position in blocks of ``BLOCK``, and the largest weight
in each block. A query sums these into an upper bound for each block, scores the ``SEEDS`` blocks of the highest bounds, and
then only the blocks whose bound reaches the ``NEIGHBOURS``-th best cosine among those (whole lists where most blocks do):
the result is exact. Neighbours vote with 1 / (1.05 - cosine),
times the number of documents that an example of its label stands for; the vote is calibrated by isotonic regression of the
examples' own leave-one-out votes. Evidence: the neighbours and the features that they share with the text.

Defined cases: null and empty texts, and those without a known feature, get the calibrated share of toxic
documents among such examples; without examples the score is 0; labels that are null are left out and of several labels of one
document the largest counts; repeated rows are scored one by one; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.llm.common import ALNUM, Generations, shared, texts_of

EXAMPLES = 4000
FEATURES = 8192
PREFIXES = (4, 5, 6)
BLOCK = 64
#: Blocks that are scored first.
SEEDS = 4
NEIGHBOURS = 11
SMOOTHING = 0.5


def features_of(word: bytes) -> list[bytes]:
    return [word, *(b"^" + word[:n] for n in PREFIXES if len(word) > n)]


def chosen_examples(labels: DataFrame, label: str, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, label): at most ``examples`` ids of each of the labels 0 and 1, and what each stands for."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long")).agg(F.max(label).cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [
        known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        .withColumn("stands_for", F.lit(totals.get(y, 0) / max(1, min(totals.get(y, 0), examples))))
        for y in (0, 1)
    ]
    return parts[0].union(parts[1])


def _chosen_features(sample: DataFrame) -> list[bytes]:
    def count(batches):
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(texts_of(batch), batch.column("label").to_pylist()):
                words = set((text or b"").translate(ALNUM).split())
                seen[y].update({f for w in words for f in features_of(w)})
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), *(pa.array([seen[y][f] for f in names], pa.int64()) for y in (0, 1))],
                ["feature", "n0", "n1"],
            )

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    a, b = sizes.get(0, 0), sizes.get(1, 0)
    if not a or not b:
        return []
    n0, n1, all_ = F.sum("n0"), F.sum("n1"), F.sum("n0") + F.sum("n1")
    miss = (n1 * (a - n0) - n0 * (b - n1)).cast("double")
    chi2 = (a + b) * miss * miss / (all_.cast("double") * (a + b - all_) * a * b + 1e-9)
    found = sample.select("text", "label").mapInArrow(count, "feature binary, n0 long, n1 long")
    found = found.groupBy("feature").agg(chi2.alias("chi2"), all_.alias("n")).where("n >= 2")
    return [bytes(r["feature"]) for r in found.orderBy(F.desc("chi2"), "feature").limit(FEATURES).collect()]


class Vocabulary:
    """Known features of texts, word by word."""

    def __init__(self, features: list[bytes]):
        number = {f: i for i, f in enumerate(features)}
        self.words = Generations(lambda w: tuple(number[f] for f in features_of(w) if f in number))

    def __call__(self, text: bytes | None) -> Counter:
        words = (text or b"").translate(ALNUM).split()
        return Counter(chain.from_iterable(filter(None, map(self.words.__getitem__, words))))


def _document_frequencies(docs: DataFrame, features: list[bytes]) -> tuple[int, np.ndarray]:
    sent = shared(docs.sparkSession, features)

    def count(batches):
        vocabulary = Vocabulary(sent())
        seen: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                seen.update(vocabulary(text).keys())
            seen[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen.keys()), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"]
        )

    found = docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    frequencies, total = np.zeros(len(features)), 0
    for r in found.collect():  # one row for each feature at most
        if r["feature"] < 0:
            total = r["n"]
        else:
            frequencies[r["feature"]] = r["n"]
    return total, frequencies


class BlockMaxIndex:
    """Examples as unit TF-IDF vectors, with block maxima for each feature."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[int, int, float, Counter]]):
        self.idf = idf
        rows = [(doc, y, n, *self.vector(c)) for doc, y, n, c in examples if c]
        # Examples that share their heaviest feature stand together: their blocks have tight bounds.
        rows.sort(key=lambda r: (int(r[3][r[4].argmax()]), r[1], r[0]))
        self.doc, self.label = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.stands_for = np.array([r[2] for r in rows], np.float64)
        self.blocks = -(-len(rows) // BLOCK)
        # Postings by feature and place; (feature, block) has those from its ``starts`` to the next one.
        place = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        feature = np.concatenate([r[3] for r in rows] or [np.zeros(0, np.int64)])
        order = np.lexsort((place, feature))
        self.place = place[order]
        self.weight = np.concatenate([r[4] for r in rows] or [np.zeros(0)])[order]
        own = feature[order] * self.blocks + self.place // BLOCK
        self.starts = np.searchsorted(own, np.arange(len(idf) * self.blocks + 1))
        self.most = np.zeros(len(idf) * self.blocks)
        np.maximum.at(self.most, own, self.weight)
        self.most = self.most.reshape(len(idf), self.blocks)
        self.known = self.most.any(axis=1)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        f = np.array(sorted(counts), np.int64)
        w = (1 + np.log([counts[i] for i in f.tolist()])) * self.idf[f]
        return f, w / np.sqrt((w * w).sum())

    def nearest(self, counts: Counter, k: int = NEIGHBOURS, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the ``k`` nearest examples with a cosine over 0, best first, ties by position."""
        f, w = self.vector(counts)
        bound = w @ self.most[f]
        if not bound.any():
            return np.zeros(0, np.int64), np.zeros(0)

        def scores(blocks: np.ndarray | None) -> np.ndarray:
            if blocks is None:  # whole lists, which lie together
                lo, hi = self.starts[f * self.blocks], self.starts[(f + 1) * self.blocks]
                lists = [slice(a, b) for a, b in zip(lo.tolist(), hi.tolist())]
                at = np.concatenate([self.place[x] for x in lists])
                part = np.concatenate([self.weight[x] for x in lists]) * np.repeat(w, hi - lo)
            else:
                own = (f[:, None] * self.blocks + blocks).ravel()
                lo = self.starts[own]
                n = self.starts[own + 1] - lo
                ends = np.cumsum(n)
                at = np.repeat(lo - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
                part = self.weight[at] * np.repeat(np.repeat(w, len(blocks)), n)
                at = self.place[at]
            found = np.bincount(at, part, len(self.doc))
            if without is not None:
                found[self.doc == without] = 0
            return found

        # The blocks of highest bound give a cosine that the k-th best reaches; no block of a lower bound can change the result.
        order = np.argsort(-bound, kind="stable")
        score = scores(order[:SEEDS])
        least = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else 0.0
        rest = order[SEEDS:]
        rest = rest[(bound[rest] > 0) & (bound[rest] >= least - 1e-9)]
        # Reading whole lists costs less than picking more than a third of the blocks out of them.
        score = scores(None) if 3 * len(rest) > self.blocks else score + scores(rest)
        at = np.flatnonzero(score >= max(least - 1e-9, 1e-300))
        at = at[np.lexsort((at, -np.round(score[at], 12)))[:k]]
        return at, score[at]


class Scorer:
    """Calibrated votes of the nearest examples."""

    def __init__(self, features: list[bytes], idf: np.ndarray, examples: list[tuple[int, int, float, Counter]]):
        self.features, self.index = features, BlockMaxIndex(idf, examples)
        y = np.array([e[1] for e in examples], np.float64)
        n = np.array([e[2] for e in examples], np.float64)
        votes = np.array([self.vote(*self.index.nearest(c, without=doc)) if c else 0.0 for doc, _, _, c in examples])
        self.low, self.share = isotonic(votes, y, n)

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        w = self.index.stands_for[place] / (1.05 - np.minimum(cosine, 1.0))
        return float((w * self.index.label[place]).sum() / (w.sum() + SMOOTHING)) if len(w) else 0.0

    def calibrated(self, vote: float) -> float:
        if not len(self.low):
            return 0.0
        return float(np.clip(self.share[max(0, np.searchsorted(self.low, vote, side="right") - 1)], 0, 1))

    def __call__(self, counts: Counter) -> tuple[float, list[tuple[int, int, float]], list[str]]:
        place, cosine = self.index.nearest(counts) if counts else (np.zeros(0, np.int64), np.zeros(0))
        near = list(zip(self.index.doc[place].tolist(), self.index.label[place].tolist(), cosine.tolist()))
        shared_words = [self.features[f].decode(errors="replace") for f, _ in counts.most_common() if self.index.known[f]]
        return self.calibrated(self.vote(place, cosine)), near, shared_words


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from which x on, mean of y) of the weighted isotonic regression."""
    steps: list[list[float]] = []  # low, sum of weights, sum of weighted y
    for v in np.unique(x):
        own = x == v
        steps.append([float(v), float(weight[own].sum()), float((weight * y)[own].sum())])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            last = steps.pop()
            steps[-1][1] += last[1]
            steps[-1][2] += last[2]
    return np.array([s[0] for s in steps]), np.array([s[2] / s[1] for s in steps])


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES) -> Scorer:
    """Scorer learned from ``labels`` (doc_id and 0 or 1); frequencies come from all of ``docs``."""
    # At most 2 * EXAMPLES ids.
    chosen = F.broadcast(chosen_examples(labels, label, examples))
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id")
    features = _chosen_features(sample)
    sent = shared(docs.sparkSession, features)

    def read(batches):
        vocabulary = Vocabulary(sent())
        for batch in batches:
            found = [vocabulary(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "label", "stands_for")),
                 pa.array([list(c.keys()) for c in found], pa.list_(pa.int64())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                ["doc_id", "label", "stands_for", "features", "counts"],
            )

    rows = sample.mapInArrow(read, "doc_id long, label int, stands_for double, features array<long>, counts array<long>")
    found = [(r["doc_id"], r["label"], r["stands_for"], Counter(dict(zip(r["features"], r["counts"])))) for r in rows.collect()]
    found.sort(key=lambda e: e[:2])
    total, frequencies = _document_frequencies(docs, features)
    return Scorer(features, np.log((1 + total) / (1 + frequencies)) + 1, found)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Per document: doc_id, score, neighbours (doc_id, label, cosine) and the features that speak for them."""
    sent = shared(docs.sparkSession, scorer)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def judge(batches):
        own = sent()
        vocabulary = Vocabulary(own.features)
        for batch in batches:
            found = [own(vocabulary(t)) for t in texts_of(batch)]
            near = [[{"doc_id": d, "label": y, "cosine": c} for d, y, c in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.float64()), pa.array(near, kind),
                 pa.array([f[2] for f in found], pa.list_(pa.string()))],
                ["doc_id", "score", "neighbours", "evidence"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        judge, "doc_id long, score double, neighbours array<struct<doc_id:long,label:int,cosine:double>>, evidence array<string>"
    )
