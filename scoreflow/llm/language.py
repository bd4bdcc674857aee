"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of ``LENGTH`` bytes, the last one padded with zero bytes. Embedded bytes pass
filters of several widths, each with max pooling over the window and a rectifier; a dense layer and softmax give
the shares of the languages. A document's shares are the mean over all its windows, weighted by their bytes.

The network is fitted on a bounded sample: of each language ``PER_LANGUAGE`` documents at most, chosen by a
hash of the id (fewer where all would be more than ``SAMPLE``), and ``WINDOWS`` windows of each, spread over the whole
text. Every tag is learned; more than ``LANGUAGES`` tags raise. For use, embedding and filters are folded into tables indexed by a byte pair or byte.

Defined cases: a text that is null or has no letter (a character of a Unicode category L) is ``und`` with score 0; repeated rows are judged one by one;
without any labelled document every text is ``und``; empty tables give no rows. Other columns are not
read, and ``accepted`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.rows import top_rows
from scoreflow.llm.common import shared, text_slices, texts_of

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
#: Tags that the network can tell apart; more of them raise.
LANGUAGES = 8192
#: Documents of a language, and of all languages together, in the sample.
PER_LANGUAGE = 1500
SAMPLE = 400_000
WINDOWS = 4
EPOCHS = 6
RATE = 0.004
SEED = 11
UNKNOWN = "und"
#: Least score of an accepted document.
LEAST = 0.3
LETTER = regex.compile(r"\p{L}")
CHUNK = 64


def _sampled(docs: DataFrame, labelled: Column) -> DataFrame:
    """Windows (lang, window) of the sample."""
    tags = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    languages = tags.select("lang").distinct().count()
    if languages > LANGUAGES:
        raise ValueError(f"{languages} language tags, more than {LANGUAGES}")
    quota = min(PER_LANGUAGE, SAMPLE // max(languages, 1))
    chosen = top_rows(tags, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], quota, "n").select("doc_id", "lang").distinct()

    def cut(batches):
        for batch in batches:
            langs, windows = [], []
            for lang, text, key in zip(batch.column("lang").to_pylist(), texts_of(batch), batch.column("key").to_pylist()):
                room = max(len(text) - LENGTH, 0)
                for j in range(WINDOWS if room else 1):
                    # Spread over the text; a hash moves each within its part.
                    at = (j * room + (key >> 8 * j) % 251 * room // 251) // WINDOWS
                    size = LENGTH if (key >> (8 * j + 4)) % 5 else 16 + (key >> j) % 112
                    langs.append(lang)
                    windows.append(text[at : at + size])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], ["lang", "window"])

    # At most SAMPLE ids.
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"])
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("key")
    return rows.select("lang", "text", key).mapInArrow(cut, "lang string, window binary")


def padded(windows: list[bytes]) -> np.ndarray:
    flat = b"".join(w.ljust(LENGTH, b"\0") for w in windows)
    return np.frombuffer(flat, np.uint8).reshape(-1, LENGTH)


class Network:
    """Weights of the byte network and their training."""

    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.weights = {"e": rng.normal(0, 0.5, (256, EMBEDDED))}
        for w in WIDTHS:
            self.weights[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDED), (w * EMBEDDED, FILTERS))
            self.weights[f"b{w}"] = np.zeros(FILTERS)
        self.weights["v"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        self.weights["c"] = np.zeros(len(languages))
        self.weights = {k: x.astype(np.float32) for k, x in self.weights.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of a batch."""
        p, n = self.weights, len(x)
        embedded, pooled, places = p["e"][x], [], []
        for w in WIDTHS:
            patches = np.concatenate([embedded[:, j : LENGTH - w + 1 + j] for j in range(w)], axis=2)
            out = patches @ p[f"w{w}"]
            place = out.argmax(axis=1)
            pooled.append(np.take_along_axis(out, place[:, None, :], 1)[:, 0] + p[f"b{w}"])
            places.append(place)
        hidden = np.concatenate(pooled, axis=1)
        active = np.maximum(hidden, 0)
        share = softmax(active @ p["v"] + p["c"])
        share[np.arange(n), y] -= 1
        share /= n
        g = {"v": active.T @ share, "c": share.sum(0), "e": np.zeros_like(p["e"])}
        back = (share @ p["v"].T) * (hidden > 0)
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            at = places[i]
            g[f"b{w}"] = own.sum(0)
            g[f"w{w}"] = np.empty_like(p[f"w{w}"])
            for j in range(w):  # only the pooled place of each filter has a gradient
                part = slice(j * EMBEDDED, (j + 1) * EMBEDDED)
                g[f"w{w}"][part] = np.einsum("nfd,nf->df", embedded[rows, at + j], own)
                flow = own[:, :, None] * p[f"w{w}"][part].T[None]
                symbols = x[rows, at + j].ravel()
                for d in range(EMBEDDED):
                    g["e"][:, d] += np.bincount(symbols, flow[:, :, d].ravel(), 256)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(SEED)
        # Rare languages weigh as much as frequent ones: each is drawn equally often.
        by_class = [np.flatnonzero(y == c) for c in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        steps = max(200, EPOCHS * len(x) // 128)
        for t in range(1, steps + 1):
            classes = rng.integers(0, len(by_class), 128)
            rows = np.array([by_class[c][rng.integers(len(by_class[c]))] for c in classes])
            rate = RATE * (1 - t / (steps + 1))
            for k, g in self.gradients(x[rows], y[rows]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                step = (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
                self.weights[k] = (self.weights[k] - rate * step).astype(np.float32)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class Folded:
    """The network for use: each filter as a sum of table rows, indexed by a pair of bytes or one byte."""

    def __init__(self, net: Network):
        p = net.weights
        self.net = net
        part = {(w, j): p["e"] @ p[f"w{w}"][j * EMBEDDED : (j + 1) * EMBEDDED] for w in WIDTHS for j in range(w)}
        pair = lambda w, j: (part[w, j][:, None, :] + part[w, j + 1][None]).reshape(1 << 16, FILTERS)
        self.tables = {w: [pair(w, j) if j + 1 < w else part[w, j] for j in range(0, w, 2)] for w in WIDTHS}

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Shares of the languages for each window (n, LENGTH) of bytes."""
        p, out = self.net.weights, []
        for lo in range(0, len(x), CHUNK):
            own = x[lo : lo + CHUNK]
            pairs = own[:, :-1].astype(np.intp) << 8 | own[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = LENGTH - w + 1
                total = None
                for table, j in zip(self.tables[w], range(0, w, 2)):
                    index = pairs[:, j : j + n] if j + 1 < w else own[:, j : j + n]
                    found = table.take(index, axis=0)
                    total = found if total is None else np.add(total, found, out=total)
                pooled.append(total.max(axis=1) + p[f"b{w}"])
            out.append(softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ p["v"] + p["c"]))
        return np.concatenate(out)


def fitted(docs: DataFrame, labelled: Column) -> Network | None:
    """Network learned from text and ``lang`` of the documents that ``labelled`` selects."""
    rows = _sampled(docs, labelled).toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["lang", "window"])
    languages = sorted(rows["lang"].unique())
    return Network(languages).fit(padded([bytes(w) for w in rows["window"]]), np.searchsorted(languages, rows["lang"].to_numpy()))


def predicted(model: Folded | None, texts: list[bytes | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    out: list[tuple[str, float]] = []
    todo, sizes = [], []

    def flush():
        cut = [t[i : i + LENGTH] for t in todo for i in range(0, len(t), LENGTH)]
        shares = model.shares(padded(cut)) * np.array([len(c) for c in cut])[:, None]
        ends = np.cumsum([-(-len(t) // LENGTH) for t in todo])
        for i, total in zip(sizes, np.add.reduceat(shares, np.concatenate([[0], ends[:-1]]), axis=0)):
            best = int(total.argmax())
            out[i] = model.net.languages[best], float(min(1.0, total[best] / total.sum()))
        todo.clear()
        sizes.clear()

    held = 0
    for text in texts:
        out.append((UNKNOWN, 0.0))
        if model and text and LETTER.search(text.decode()):
            todo.append(text)
            sizes.append(len(out) - 1)
            held += len(text)
        if held > 1 << 20:
            flush()
            held = 0
    if todo:
        flush()
    return out


def identified(docs: DataFrame, model: Network | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    sent = shared(docs.sparkSession, model)

    def judge(batches):
        net = sent()
        folded = Folded(net) if net else None
        for batch in batches:
            found = [f for _, _, texts in text_slices(batch) for f in predicted(folded, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Network | None, least: float = LEAST) -> DataFrame:
    """The documents, with all columns, whose language is found with a score of ``least`` or more."""
    sent = shared(docs.sparkSession, model)

    def choose(batches):
        net = sent()
        folded = Folded(net) if net else None
        for batch in batches:
            found = [f for _, _, texts in text_slices(batch) for f in predicted(folded, texts)]
            yield batch.filter(pa.array([f[0] != UNKNOWN and f[1] >= least for f in found], pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)
