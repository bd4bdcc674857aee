"""Quality rules: cutoffs whose rate of false rejections is bounded on labelled holdouts.

Every rule is a whole number from 0 to ``TOP`` taken from one text; a text breaks the rule where the
number is above the rule's cutoff. Cutoffs are set for each stratum (language) of the labelled texts:

1. Design rows (by a digest of the id) propose the cutoff that gains most: rejected bad texts less
   ``PENALTY`` for each rejected good one; of equal gains the mildest. A rule without gain is off.
2. Holdout rows, which had no part in step 1, certify. From the mildest cutoff on, each cutoff down to
   the proposed one is tested with the exact binomial tail: with k of n good texts rejected, it passes
   if P(Binomial(n, risk) <= k) <= level, that is, if the Clopper-Pearson upper bound of its false
   rejection rate is at most ``risk``. The first failure ends the sequence, so a sequence needs one level only.
3. Correction: the level is ``doubt`` / (strata x rules), the risk of a rule ``risk`` / rules. So with
   probability 1 - ``doubt`` no stratum loses more than the share ``risk`` of its good texts to all rules together.

A stratum with too few labelled good texts certifies nothing and rejects nothing. All labelled rows
count; what is shipped are counts of (stratum, rule, number), reduced in each task.

Defined cases: a null or empty text has no words and numbers 0; a null stratum is ``und``; a text that
holds one line is one line; an id with several labels counts as bad if one of them is; labels that are null
or of an unknown id count nothing; rows that share an id are judged each by itself; empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.llm.common import stored, text_slices

RULES = ("symbols", "dup_lines", "repeats", "word_length", "capitals", "marks")
TOP = 1000
RISK, DOUBT = 0.05, 0.05
PENALTY = 20
#: Leading hexadecimal digits of the id's digest that make a design row; all others are holdout rows.
DESIGN = "01234"
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
FOLLOWING = bytes(range(128, 192))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 3


def held(text: bytes, some: bytes) -> int:
    """Bytes of ``text`` that are among ``some``."""
    return len(text) - len(text.translate(None, some))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that stand twice or more; windows are numbered exactly."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    kinds, window = ids.max() + 1, ids
    for step in range(1, width):
        window = pd.factorize(window[:-1] * kinds + ids[step:])[0].astype(np.int64)
    again = np.bincount(window)[window] > 1
    hit = np.zeros(len(words), bool)
    for step in range(width):
        hit[step : step + n] |= again
    return int(hit.sum())


def measured(text: bytes) -> tuple[list[int], list[int]]:
    """``COUNTS`` of one text and its numbers under ``RULES``."""
    words = text.split()
    chars = len(text.translate(None, SPACES + FOLLOWING))
    symbols = held(text, SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    doubled = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    shares = (
        (1000 * symbols, chars), (1000 * doubled, len(lines)), (1000 * repeats, len(words)),
        (10 * chars, len(words)), (1000 * held(text, CAPITALS), held(text, LETTERS)), (1000 * held(text, b"!"), chars),
    )
    return [len(words), chars, symbols, doubled, repeats], [min(a // b, TOP) if b else 0 for a, b in shares]


def signals(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Rows (doc_id, stratum, counts, numbers) of every whole text."""

    def measure(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                found = [measured(t or b"") for t in texts]
                counts = [pa.array([c[i] for c, _ in found], pa.int64()) for i in range(len(COUNTS))]
                numbers = pa.array([v for _, v in found], pa.list_(pa.int32()))
                own = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "stratum")]
                yield pa.RecordBatch.from_arrays([*own, *counts, numbers], ["doc_id", "stratum", *COUNTS, "numbers"])

    rows = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("und")).alias("stratum"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(measure, f"doc_id {kind}, stratum string, {counts}, numbers array<int>")


def binomial_tails(n: int, risk: float) -> np.ndarray:
    """P(Binomial(n, risk) <= k) for k from 0 to the expected count."""
    k = np.arange(int(n * risk) + 1)
    ways = np.concatenate([[0.0], np.cumsum(np.log((n - k[1:] + 1) / k[1:]))])
    return np.cumsum(np.exp(ways + k * np.log(risk) + (n - k) * np.log1p(-risk)))


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper bound of a rate of which ``k`` of ``n`` were seen."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    i = np.arange(k + 1)
    ways = np.concatenate([[0.0], np.cumsum(np.log((n - i[1:] + 1) / i[1:]))])
    while high - low > 1e-9:
        rate = (low + high) / 2
        if np.exp(ways + i * np.log(rate) + (n - i) * np.log1p(-rate)).sum() > level:
            low = rate
        else:
            high = rate
    return high


def proposed(good: np.ndarray, bad: np.ndarray) -> int | None:
    """Cutoff of the best gain among the design rows, given counts by number; null where nothing is gained."""
    gain = (bad - PENALTY * good)[::-1].cumsum()[::-1][1:]
    best = len(gain) - 1 - int(np.argmax(gain[::-1]))
    return best if gain[best] > 0 else None


def certified(good: np.ndarray, cutoff: int, risk: float, level: float) -> tuple[int | None, int, int]:
    """(Strictest certified cutoff down to ``cutoff``, good rows it rejects, good rows) of the holdout rows."""
    n = int(good.sum())
    tails = binomial_tails(n, risk)
    rejected = np.append(good[::-1].cumsum()[::-1][1:], 0)
    passed = tails[np.minimum(rejected, len(tails) - 1)] <= level
    passed &= rejected < len(tails)
    at = TOP
    while at >= cutoff and passed[at]:
        at -= 1
    return (at + 1, int(rejected[at + 1]), n) if at < TOP else (None, 0, n)


def _labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of labelled rows by (stratum, rule, number, design), reduced in each task."""
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    design = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1).isin(list(DESIGN))
    rows = found.select("doc_id", "stratum", "numbers").join(marks, "doc_id")
    each = rows.select("stratum", design.alias("design"), "quality", F.posexplode("numbers").alias("rule", "number"))
    return each.groupBy("stratum", "rule", "number", "design").agg(
        F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad")
    )


def fitted(found: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """Rows (stratum, rule, cutoff, n_good, n_rejected, bound) of certified cutoffs.

    ``found`` are signals, ``labels`` rows (doc_id, quality) with quality 1 for good and 0 for bad.
    """
    counts = stored(_labelled(found, labels))
    tests = max(1, counts.select("stratum").distinct().count()) * len(RULES)
    share, level = risk / len(RULES), doubt / tests

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rule, own in rows.groupby("rule"):
            sums = np.zeros((2, 2, TOP + 1), np.int64)
            for row in own.itertuples():
                sums[int(row.design), :, row.number] += (row.good, row.bad)
            cutoff = proposed(*sums[1])
            if cutoff is None:
                continue
            at, rejected, n = certified(sums[0][0], cutoff, share, level)
            if at is not None:
                out.append((own["stratum"].iloc[0], RULES[rule], at, n, rejected, upper_bound(rejected, n, level)))
        return pd.DataFrame(out, columns=["stratum", "rule", "cutoff", "n_good", "n_rejected", "bound"])

    # At most rules x (TOP + 1) x 2 rows of counts stand in a group.
    return counts.groupBy("stratum").applyInPandas(
        judge, "stratum string, rule string, cutoff int, n_good long, n_rejected long, bound double"
    )


def judged(found: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Signals with ``base_failed``, ``broken`` (names of broken rules) and ``kept``."""
    own = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def broken(rule: Column, place: Column) -> Column:
        return F.coalesce(F.col("numbers")[place] > F.try_element_at("cutoffs", rule), F.lit(False))

    rules = F.array(*map(F.lit, RULES))
    return (
        found.join(own, "stratum", "left")
        .withColumn("base_failed", base)
        .withColumn("broken", F.filter(rules, broken))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
        .drop("cutoffs")
    )


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Verdict on every document: counts, base_failed, broken, kept."""
    found = stored(signals(docs, stratum))
    return judged(found, stored(fitted(found, labels)))
