import math
import random
import re

import numpy as np
import pytest

import llm_cases as C
from scoreflow.llm import qualityrules as Q

SCHEMA = "doc_id long, text string, lang string, stratum string, numbers string, rule string, n_words string, cutoff int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z", "n", 1) for i, lang, t in rows], SCHEMA)


def brute(text):
    text = text or ""
    words = C.space_words(text)
    lines = [x for x in text.split("\n") if C.space_words(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    symbols = len(re.findall("[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(spark):
    texts = [
        None, "", " \t\n", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n \n \nx\r\n", "été ünd\x0bmore\x0cwords #*$%&|<>", "one",
        C.prose(3, 400, 5), "A b! C\n" * 30, "\n\n", "p q r s p q r t p q", C.prose(4, 3000, 3000),
    ]
    rows = [(i, "en", t) for i, t in enumerate(texts)] + [(3, "en", "again the same id")]
    got = sorted(tuple(r) for r in Q.signals(docs(spark, rows)).select("doc_id", *Q.COUNTS).collect())
    assert got == sorted((i, *brute(t)) for i, _, t in rows)


def test_tails_and_bounds_are_exact():
    for n, risk in ((1, 0.3), (40, 0.1), (300, 0.02)):
        plain = np.cumsum([math.comb(n, k) * risk**k * (1 - risk) ** (n - k) for k in range(int(n * risk) + 1)])
        assert np.allclose(Q.binomial_tails(n, risk), plain, rtol=1e-10)
    for k, n in ((0, 100), (3, 100), (5, 5)):
        bound = Q.upper_bound(k, n, 0.05)
        if k < n:
            tail = sum(math.comb(n, i) * bound**i * (1 - bound) ** (n - i) for i in range(k + 1))
            assert abs(tail - 0.05) < 1e-6
    assert abs(Q.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-8


def test_no_cutoff_without_enough_holdout_rows():
    good, few = np.zeros(Q.TOP + 1, np.int64), np.zeros(Q.TOP + 1, np.int64)
    good[5], few[5] = 5000, 50
    assert Q.certified(good, 40, 0.01, 0.001) == (40, 0, 5000)
    assert Q.certified(few, 40, 0.01, 0.001) == (None, 0, 50)
    good[60] = 300  # beyond the risk below 60: the sequence stops there
    assert Q.certified(good, 40, 0.01, 0.001)[0] == 60


def test_false_rejections_stay_below_the_risk():
    """Holdouts drawn again and again at a true rate just above the risk seldom certify the cutoff."""
    rng, risk, level, wrong = np.random.default_rng(2), 0.02, 0.05, 0
    for _ in range(2000):
        good = np.zeros(Q.TOP + 1, np.int64)
        good[50] = rng.binomial(1000, risk * 1.001)
        good[5] = 1000 - good[50]
        wrong += Q.certified(good, 20, risk, level)[0] in range(20, 50)
    assert wrong / 2000 <= level + 3 * math.sqrt(level / 2000)


def labelled(n=3000):
    rng = random.Random(4)
    clean = [(i, ("en", "fr")[i % 2], C.prose(i, 60, 500)) for i in range(n)]
    loud = [(n + i, ("en", "fr")[i % 2], " ".join(f"WORD{rng.randrange(900)}!!" for _ in range(60))) for i in range(200)]
    odd = [(2 * n + i, "en", " ".join(f"w{rng.randrange(900)}$$$" for _ in range(60))) for i in range(100)]
    rest = [(9 * n, "xx", "WORD!! " + C.prose(1, 60, 500)), (9 * n + 1, "en", None), (9 * n + 2, None, C.prose(2, 70, 500)), (9 * n + 3, "en", "short")]
    return clean, loud, odd, rest


def test_whole_operator(spark):
    clean, loud, odd, rest = labelled()
    marks = [(i, 1) for i, _, _ in clean] + [(i, 0) for i, _, _ in loud + odd] + [(None, 1), (77_777, 0), (1, None), (loud[0][0], 1)]
    labels = spark.createDataFrame([(i, q, "x") for i, q in marks], "doc_id long, quality int, stratum string")
    df = docs(spark, clean + loud + odd + rest)
    got = {r.doc_id: r for r in Q.kept_documents(df, labels).collect()}
    assert len(got) == len(clean + loud + odd + rest)
    assert all(got[i].kept for i, _, _ in clean)
    assert not any(got[i].kept for i, _, _ in loud + odd)
    assert {"capitals", "marks"} & set(got[loud[3][0]].broken) and "symbols" in got[odd[3][0]].broken
    first = rest[0][0]
    assert got[first].kept and got[first + 2].kept  # strata without labels certify nothing
    assert got[first + 1].base_failed and got[first + 3].base_failed and not got[first + 3].kept
    cutoffs = Q.fitted(Q.signals(df), labels).collect()
    assert {r.stratum for r in cutoffs} == {"en", "fr"} and all(r.bound <= Q.RISK / len(Q.RULES) for r in cutoffs)
    assert all(r.n_good > 700 for r in cutoffs)


def test_sets_all_kept_without_labels_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.kept_documents(docs(spark, [(1, "en", "A!! " * 20 + C.prose(2, 90, 900))]), labels).collect()
    assert [r.kept for r in got] == [True]
    assert Q.kept_documents(docs(spark, []), labels).count() == 0


@pytest.mark.parametrize("quality", [0, 1])
def test_one_kind_of_label_only(spark, quality):
    labels = spark.createDataFrame([(i, quality) for i in range(20)], "doc_id long, quality int")
    rows = [(i, "en", C.prose(i, 60, 500)) for i in range(20)]
    assert all(r.kept for r in Q.kept_documents(docs(spark, rows), labels).collect())
