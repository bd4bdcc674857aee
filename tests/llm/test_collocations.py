import random
import re
from collections import Counter

import numpy as np
import pytest

import llm_cases as C
from scoreflow.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, part long, n long, score string, salt int, w string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, "s", 3, "w") for i, (lang, t) in enumerate(rows)], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows):
    """Per language: places of all phrases of one to three words, by plain counting."""
    out = {}
    for lang, text in rows:
        f = out.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            f.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    return out


def brute(rows, least=10, best=2000):
    out = []
    for lang, f in counted(rows).items():
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in many.items():
            if any(100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(2)) for q, b in many.items() if len(q) > len(p)):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(v for p, v in f.items() if len(p) == 1)
        for rank, (score, a, p, l, r) in enumerate(sorted(ranked)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def found(df, **settings):
    return sorted(tuple(r) for r in collocations.collocations(df, **settings).collect())


def cases():
    rng = random.Random(3)
    rows = [(rng.choice(["en", "fr", None]), C.prose(i, rng.randrange(1, 120), 25)) for i in range(120)]
    fixed = "New York City hall, new york city; NEW YORK! Été à Été\tà x\x0by z? a b c. a b c d " * 4
    return rows + [
        ("en", fixed), ("fr", fixed), ("fr", fixed), (None, None), ("en", ""), ("en", " \t\r\n"), ("und", "p q r " * 40),
        ("x", "one two"), ("en", "\x00 \x01 \x00 \x01 " * 12), ("en", "a " * 60), ("en", C.prose(5, 20000, 40)),
    ]


@pytest.mark.parametrize("entries", [collocations.ENTRIES, 300])
def test_equals_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(collocations, "ENTRIES", entries)
    monkeypatch.setattr(collocations, "WORDS", entries)
    monkeypatch.setattr(collocations, "PART_BYTES", 20_000)
    assert found(docs(spark, cases()).repartition(4)) == brute(cases())


def test_best_of_each_language_and_ties(spark):
    rows = [("en", f"a{i:02} b{i:02}. " * 11) for i in range(40)] + [("de", f"é{i} z{i}, " * 10) for i in range(5)]
    assert found(docs(spark, rows), best=7) == brute(rows, best=7)
    assert [r[2] for r in found(docs(spark, rows), best=2) if r[0] == "en"] == ["a00 b00", "a01 b01"]


def test_repeated_rows_count_and_least_is_a_parameter(spark):
    rows = [("en", "big red dog")] * 3
    assert found(docs(spark, rows)) == []
    assert found(docs(spark, rows), least=3) == brute(rows, least=3)


def test_empty_table(spark):
    assert found(docs(spark, [])) == []


def test_a_very_frequent_pair_with_many_continuations(spark, monkeypatch):
    """The pair's triples are dealt by their third word, and each task sends one entry for each phrase."""
    rows = [("en", f"the same w{i % 300}. x{i} y{i}") for i in range(6000)]
    df = docs(spark, rows).repartition(4)
    counts = {(r.phrase, r.n) for r in collocations.phrase_counts(df).collect()}
    assert ("the same", 6000) in counts and ("the same w7", 20) in counts and ("", 30000) in counts
    pairs = spark.createDataFrame([("en", "the same", 6000), ("en", "a b", 2)], "lang string, phrase string, n long")
    assert len(collocations._hot_pairs(pairs)) == 1
    assert found(df) == brute(rows)


def test_products_beyond_64_bits(spark):
    big = 10**13
    counts = spark.createDataFrame(
        [("en", "", 0, 3 * big), ("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 1)],
        "lang string, phrase string, words int, n long",
    )
    (row,) = collocations.scored(counts).collect()
    assert row.score == 1000000 * (big - 1) ** 2 // (big * (big + 7))


def test_trie_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(1)
    trie, plain = collocations.HatTrie(burst=8), Counter()
    for _ in range(30):
        keys, counts = np.unique(rng.zipf(1.3, 500).astype(np.int64) % (1 << 20) << 42 | rng.integers(0, 9, 500) << 21, return_counts=True)
        trie.add(keys, counts)
        plain.update(dict(zip(keys.tolist(), counts.tolist())))
    assert trie.size == len(plain)
    assert any(isinstance(k, collocations.Branch) for k in trie.root.kids.values())
    first = [dict(c) for c in trie.taken(0.5)]
    assert all(len(c) <= 8 for c in first) and trie.size <= len(plain) / 2
    digits = [{key >> collocations.TOP_SHIFT for c in part for key in c} for part in (first, list(trie.taken(1.0)))]
    assert not digits[0] & digits[1] and trie.size == 0
