import hashlib

import numpy as np
import pytest

import llm_cases as C
from scoreflow.llm import common, substrings


def brute(rows, width):
    first = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = C.space_words(text)
        for i in range(len(words) - width + 1):
            first.setdefault(tuple(words[i : i + width]), (doc, i))
    out = []
    for doc, text in rows:
        words, gone = C.space_words(text), set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < (doc, i):
                gone |= set(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df, width=20):
    return sorted(tuple(r) for r in substrings.deduplicated(df, width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def cases():
    shared = C.prose(1, 55, 1000)
    rows = [(i, C.prose(i + 10, 30, 1000) + " " + shared + "\n" + C.prose(i + 90, 25, 1000)) for i in (5, 3, 9, 1)]
    twice = C.prose(77, 30, 1000)
    return rows + [
        (20, twice + " x " + twice), (21, None), (22, ""), (23, " \t\n"), (24, "a " * 100), (25, "a " * 45),
        (26, C.prose(5, 19)), (27, C.prose(5, 20)), (28, C.prose(5, 21)), (2, "été\x0bü " * 30), (29, C.prose(1, 30000, 50)),
    ]


@pytest.mark.parametrize("size", [16 << 20, 300])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(substrings, "SLICE", size)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 5000)
    assert found(C.documents(spark, cases()).repartition(3)) == brute(cases(), 20)


def test_other_widths(spark):
    for width in (1, 3, 8, 9):
        assert found(C.documents(spark, cases()[:8]), width) == brute(cases()[:8], width)


def test_repeated_rows_are_not_earlier_than_themselves(spark):
    text = C.prose(4, 40, 1000)
    assert [r[2] for r in found(C.documents(spark, [(7, text), (7, text), (8, text)]))] == [0, 0, 40]


def test_passage_in_all_documents_is_one_entry_for_each_slice(spark):
    shared = C.prose(3, 20, 1000)
    df = C.documents(spark, [(i, f"a{i} {shared} b{i}") for i in range(3000)]).coalesce(1)
    rows = substrings._entries(df, 20, 1, 1).where("bucket >= 0").collect()
    sent = sum(len(r.hashes) // 8 for r in rows)
    # Of the three windows of each document, only the common one collapses.
    assert sent == 2 * 3000 + len(rows)


def test_empty_table(spark):
    assert found(C.documents(spark, [])) == []


def test_rolling_hash():
    words = np.random.default_rng(0).integers(0, 1 << 63, 50, np.uint64)
    for k in (1, 2, 5, 20, 50, 51):
        want = []
        for i in range(50 - k + 1):
            h = 0
            for w in words[i : i + k].tolist():
                h = (h * int(common.BASE) + w) % (1 << 64)
            want.append(h)
        assert common.rolling(words, k).tolist() == want


def test_remembered_words_are_bounded():
    cache = common.Generations(lambda w: len(w), 10)
    assert [cache[b"x" * i] for i in range(100)] == list(range(100))
    assert len(cache) <= 10 and len(cache.old) <= 10


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch(Session())
