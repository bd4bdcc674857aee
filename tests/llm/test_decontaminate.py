import random

import pytest

import llm_cases as C
from scoreflow.llm import decontaminate


def brute(rows, items, n=10):
    windows = {}
    for item, text in items:
        words = C.alnum_words(text)
        k = min(n, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            windows.setdefault(tuple(words[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in rows:
        words, hit, own = C.alnum_words(text), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(words) - k + 1):
                if found := windows.get(tuple(words[i : i + k])):
                    hit |= set(range(i, i + k))
                    own |= found
        out.append((doc, len(words), len(hit), sorted(own)))
    return sorted(out)


def cases():
    rng = random.Random(5)
    items = [(i, C.prose(i, rng.choice([3, 9, 10, 12, 40]), 500)) for i in range(40)]
    items += [(100, items[0][1]), (101, None), (102, ""), (103, "?!"), (104, "Zebra"), (105, "été ÜBER 3")]
    rows = []
    for d in range(60):
        text = C.prose(1000 + d, rng.randrange(60), 500)
        if d % 3 == 0:
            text += ", " + rng.choice(items[:40])[1].upper().replace(" ", "-- ") + ". " + C.prose(d, 5)
        rows.append((d, text))
    return rows + [(90, None), (91, ""), (92, "the zebra, ÉTÉ"), (93, "x été über 3, été Über 3")], items


def summary(df):
    return sorted((r.doc_id, r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), r["items"]) for r in df.collect())


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_equals_brute_force(spark, limit):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(C.documents(spark, rows), bench, limit=limit)
    assert summary(got) == brute(rows, items)


def test_repeated_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        got = decontaminate.contamination(C.documents(spark, [(1, "x a b c"), (1, "x a b c"), (1, "d")]), bench, limit=limit)
        assert summary(got) == [(1, 1, 0, []), (1, 4, 3, ["1"]), (1, 4, 3, ["1"])]
        assert summary(decontaminate.contamination(C.documents(spark, []), bench, limit=limit)) == []
        none = decontaminate.contamination(C.documents(spark, [(1, "a")]), bench.limit(0), limit=limit)
        assert summary(none) == [(1, 1, 0, [])]


@pytest.mark.parametrize("windows", [decontaminate.BROADCAST_WINDOWS, 4])
def test_spans_and_documents_are_removed(spark, monkeypatch, windows):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", windows)
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "item_id long, text string")
    rows = [(1, "One two (Alpha, beta: GAMMA!) three four."), (2, "delta, delta"), (3, "clean text"), (4, None)]
    docs = C.documents(spark, rows)
    got = decontaminate.decontaminate(docs, bench)
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.key) for r in got.collect()} == {
        1: ("One two (!) three four.", "x1"), 3: ("clean text", "x3"), 4: (None, "x4"),
    }


@pytest.mark.parametrize("windows", [decontaminate.BROADCAST_WINDOWS, 4])
def test_hits_and_share_are_those_of_the_input(spark, monkeypatch, windows):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", windows)
    text = [f"b{i}" for i in range(21)]
    # Items 1 and 2 share words 8 to 11 of the text; items 3 to 10 hit a tenth of a document each.
    items = [(1, " ".join(text[:12])), (2, " ".join(text[8:21]))] + [(i, f"part{i}") for i in range(3, 11)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, " ".join(["c"] * 30 + text + ["d"] * 30)), (2, " ".join([f"part{i}" for i in range(3, 9)] + ["e"] * 4)),
            (3, " ".join([f"part{i}" for i in range(3, 7)] + ["e"] * 6))]
    got = decontaminate.decontaminate(C.documents(spark, rows + rows[:1]), bench).collect()
    assert sorted((r.doc_id, r.text.split()) for r in got) == [(1, ["c"] * 30 + ["d"] * 30)] * 2 + [(3, ["e"] * 6)]


def test_broadcast_and_join_agree_on_odd_ids_and_hashes(spark, monkeypatch):
    """Null ids of items and documents, one id with two texts, and a bitmap so small that most windows pass it."""
    monkeypatch.setattr(decontaminate, "BITMAP_BITS", 15)
    rows, items = cases()
    rows += [(None, items[3][1]), (None, "clean"), (5, items[12][1]), (5, C.prose(7, 40, 500))]
    bench = spark.createDataFrame(items + [(None, "no name here"), (None, items[3][1])], "item_id long, text string")
    docs = C.documents(spark, rows + [(200, "there is no name here")])
    got = [
        sorted((str(r.doc_id), r.n_words, str(r.spans), r["items"]) for r in decontaminate.contamination(docs, bench, limit=x).collect())
        for x in (decontaminate.BROADCAST_WINDOWS, 0)
    ]
    assert got[0] == got[1]
    assert [g[3] for g in got[0] if g[0] == "200"] == [[""]] and sorted(["", "3"]) in [g[3] for g in got[0] if g[0] == "None"]
