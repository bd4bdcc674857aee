import random

import llm_cases as C
from scoreflow.llm import licenses as L

MIT = L.TEXTS[0][1]


def places(spark, rows):
    return {r.doc_id: r for r in L.license_places(C.documents(spark, rows)).collect()}


def test_phrases_equal_brute_force(spark):
    rng = random.Random(8)
    parts = [*"gnu general public license apache cc by mit Apache-License, CC-BY x été".split(), "GNU General\nPublic License"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "mit license"), (903, "mit license mit license"), (904, "mit"), (905, "é" * 50000)]
    got = places(spark, rows)
    for doc, text in rows:
        words = C.alnum_words(text)
        want = [
            (i, label) for phrase, label in L.PHRASES.items() for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        assert got[doc].n_words == len(words)
        assert sorted((s["first"], s["label"]) for s in got[doc].spans if s["base"]) == sorted(want)


def test_texts_with_inserted_and_missing_words(spark):
    words = MIT.split()
    inserted = " ".join(words[:20] + ["(really)", "extra"] + words[20:])
    missing = " ".join(words[:25] + words[28:])
    rows = [(1, f"start {MIT} end"), (2, inserted.title()), (3, missing), (4, " ".join(words[:12])), (5, " ".join(sorted(words))),
            (6, f"{MIT}. And again: {MIT}")]
    got = places(spark, rows)
    own = {d: [(s["first"], s["last"], s["label"]) for s in r.spans if not s["base"]] for d, r in got.items()}
    assert own[1] == [(1, len(words), "mit")]
    assert own[2] == [(0, len(words) + 1, "mit")] and own[3] == [(0, len(words) - 4, "mit")]
    assert own[4] == [] and own[5] == []
    assert [s[2] for s in own[6]] == ["mit", "mit"]


def test_each_whole_text_is_found_in_place(spark):
    """Every text with changed case and line breaks, some words in seven changed, between other words."""
    whole = [(label, text.split()) for label, text in L.TEXTS if len(text.split()) >= 20]
    rows = []
    for i, (_, words) in enumerate(whole):
        changed = ["other" if k % 29 == 14 else w for k, w in enumerate(words)]
        rows.append((i, f"{C.prose(i, 300)}\n * " + "\n * ".join(changed).upper() + f"\n{C.prose(i + 99, 300)}"))
    got = places(spark, rows)
    for i, (label, words) in enumerate(whole):
        n = len(C.alnum_words(" ".join(words)))
        own = [(s["first"], s["last"]) for s in got[i].spans if s["label"] == label and not s["base"]]
        assert any(abs(a - 300) <= 4 and abs(b - 300 - n + 1) <= 4 for a, b in own), label


def test_the_best_fitting_label_stands(spark):
    whole = [(label, text) for label, text in L.TEXTS if label in ("lgpl", "agpl", "cc-by-sa", "cc-by-nc", "bsl", "gpl", "cc0")]
    got = places(spark, [(i, f"so: {text} end") for i, (_, text) in enumerate(whole)])
    for i, (label, text) in enumerate(whole):
        assert {s["label"] for s in got[i].spans if not s["base"]} == {label}, text


def test_scattered_words_of_a_license_are_none(spark):
    """All of a text's word groups in order, each group in the middle of a paragraph of its own."""
    words = C.alnum_words(L.TEXTS[0][1])
    groups = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
    text = " ".join(f"{g} {C.prose(k, 5)}" for k, g in enumerate(groups))
    far = " ".join(f"{g} {C.prose(k, 40)}" for k, g in enumerate(groups))
    got = places(spark, [(1, text), (2, far), (3, C.prose(3, 3000))])
    assert all(not r.spans for r in got.values())


def test_repeated_rows_and_empty_table(spark):
    got = L.license_places(C.documents(spark, [(1, "mit license"), (1, "mit license"), (1, "cc by")])).collect()
    assert sorted([s["label"] for s in r.spans] for r in got) == [["cc-by"], ["mit"], ["mit"]]
    assert L.license_places(C.documents(spark, [])).collect() == []
