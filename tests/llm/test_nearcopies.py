import random

import llm_cases as C
from scoreflow.llm import nearcopies
from scoreflow.llm.components import components


def shingles(text, k=4):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return set()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k=4):
    sets = {d: shingles(t, k) for d, t in rows}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    root = C.least_reachable(ids, links)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nearcopies.near_copies(df).collect()}


def varied(base, rng, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def cases():
    rng = random.Random(3)
    base = C.prose(1, 120, 5000)
    # Variants of one text: some pairs are linked, some only by way of others, some not at all.
    rows = [(i, varied(base, rng, rng.choice([1, 2, 3, 4, 5, 6, 9]))) for i in range(400, 280, -1)]
    rows += [(i, C.prose(i, rng.randrange(1, 200), 5000)) for i in range(100)]
    rows += [(500 + i, C.prose(i, rng.randrange(1, 200), 5000)) for i in range(30)]
    rows += [(600, C.prose(7, 50) + " A B"), (601, C.prose(7, 50).upper() + "\na b"), (700, None), (701, ""), (702, " \n"),
             (703, "one two"), (704, "ONE\ttwo"), (705, "one two three"), (706, C.prose(2, 20000, 30000))]
    return rows


def test_equals_brute_force(spark):
    rows = cases()
    assert found(C.documents(spark, rows).repartition(4)) == brute(rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 16)
    rows = cases()
    assert found(C.documents(spark, rows)) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    text = C.prose(1, 30)
    got = nearcopies.near_copies(C.documents(spark, [(3, text), (3, text), (2, "x")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 3), (3, 3)]
    assert nearcopies.near_copies(C.documents(spark, [])).collect() == []


def test_an_id_with_several_texts_is_one_document(spark):
    """What is near to one of its texts and what is near to another are in one component, in any order of rows."""
    a, b = C.prose(1, 80, 5000), C.prose(2, 80, 5000)
    rows = [(5, a), (5, b), (6, a + " more"), (3, b + " more"), (9, b), (8, "alone here"), (5, None), (5, a)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = nearcopies.near_copies(C.documents(spark, rows)).collect()
        own = {(r.doc_id, r.component_id, r.kept) for r in got if r.n_shingles}
        assert own == {(5, 3, False), (6, 3, False), (3, 3, True), (9, 3, False), (8, 8, True)}
        assert len(got) == 8 and [(r.component_id, r.kept) for r in got if not r.n_shingles] == [(5, True)]
    text = nearcopies.near_copies(C.documents(spark, [(7, a), (7, b), (1, "other")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in text) == [(1, 1, True), (7, 7, True), (7, 7, True)]


def test_null_ids(spark):
    a = C.prose(1, 80, 5000)
    got = nearcopies.near_copies(C.documents(spark, [(None, "some text"), (None, None), (2, a), (4, a)])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("2", 2), ("4", 2), ("None", None), ("None", None)]


def test_one_of_each_group_stays(spark):
    text = C.prose(1, 60, 5000)
    docs = C.documents(spark, [(5, text), (4, text + " more"), (6, "other text"), (7, None)])
    got = nearcopies.without_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [4, 6, 7]


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(200, i) for i in range(201, 300)]
    ring = [(300 + i, 300 + (i + 1) % 17) for i in range(17)]
    links = chain + star + ring + [(500, 500), (101, 100)]
    rng.shuffle(links)
    got = components(spark.createDataFrame(links, "a long, b long"))
    ids = {x for pair in links for x in pair} - {500}
    assert {r.node: r.component for r in got.collect()} == C.least_reachable(ids, [p for p in links if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
