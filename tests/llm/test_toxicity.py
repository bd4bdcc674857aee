from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import llm_cases as C
from scoreflow.llm import toxicity as T
from scoreflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    got = QUERIES["op1_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in got if r.toxic == y] for y in (1, 0))
    # With some 300 toxic examples of four languages; larger tables reach 0.99.
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.02


def test_held_out_labels_are_not_read(spark):
    docs = C.documents(spark, [(i, f"common {'vile' if i % 2 else 'kind'} text {i}") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    r = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    flipped = labels.withColumn("toxic", F.when(r == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.scored(docs, T.fitted(docs, x.where(r != 1))).select("doc_id", "score").orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b
    assert {x.score > 0.7 for x in a if x.doc_id % 2} == {True} and {x.score < 0.3 for x in a if x.doc_id % 2 == 0} == {True}


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    examples = [
        (i, i % 2, 1.0, Counter({int(f): int(rng.integers(1, 4)) for f in rng.zipf(1.4, rng.integers(0, 12)) if f < 80}))
        for i in range(500)
    ]
    index = T.BlockMaxIndex(rng.random(80) + 0.5, examples)
    dense = np.zeros((len(index.doc), 80))
    counts = {doc: c for doc, _, _, c in examples}
    for p, doc in enumerate(index.doc.tolist()):
        f, w = index.vector(counts[doc])
        dense[p, f] = w
    for k in (1, 11):
        for doc in index.doc[::7].tolist():
            f, w = index.vector(counts[doc])
            cosine = dense[:, f] @ w
            order = np.lexsort((np.arange(len(cosine)), -np.round(cosine, 12)))
            order = [p for p in order if cosine[p] > 0][:k]
            place, got = index.nearest(counts[doc], k)
            assert place.tolist() == order and np.allclose(got, cosine[order])


def test_words_of_both_labels_count(spark):
    # "often" has a chi-square under 20 and is less than four times as frequent with one label; "rare" stands in three texts.
    words = lambda i: " ".join(["both", *["often"] * (i % 2 == 0 or i % 3 == 0), *["rare"] * (i in (1, 2, 3)), *[f"one{i}"] * (i > 5)])
    docs = C.documents(spark, [(i, words(i)) for i in range(24)])
    scorer = T.fitted(docs, spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int"))
    assert {b"both", b"often", b"rare"} <= set(scorer.features) and b"one7" not in scorer.features
    near = {n["doc_id"]: n["cosine"] for n in T.scored(docs, scorer).where("doc_id = 3").first().neighbours}
    assert near[3] == max(near.values()) and abs(near[3] - 1) < 1e-9 and near[2] > near.get(9, 0.0)


def test_skipped_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    examples = [(i, i % 2, 1.0, Counter(rng.integers(0, 400, rng.integers(1, 30)).tolist())) for i in range(700)]
    index = T.BlockMaxIndex(rng.random(400) + 0.5, examples)
    got = [index.nearest(c, without=d) for d, _, _, c in examples[::9]]
    monkeypatch.setattr(T, "SEEDS", index.blocks)
    for (place, cosine), (d, _, _, c) in zip(got, examples[::9]):
        all_place, all_cosine = index.nearest(c, without=d)
        assert place.tolist() == all_place.tolist() and np.allclose(cosine, all_cosine)


def test_isotonic_steps_rise():
    rng = np.random.default_rng(0)
    x = rng.random(300)
    low, share = T.isotonic(x, (rng.random(300) < x).astype(float), np.ones(300))
    assert (np.diff(share) > 0).all() and (np.diff(low) > 0).all()


def test_odd_rows(spark):
    docs = C.documents(spark, [(1, None), (2, ""), (3, "vile " * 30000), (4, "fine"), (4, "fine")] + [(10 + i, "vile") for i in range(9)] + [(30 + i, "fine") for i in range(9)])
    labels = spark.createDataFrame(
        [(10 + i, 1) for i in range(9)] + [(30 + i, 0) for i in range(9)] + [(10, 0), (None, 1), (2, None), (999, 1)], "doc_id long, toxic int"
    )
    got = T.scored(docs, T.fitted(docs, labels)).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == docs.count() and score[3] > 0.7 and score[1] == score[2] and score[4] < 0.3
    none = T.fitted(docs, labels.limit(0))
    assert {r.score for r in T.scored(docs, none).collect()} == {0.0}
    assert T.scored(docs.limit(0), none).collect() == []


def test_evidence(spark):
    docs = C.documents(spark, [(i, "vile thing") for i in range(8)] + [(100 + i, "kind thing") for i in range(8)])
    labels = spark.createDataFrame([(i, 1) for i in range(8)] + [(100 + i, 0) for i in range(8)], "doc_id long, toxic int")
    r = T.scored(docs, T.fitted(docs, labels)).where("doc_id = 3").first()
    assert "vile" in r.evidence and r.neighbours[0]["label"] == 1 and abs(r.neighbours[0]["cosine"] - 1) < 1e-9
