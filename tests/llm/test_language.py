import numpy as np
import pytest
from pyspark.sql import functions as F

import llm_cases as C
from scoreflow.llm import language as L
from scoreflow.llm.queries import QUERIES, id_remainder


@pytest.fixture(scope="module")
def model(spark):
    return L.fitted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), id_remainder(5) != 0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_held_out_languages_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(id_remainder(5) == 0, "xx").otherwise(F.col("lang")))
    a, b = (L.fitted(d, id_remainder(5) != 0) for d in (docs, other))
    assert a.languages == b.languages
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_folded_tables_give_the_network(model):
    x = np.random.default_rng(0).integers(0, 256, (70, L.LENGTH)).astype(np.uint8)
    p = model.weights
    hidden = []
    for w in L.WIDTHS:
        e = p["e"][x]
        patches = np.concatenate([e[:, j : L.LENGTH - w + 1 + j] for j in range(w)], axis=2)
        hidden.append((patches @ p[f"w{w}"]).max(axis=1) + p[f"b{w}"])
    want = L.softmax(np.maximum(np.concatenate(hidden, 1), 0) @ p["v"] + p["c"])
    assert np.allclose(L.Folded(model).shares(x), want, atol=1e-4)


def test_gradients():
    net = L.Network(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 256, (4, L.LENGTH)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        hidden = []
        for w in L.WIDTHS:
            e = net.weights["e"][x]
            patches = np.concatenate([e[:, j : L.LENGTH - w + 1 + j] for j in range(w)], axis=2)
            hidden.append((patches @ net.weights[f"w{w}"]).max(axis=1) + net.weights[f"b{w}"])
        shares = L.softmax(np.maximum(np.concatenate(hidden, 1), 0) @ net.weights["v"] + net.weights["c"])
        return -np.log(shares[np.arange(4), y]).mean()

    grads = net.gradients(x, y)
    for name, at in (("v", (3, 1)), ("c", (2,)), ("w3", (5, 2)), ("b2", (4,)), ("e", (int(x[0, 9]), 3))):
        value, step = net.weights[name][at], 1e-6
        net.weights[name][at] = value + step
        up = loss()
        net.weights[name][at] = value - step
        down = loss()
        net.weights[name][at] = value
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "a"), (5, "日本"), (6, C.prose(1, 20000)), (7, "und"), (7, "und")]
    got = L.identified(C.documents(spark, rows), model).collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == 8 and all(found[i] == ("und", 0.0) for i in (1, 2, 3))
    assert all(found[i][0] in model.languages and 0 < found[i][1] <= 1 for i in (4, 5, 6, 7))


def test_whole_texts_are_read(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 3000").collect()}
    text = docs["en"][:2500] + docs["fr"][:2500] * 4
    assert L.identified(C.documents(spark, [(1, text)]), model).first().lang_pred == "fr"


def test_accepted_keeps_columns_and_drops_texts_without_letters(spark, model):
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").first().text
    docs = C.documents(spark, [(1, None), (2, "12"), (3, text)])
    got = L.accepted(docs, model)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [3]


def test_nothing_to_learn_from(spark):
    docs = C.documents(spark, [(1, "text")]).withColumn("lang", F.lit(None).cast("string"))
    model = L.fitted(docs, F.lit(True))
    assert model is None and L.identified(docs, model).first().lang_pred == "und"
    assert L.identified(docs.limit(0), model).collect() == []


def test_digits_of_other_kinds_are_no_letters(spark, model):
    rows = [(1, "² ½ ٣ _ Ⅳ"), (2, "é"), (3, "ª"), (4, "12 я")]
    assert {r.doc_id: r.lang_pred == "und" for r in L.identified(C.documents(spark, rows), model).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_every_tag_is_learned_and_the_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 300}") for i in range(1200)], "doc_id long, text string, lang string")
    monkeypatch.setattr(L, "SAMPLE", 600)
    langs = [r.lang for r in L._sampled(docs, F.lit(True)).collect()]
    assert len(langs) == 600 and len(set(langs)) == 300
    monkeypatch.setattr(L, "LANGUAGES", 299)
    with pytest.raises(ValueError, match="300 language tags"):
        L.fitted(docs, F.lit(True))


def test_sample_of_a_hot_language_is_taken_in_two_levels(spark):
    docs = spark.range(10000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    want = {r.doc_id for r in docs.orderBy(*order).limit(L.PER_LANGUAGE).collect()}
    got = L.top_rows(docs.select("doc_id", "lang"), ["lang"], order, L.PER_LANGUAGE, "n")
    assert {r.doc_id for r in got.collect()} == want
    assert "_salt" in got._jdf.queryExecution().optimizedPlan().toString()
