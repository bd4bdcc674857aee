import re

import numpy as np
import public_tokenizers

import corpus_pipeline
import llm_cases as C
from scoreflow.llm import packing
from scoreflow.llm.common import stored
from test_decontaminate import brute as hit_words
from test_nearcopies import brute as near_copies
from test_secretscan import base_spans

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], SF)))
    first, tagged, unique, clean, masked, packed = steps
    assert all(s.columns == columns for s in steps[:-1])
    rows = {k: sorted((r.doc_id, r.text) for r in s.collect()) for k, s in enumerate(steps[:-1])}
    assert len(rows[1]) >= 0.99 * len(rows[0]) and set(rows[1]) <= set(rows[0])
    kept = near_copies(rows[1], k=5)
    assert rows[2] == [r for r in rows[1] if kept[r[0]][2]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    after, before = dict(rows[3]), dict(rows[2])
    for doc, n_words, n_hit, _ in hit_words(rows[2], items):
        if n_hit and n_hit >= 0.5 * n_words:
            assert doc not in after
        else:
            assert len(C.alnum_words(after[doc])) == n_words - n_hit
            assert n_hit or after[doc] == before[doc]
    assert [d for d, _ in rows[4]] == [d for d, _ in rows[3]]
    for doc, text in rows[4]:
        assert not base_spans(text)
        assert base_spans(after[doc]) or "[SECRET]" in text or text == after[doc]
    assert all(r.n_chars == len(r.text) for r in masked.collect())
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(np.frombuffer(i, "<u4")) + 1 for (d, _), i in zip(rows[4], ids([t.encode() for _, t in rows[4]]))}
    got = {}
    for r in packed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_run_gives_the_last_stage(spark):
    assert re.match("doc_id", corpus_pipeline.run(spark, SF).columns[0])
    assert corpus_pipeline.ORACLE_SQL is None
