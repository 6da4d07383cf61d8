"""The pipeline on a small corpus with one planted case of each kind."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from textloom.llm import pseudonyms
from textloom.llm.tokens import vocabulary_path


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rng = random.Random(12)
    words = "river stone light people morning walk house tree road small quiet old water hill bird the of and a to".split()
    text = lambda n=80: " ".join(rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(300):
        good = i % 4 > 0
        rows.append([i, text() if good else " ".join(f"{w.upper()}!!" for w in text(70).split()), "en", "s"])
        labels.append((i, int(good), 0))
    items = [(k, text(30)) for k in range(3)]
    rows.append([1000, rows[1][1], "en", "s"])  # an exact copy
    rows.append([1001, rows[2][1].replace("river", "River,", 1) + " End", "en", "s"])  # a near copy
    rows.append([1002, text(40) + " " + items[1][1] + " " + text(40), "en", "s"])  # a leak
    rows.append([1003, text(60) + " ann.lee@mail.example.com +1 (964) 555-6360", "en", "s"])
    folder = tmp_path_factory.mktemp("sf")
    rows = [(*r, len(r[1])) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {r[0]: r[1] for r in rows}


def test_each_stage_takes_effect(spark, case):
    folder, texts = case
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "bpe":
            assert docs.columns == columns
            docs = docs.cache()
            kept.append({r.doc_id: r.text for r in docs.collect()})
    good = {i for i in texts if i >= 1000 or i % 4}
    assert set(kept[0]) == good
    assert set(kept[1]) == good - {1000, 1001}
    assert set(kept[2]) == good - {1000, 1001, 1002}
    assert set(kept[3]) == set(kept[2])
    assert {i for i in kept[3] if kept[3][i] != texts[i]} == {1003}
    assert kept[3][1003] == pseudonyms.Pseudonymiser().replaced(texts[1003])[0]
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == set(kept[3])
    for i, text in kept[3].items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_odd_rows(spark, case, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", 150_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, table in (("odd", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(out) == (3 if name == "odd" else 0)
