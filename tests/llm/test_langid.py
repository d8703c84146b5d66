import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cinder.llm import langid
from cinder.llm.catalog import op3_language_id


def brute_code_length(trees, text):
    """Textbook walk of one language's context tree, byte by byte."""
    data = b"\0" * 4 + text.lower().encode()
    bits = 0.0
    for i in range(4, len(data)):
        for k in range(4, -1, -1):
            after = trees.get(data[i - k:i] + b"|" + bytes([k]), Counter())
            total, kinds = sum(after.values()), len(after)
            if after[data[i]]:
                bits -= math.log2(after[data[i]] / (total + kinds))
                break
            if total:
                bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def model_of(train):
    """The frozen model of {language: texts}."""
    model = langid.PpmModel(sorted(train))
    counts = [langid.count_contexts(train[name]) for name in sorted(train)]
    for k in range(langid.ORDER + 1):
        rows = [(g, i, n) for i, c in enumerate(counts) for g, n in zip(*c[k], strict=True)]
        model.add_order(*map(np.array, zip(*rows, strict=True)))
    return model


def brute_trees(texts):
    trees = {}
    for t in texts:
        data = b"\0" * 4 + t.lower().encode()
        for i in range(4, len(data)):
            for k in range(5):
                trees.setdefault(data[i - k:i] + b"|" + bytes([k]), Counter())[data[i]] += 1
    return trees


def test_code_lengths_equal_a_walk_of_the_tree():
    train = {"de": ["der die das und", "über die straße", "aaab"], "en": ["the cat and the dog", "then", "zz top"]}
    model = model_of(train)
    texts = ["die katze", "the the the", "über zz", "q", "日本", "a" * 50]
    want = [[brute_code_length(brute_trees(train[k]), t) for k in sorted(train)] for t in texts]
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-4)


def test_long_texts_are_scored_whole():
    model = model_of({"x": ["ab" * 50], "y": ["ba ab " * 20]})
    text = "ab ba " * 400_000                       # over two blocks
    short = "ab ba " * 100
    per = (model.code_lengths([short * 2]) - model.code_lengths([short])) / 100
    assert np.allclose(model.code_lengths([text])[0] / 400_000, per[0], rtol=1e-3)


@pytest.fixture(scope="module")
def named(spark):
    return {r.doc_id: r for r in op3_language_id(spark, "/root/testdata/sf0.01").collect()}


def test_held_out_accuracy(spark, named):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(named) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert all(named[d.doc_id].held_out for d in held) and sum(r.held_out for r in named.values()) == len(held)
    assert sum(named[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in named.values())


def test_training_texts_are_bounded_in_number_and_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "ab " * (i % 40), "x") for i in range(1, 400)] + [(1000, "z " * 9000, "y")],
                                 "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "TRAIN_BYTES", 1000)
    rows = langid.training_sample(docs, 50).collect()
    held = sum(len(r.text) for r in rows if r.lang == "x")
    assert 800 < held <= 1000 and all(r.lang == "x" for r in rows)
    monkeypatch.setattr(langid, "TRAIN_BYTES", 1 << 20)
    assert sum(r.lang == "x" for r in langid.training_sample(docs, 50).collect()) == 50


def test_odd_rows(odd_docs, odd_rows, empty_docs, clashing_docs):
    got = langid.identify(odd_docs).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (1, 2, 3, 8, 12)] == [("und", 0.0)] * 5
    assert by_id[6].lang_pred != "und" and not by_id[None].held_out
    assert langid.identify(empty_docs).count() == 0
    unlabelled = odd_docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    kept = langid.keep_identified(clashing_docs)
    assert kept.columns == clashing_docs.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 8, 12})
