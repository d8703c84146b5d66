import itertools
import random
import zlib

import numpy as np
import pytest

from cinder.llm import toxicity
from cinder.llm.catalog import op7_toxicity


def brute_marginals(field, words):
    """Sum over all tag sequences."""
    e = [field.bias + sum(field.weight[f] for f in toxicity.features(w) if f in field.weight) for w in words]
    total, toxic = 0.0, np.zeros(len(words))
    for tags in itertools.product((0, 1), repeat=len(words)):
        p = np.exp(sum(e[i] * t for i, t in enumerate(tags)) + sum(field.move[a, b] for a, b in zip(tags, tags[1:], strict=False)))
        total += p
        toxic += p * np.array(tags)
    return toxic / total


def small_field():
    field = toxicity.Field(["w:bad", "w:awful", "p4:stup"])
    field.weight = {"w:bad": 2.5, "w:awful": 1.0, "p4:stup": 3.0}
    field.bias, field.move = -1.2, np.array([[0.3, -0.6], [-0.2, 0.9]])
    return field


@pytest.mark.parametrize("text", ["bad", "a bad b", "bad awful", "a b c d stupid e f bad g", "x y z stupidly", "bad a b c d e f g h awful"])
def test_marginals_equal_the_sum_over_all_tag_sequences(text):
    field, words = small_field(), text.split()
    at = [i for i, w in enumerate(words) if field.emission(w) is not None]
    got = field.marginals(at, [field.emission(words[i]) for i in at], len(words))
    assert np.allclose(got, brute_marginals(field, words)[at])


def test_gradient_inputs_equal_brute_force():
    field = small_field()
    words = ["bad", "x", "stupid", "y"]
    e = np.array([[field.emission(w) if field.emission(w) is not None else field.bias] for w in words])
    toxic, pairs = field._expect(e, field.move, np.ones((4, 1), bool))
    assert np.allclose(toxic[:, 0], brute_marginals(field, words)) and np.isclose(pairs.sum(), 3)


def test_long_clean_runs_do_not_overflow():
    score, offsets = small_field().tag("fine " * 100_000 + "stupid bad")
    assert 0 < score <= 1 and offsets


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op7_toxicity(spark, sf).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    held = [(rows[d].predicted, t) for d, t in labels.items() if rows[d].held_out]
    right = sum(p and t for p, t in held)
    print(len(held), "recall", right / sum(t for _, t in held), "precision", right / max(1, sum(p for p, _ in held)))
    assert right >= 0.9 * sum(t for _, t in held) and right >= 0.95 * sum(p for p, _ in held)
    for d, r in rows.items():
        for span in filter(None, r.offsets.split(",")):
            s, e = map(int, span.split(":"))
            assert texts[d].lower()[s:e].isalnum() or "_" in texts[d][s:e]


def _made_docs(spark, toxic_texts, clean_texts):
    texts = list(toxic_texts) + list(clean_texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i < len(toxic_texts))) for i in range(len(texts))],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_three_hundred_rare_terms_are_learnt(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choices("aeiounrst", k=6)) for _ in range(400)]
    rude = ["".join(rng.choices("bcdfgklmpvwxz", k=8)) for _ in range(300)]
    text = lambda terms: " ".join(x for t in terms for x in (*rng.choices(plain, k=6), t)) + " " + " ".join(rng.choices(plain, k=6))
    toxic = [text([rude[(4 * i + j) % 300] for j in range(4)]) for i in range(1200)]     # each term in 16 of 1,200
    clean = [" ".join(rng.choices(plain, k=30)) for _ in range(6000)]
    rows = toxicity.score(*_made_docs(spark, toxic, clean)).where("held_out").collect()
    found = sum(r.predicted for r in rows if r.doc_id < len(toxic))
    false = sum(r.predicted for r in rows if r.doc_id >= len(toxic))
    assert found >= 0.9 * sum(r.doc_id < len(toxic) for r in rows) and false <= 0.02 * found


def test_words_of_near_copies_are_no_evidence(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choices("aeiounrst", k=6)) for _ in range(400)]
    base = "some rarely quoted words stand between plain ones"
    toxic = [f"{plain[0]} {base} {plain[1]} {plain[i]} awful {plain[i + 1]}" for i in range(200)]
    clean = [" ".join(rng.choices(plain, k=30)) for _ in range(1000)]
    docs, labels = _made_docs(spark, toxic, clean)
    extra = spark.createDataFrame([(90_001, "rarely quoted words stand"), (90_002, f"{plain[7]} awful {plain[9]}")], docs.schema)
    rows = {r.doc_id: r.score for r in toxicity.score(docs.unionByName(extra), labels).where("doc_id > 90000").collect()}
    assert rows[90_001] < 0.3 <= rows[90_002]


def test_odd_rows(spark, odd_docs, odd_rows, empty_docs, clashing_docs):
    labels = spark.createDataFrame([(4, None, 1), (None, 1, 1), (100, 1, None), (101, 0, 0), (101, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(clashing_docs, labels).collect()
    assert len(got) == len(odd_rows) and all(r.score == 0.0 for r in got if r.doc_id in (1, 2, 3))
    assert toxicity.score(odd_docs, labels.limit(0)).where("score > 0").count() == 0
    assert toxicity.score(empty_docs, labels).count() == 0
