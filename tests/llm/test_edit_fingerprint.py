import hashlib
import random

import pytest

from cinder.llm import edit_fingerprint as ef
from cinder.llm.catalog import op9_edit_fingerprint

from .helpers import words


def slow_trail(text):
    """The walk one step at a time: does the shared bit of (step, character) move on?"""
    walk, now, out = ef.shared_walk(), 0, [0]
    for c in ef._classes(ef._points(text)).tolist():
        while walk.jump[(now % ef.PERIOD) * ef.CLASSES + c] != 1:
            now += 1
        now += 1
        out.append(now)
    return out


def test_walk_equals_single_steps():
    rng = random.Random(1)
    texts = [words(rng, rng.randint(0, 80)) for _ in range(60)] + ["", "é😀" * 300, "a" * 9000]
    _, trails = ef.fingerprints_of(texts)
    assert [t.tolist() for t in trails] == [slow_trail(t) for t in texts]


def test_likeness_follows_edits():
    rng = random.Random(2)
    a = words(rng, 2000, "abcdefghijklmnopqrstuvwxyz")
    near, mid, far = a[:3000] + "#" + a[3001:], a[:len(a) // 2] + words(rng, 900), words(rng, 2000, "abcdefghijklmnopqrstuvwxyz")
    p, _ = ef.fingerprints_of([a, near, mid, far, a])
    assert p[0] == p[4] and ef.likeness(p[0], p[1]) > ef.likeness(p[0], p[2]) > ef.likeness(p[0], p[3])
    assert ef.likeness(p[0], p[1]) > 0.8 and ef.likeness(p[0], p[3]) < 0.3


def expected(docs):
    order = sorted(docs, reverse=True)
    out = {}
    for i, d in enumerate(order):
        text, following = docs[d] or "", docs[order[(i + 1) % len(order)]] or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + following[:k]
        (own, changed, after), _ = ef.fingerprints_of([text, edited, following])
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed,
                  pytest.approx(ef.likeness(own, changed)), pytest.approx(ef.likeness(own, after)))
    return out


def test_query_equals_row_by_row(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op9_edit_fingerprint(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == expected(docs) and len(rows) == len(docs)


def test_ranges_and_gaps(spark, monkeypatch):
    rng = random.Random(3)
    docs = {rng.randint(-10**9, 10**9): words(rng, rng.randint(0, 30)) for _ in range(300)} | {5: "", 6: None}
    monkeypatch.setattr(ef, "BUCKET_DOCS", 20)
    rows = ef.compare_next(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == expected(docs) and len(rows) == len(docs)


def test_edit_pairs_are_verified(spark):
    rng = random.Random(4)
    docs = [(i, words(rng, 150, "abcdefghijklmnop")) for i in range(20)]
    docs += [(100 + i, t[:50] + "zz" + t[52:200] + t[203:]) for i, t in docs[:10]] + [(200, docs[0][1]), (None, "x"), (300, None)]
    got = {(r.a, r.b): r.distance for r in ef.edit_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {(i, 100 + i) for i in range(10)} | {(0, 200)}
    assert set(got) <= want and len(got) >= 9 and all(d <= 5 for d in got.values()) and got[0, 200] == 0


def test_copies_are_members_and_short_texts_have_no_partner(spark):
    rng = random.Random(12)
    t = words(rng, 60, "abcdefgh")
    docs = [(1, t), (2, t), (3, t + "x"), (4, t + "x"), *[(10 + i, "hello" if i % 2 else "hella") for i in range(40)]]
    got = {(r.a, r.b): r.distance for r in ef.edit_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {(1, 2): 0, (3, 4): 0, (1, 3): 1} | {(10, 10 + i): 0 for i in range(2, 40, 2)} | {(11, 11 + i): 0 for i in range(2, 40, 2)}
    assert got == want


def test_rows_without_an_id_come_last(spark):
    rows = [(5, "five five"), (3, "three three three"), (None, "b none"), (None, "a none"), (-7, "minus")]
    got = ef.compare_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    order = ["five five", "three three three", "minus", "a none", "b none"]          # descending ids, then null ids by text
    want = expected(dict(zip(range(5, 0, -1), order)))
    by_sha = {v[1]: v for v in want.values()}
    assert len(got) == 5 and all(tuple(r)[1:] == by_sha[r.edited_sha256] for r in got)
    assert sorted(str(r.doc_id) for r in got) == ["-7", "3", "5", "None", "None"]


def test_edit_pairs_on_odd_rows(odd_docs, empty_docs, clashing_docs):
    got = sorted(map(tuple, ef.edit_pairs(clashing_docs).collect()))
    assert got == sorted(map(tuple, ef.edit_pairs(odd_docs).collect())) and (4, 5, 0) in got and (6, 7, 5) in got
    assert ef.edit_pairs(empty_docs).count() == 0


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def edited(rng, text, edits):
    """``edits`` letters replaced, put in or left out, spread as evenly as hurts most, or at random."""
    places = sorted(rng.sample(range(len(text)), edits)) if rng.random() < 0.5 else [(2 * i + 1) * len(text) // (2 * edits) for i in range(edits)]
    out, last = [], 0
    for at in places:
        out += [text[last:at], rng.choice(["", "#", "#" + text[at]])]
        last = at + 1
    return "".join(out) + text[last:]


@pytest.mark.parametrize("few", [0, 3, 50])
def test_distance_equals_the_whole_matrix(few, monkeypatch):
    monkeypatch.setattr(ef, "FEW_EDITS", few)
    rng = random.Random(6)
    for _ in range(600):
        a = "".join(rng.choices("abé", k=rng.randint(0, 40)))
        b = edited(rng, a, rng.randint(1, min(6, len(a)))) if a and rng.random() < 0.7 else "".join(rng.choices("abé", k=rng.randint(0, 40)))
        most, d = rng.randint(0, 12), slow_distance(a, b)
        assert ef.edit_distance_within(a, b, most) == (d if d <= most else None)


def test_edit_pairs_find_every_pair_within_the_share(spark):
    rng = random.Random(7)
    docs, near = [], []
    for i, chars in enumerate([20, 25, 39, 40, 60, 95, 99, 100, 104, 199, 380, 399, 400, 420, 1500, 1500, 1500, 6000, 6000, 6000] * 2):
        a = words(rng, chars, "abcdefghijklmnopqrstuvwxyz")[:chars]
        docs += [(2 * i, a), (2 * i + 1, edited(rng, a, max(1, int(0.05 * chars))))]
        near.append((2 * i, 2 * i + 1))
    text = dict(docs)
    want = {}
    for a, b in near:
        d, most = slow_distance(text[a], text[b]) if len(text[a]) < 1000 else None, int(0.05 * max(len(text[a]), len(text[b])))
        if d is None:
            d = ef.edit_distance_within(text[a], text[b], most)
        if d is not None and 0 < d <= most:
            want[a, b] = d
    got = {(r.a, r.b): r.distance for r in ef.edit_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    print("recall", len(set(got) & set(want)) / len(want), len(want))
    assert got == want and len(want) > 30


def test_edit_pairs_of_the_documents_equal_brute_force(spark):
    from cinder.llm.catalog import op9_edit_pairs
    texts = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        if r.text:
            texts[r.text] = min(r.doc_id, texts.get(r.text, r.doc_id))
    rows = sorted((d, t) for t, d in texts.items())
    want = {}
    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1:]:
            if (d := ef.edit_distance_within(s, t, int(0.05 * max(len(s), len(t))))) is not None:
                want[a, b] = d
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        if r.text and texts[r.text] != r.doc_id:
            want[texts[r.text], r.doc_id] = 0
    assert {(r.a, r.b): r.distance for r in op9_edit_pairs(spark, "/root/testdata/sf0.001").collect()} == want


def test_odd_rows(odd_docs, odd_rows, empty_docs, clashing_docs):
    got = ef.compare_next(clashing_docs).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == "-" * 128 and by_id[10].n_chars == 200_000
    assert ef.compare_next(empty_docs).count() == 0
    one = ef.compare_next(odd_docs.where("doc_id = 4")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(4, 1.0)]
