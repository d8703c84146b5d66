import random
from collections import defaultdict

import xxhash

from cinder.llm import simhash
from cinder.llm.catalog import op5_simhash
from cinder.llm.components import connected_components
from cinder.session import materialise

from .helpers import plain_rows


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws, w = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            ws += [w] if w else []
            w = ""
        else:
            w += c
    shingles = [" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows (doc_id, fp) -> {doc_id: smallest reachable}; quadratic."""
    label = {d: d for d, _ in rows}
    change = True
    while change:
        change = False
        for d, f in rows:
            for e, g in rows:
                if bin(f ^ g).count("1") <= 2 and label[e] < label[d]:
                    label[d], change = label[e], True
    return label


def test_query_equals_brute_force(spark):
    docs = plain_rows(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r for r in op5_simhash(spark, "/root/testdata/sf0.001").collect()}
    fps = [(d.doc_id, brute_fingerprint(d.text)) for d in docs]
    want = brute_components(fps)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{f:016x}", want[d]) for d, f in fps}


def test_near_pairs_are_all_pairs_within_two_bits(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63}
    for f in list(fps):
        for _ in range(6):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    points = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    got = {(r.a, r.b) for r in simhash.near_pairs(points).collect()}
    want = {(i, j) for i, f in enumerate(signed) for j, g in enumerate(signed)
            if i < j and bin((f ^ g) & (1 << 64) - 1).count("1") <= 2}
    assert got == want and len(want) > 100


def test_range_join_sends_no_side_through_the_driver(spark):
    points = materialise(spark.range(20_000).selectExpr("id * 7919 AS fp", "id AS rep"), "test-points")
    plan = simhash.near_pairs(points)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(3, 3), (None, 5)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, odd_rows, empty_docs, clashing_docs):
    got = simhash.simhash_components(odd_docs).collect()
    assert len(got) == len(odd_rows)
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.fp, r.component_id))
    assert by_id[1] == by_id[2] == by_id[3] == {(0, 1)}         # no words: linked like any other
    assert {c for _, c in by_id[None]} == {1, 4} and by_id[5] == by_id[4]
    assert by_id[7] == {(next(iter(by_id[7]))[0], 6)}           # one word more in 60,000
    kept = simhash.keep_one_of_each(clashing_docs)
    assert kept.columns == clashing_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(9) == 1 and ids.count(None) == 2 and 5 not in ids and {1, 4, 6} <= set(ids)
    assert simhash.simhash_components(empty_docs).count() == 0 and simhash.keep_one_of_each(empty_docs).count() == 0
