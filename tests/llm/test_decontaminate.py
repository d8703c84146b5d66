import random
import re
from itertools import combinations


from cinder.llm import decontaminate as dc
from cinder.llm.catalog import op10_decontamination

from .helpers import plain_rows, words


def brute(docs, items):
    """Every alignment of every item with every document, no seeds."""
    def tok(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    out = {}
    for d, text in docs:
        own = tok(text)
        for i, passage in items:
            it = tok(passage)
            if len(it) < dc.LEAST_WORDS or not set(it) & set(own):
                continue
            width = min(len(it), dc.WINDOW)
            for shift in range(1 - len(it), len(own)):
                eq = [0 <= j + shift < len(own) and own[j + shift] == w for j, w in enumerate(it)]
                if sum(eq) < 0.8 * width:
                    continue
                best = max(sum(eq[s:s + width]) for s in range(len(it) - width + 1)) / width
                if best >= 0.8:
                    places, overlap, matched = out.get((d, i), (0, 0, 0))
                    out[d, i] = (places + 1, max(overlap, best), max(matched, sum(eq)))
    return out


def rows_of(df):
    return {(r.doc_id, r.item_id): (r.places, r.overlap, r.matched) for r in df.collect()}


def test_masks_lose_nothing_within_the_tolerance():
    for n in range(dc.LEAST_WORDS, dc.WINDOW + 1):
        for wrong in combinations(range(n), int(n * (1 - dc.SHARE) + 1e-9)):
            assert any(not any(at + o in wrong for o in mask) for mask in dc.MASKS for at in range(n - mask[-1]))


def test_query_equals_brute_force(spark):
    docs = plain_rows(spark, "/root/testdata/sf0.001", "documents")
    items = plain_rows(spark, "/root/testdata/sf0.001", "benchmark")
    want = brute([(d.doc_id, d.text) for d in docs], [(b.item_id, b.text) for b in items])
    assert want and rows_of(op10_decontamination(spark, "/root/testdata/sf0.001")) == want


def test_substitutions_blocks_and_boundaries(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, words(rng, n, "abcdefghij")) for i, n in enumerate([7, 8, 12, 16, 30, 45])]
    docs = []
    for d in range(60):
        passage = rng.choice(items)[1].split()
        for at in rng.sample(range(len(passage)), rng.randint(0, len(passage) // 4)):
            passage[at] = "changed"
        if rng.random() < 0.3:
            passage = passage[rng.randint(0, 6):]
        docs.append((d, " ".join([words(rng, rng.randint(0, 5)), *[w.upper() + "." for w in passage], words(rng, rng.randint(0, 5))])))
    monkeypatch.setattr(dc, "BLOCK_SEEDS", 50)          # several passes
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert rows_of(got) == want and len(want) > 20


def test_odd_rows(spark, odd_docs, empty_docs, clashing_docs):
    bench = spark.createDataFrame(
        [(1, None), (2, ""), (None, "one two three four five six seven eight"), (3, words(random.Random(3), 20)),
         (3, words(random.Random(3), 20)), (4, "one two three four")], "item_id long, text string")
    got = rows_of(dc.contaminated(odd_docs, bench))
    assert (6, 3) in got and all(d in (6, 7) for d, _ in got)
    kept = dc.keep_clean(clashing_docs, bench)
    assert kept.columns == clashing_docs.columns and kept.count() == odd_docs.count() - 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(odd_docs, none).count() == 0 and dc.contaminated(empty_docs, bench).count() == 0


def test_rows_that_repeat_an_id_are_all_looked_at(spark):
    item = "one two three four five six seven eight nine ten"
    half = "one two three four five six - - - -".replace("-", "other")      # shares a seed, no leak
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for texts in ([item, half], [half, item], [half, item, item, None]):
        docs = spark.createDataFrame([(5, t) for t in texts], "doc_id long, text string")
        assert rows_of(dc.contaminated(docs, bench)) == {(5, 1): (1, 1.0, 10)}


def test_exact_copies_of_short_items(spark, empty_docs, monkeypatch):
    rng = random.Random(8)
    items = [(i, words(rng, n, "ab")) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 7, 8])]
    items += [(20, "世界のすべて"), (21, "What is, the Capital?"), (None, "a"), (22, ""), (23, None), (24, "a")]
    docs = [(d, words(rng, rng.randint(0, 40), "ab")) for d in range(40)] + [
        (50, f"x {items[6][1].upper()}. y"), (51, "so: what is the capital of"), (52, "a 世界のすべて b"), (53, "世界のすべてx"),
        (54, None), (55, "what is the"), (55, "other what is the capital"), (None, "a")]
    docs.append((56, " ".join([items[7][1]] * 3)))
    want = {}
    for d, text in docs:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        for i, passage in items:
            it = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (passage or "").lower())
            at = {s for s in range(len(own) - len(it) + 1) if own[s:s + len(it)] == it}
            if None not in (d, i) and 0 < len(it) < dc.LEAST_WORDS and at:
                want.setdefault((d, i), (set(), len(it)))[0].update(at)
    want = {k: (len(at), 1.0, n) for k, (at, n) in want.items()}
    monkeypatch.setattr(dc, "BLOCK_SEEDS", 4)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(dc.short_copies(frame, bench)) == want and {(50, 6), (51, 21), (52, 20), (55, 21)} <= set(want)
    assert dc.short_copies(empty_docs, bench).count() == 0 and dc.short_copies(frame, bench.where("item_id = 8")).count() == 0


def test_pipeline_stage_drops_copies_of_short_items(spark, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([(1, "what is the capital of france"), (2, words(random.Random(9), 12))], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "Q: What is the capital of France?"), (2, "what is the capital of spain"), (None, "x"),
                                  (3, "a " + words(random.Random(9), 12))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()} == {2, None}
