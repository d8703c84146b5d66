"""The pipeline against plain row-by-row versions of its stages."""

from collections import Counter, defaultdict

import corpus_pipeline
from cinder.llm import sharding, simhash

from .helpers import plain_rows
from .test_decontaminate import brute
from .test_mixing import brute_targets
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = [d for d in plain_rows(spark, SF, "documents") if d.text and any(c.isalpha() for c in d.text)]
    first = brute_components([(d.doc_id, brute_fingerprint(d.text)) for d in docs])
    docs = [d for d in docs if first[d.doc_id] == d.doc_id]
    items = [(b.item_id, b.text) for b in plain_rows(spark, SF, "benchmark")]
    leaks = {d for d, _ in brute([(d.doc_id, d.text) for d in docs], items)}
    docs = {d.doc_id: d for d in docs if d.doc_id not in leaks}

    rows = corpus_pipeline.run(spark, SF).collect()
    times = Counter(r.doc_id for r in rows)
    assert set(times) <= set(docs) and max(times.values()) <= 3
    own, taken = defaultdict(int), defaultdict(int)
    for d in docs.values():
        own[d.source] += len(d.text.split())
        taken[d.source] += len(d.text.split()) * times[d.doc_id]
    want = brute_targets(own)
    longest = max(len(d.text.split()) for d in docs.values())
    assert all(abs(taken[s] - want[s]) <= min(longest, 0.2 * own[s] + 5) for s in want)
    for r in rows:
        assert (r.text, r.lang, r.source, r.n_chars) == tuple(docs[r.doc_id])[1:]
    load = defaultdict(int)
    for r in rows:
        load[r.shard_id] += len(r.text.encode())
    assert max(load.values()) <= sharding.SHARD_BYTES


def test_stages_keep_columns_and_take_odd_rows(spark, clashing_docs, odd_rows):
    docs = clashing_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == clashing_docs.columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.columns[:len(clashing_docs.columns)] == clashing_docs.columns and 0 < out.count() <= 3 * len(odd_rows)


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    assert simhash.SHINGLE_WORDS == 3 and simhash.MAX_BITS == 2
