import hashlib
import random
from collections import defaultdict

from cinder.llm import sharding
from cinder.llm.catalog import op8_sharding


def brute_shards(sizes, limit):
    """{key: bytes}: split prefixes recursively until each fits or holds one key."""
    bits = {k: f"{int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16):060b}" for k in sizes}
    out = {}

    def place(keys, prefix):
        if sum(sizes[k] for k in keys) <= limit or len({bits[k] for k in keys}) == 1:
            out.update({k: "s" + prefix for k in keys})
            return
        for b in "01":
            if part := [k for k in keys if bits[k].startswith(prefix + b)]:
                place(part, prefix + b)

    place(list(sizes), "")
    return out


def test_query_equals_recursive_splitting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    sizes = {d.doc_id: len(d.text.encode()) for d in docs}
    got = {r.doc_id: r for r in op8_sharding(spark, "/root/testdata/sf0.01").collect()}
    assert {d: r.shard_id for d, r in got.items()} == brute_shards(sizes, sharding.SHARD_BYTES)
    for limit in (5_000, 40_000):
        rows = sharding.shard_list(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), limit).collect()
        assert {r.doc_id: r.shard_id for r in rows} == brute_shards(sizes, limit)


def test_deep_splits_need_another_round(spark):
    rows = [(i, "x" * 10) for i in range(40)] + [(1000, "y" * 5000)]
    got = sharding.shard_list(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    assert {r.doc_id: r.shard_id for r in got} == brute_shards({i: len(t) for i, t in rows}, 10)


def test_one_key_spreads_over_pages(spark):
    rows = [(7, "x" * 30)] * 500 + [(i, "y" * 10) for i in range(100, 150)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 200).collect()
    assert len(got) == len(rows)
    load = defaultdict(int)
    for r in got:
        load[r.shard_id] += len(r.text)
    assert max(load.values()) <= 200 and len([s for s in load if "." in s]) > 70


def test_odd_rows(odd_docs, odd_rows, empty_docs, clashing_docs):
    got = sharding.shard_list(odd_docs, 1000).collect()
    assert len(got) == len(odd_rows) and all(r.shard_id for r in got)
    load = defaultdict(list)
    for r in got:
        load[r.shard_id].append(r.n_bytes)
    assert all(sum(b) <= 1000 or len([x for x in b if x]) == 1 for b in load.values())
    out = sharding.sharded(clashing_docs, 1000)
    assert out.columns[:len(clashing_docs.columns)] == clashing_docs.columns and out.count() == len(odd_rows)
    assert sharding.shard_list(empty_docs).count() == 0


def test_an_oversize_row_does_not_split_the_rest(spark):
    rows = [(None, "x" * 10) for _ in range(50)] + [(None, "y" * 3000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 1000).collect()
    assert len({r.shard_id for r in got}) == 2 and len(got) == 51


def test_pages_are_half_full_on_average(spark):
    rng = random.Random(9)
    rows = [(1, "x" * rng.choice([0, 5, 80, 400, 499, 900])) for _ in range(600)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 1000).collect()
    load, large = {}, {r.shard_id for r in got if len(r.text) > 500}
    for r in got:
        load[r.shard_id] = load.get(r.shard_id, 0) + len(r.text)
    assert max(load.values()) <= 1000 and len(got) == 600
    assert len(large) == sum(len(r.text) > 500 for r in got)
    small = [v for k, v in load.items() if k not in large]
    assert len(small) <= sum(small) / 501 + 1
