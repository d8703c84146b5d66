"""Fuzzy name matching against a brute-force twin."""

import random
import re

from cinder.functions.names import match_names


def brute(wanted, available):
    norm = lambda x: re.sub("[^a-z0-9]", "", x.lower())
    out = {}
    for w in wanted:
        hits = [(norm(w) != norm(a), p, a) for a, p in available
                if norm(w) in norm(a) or norm(a) in norm(w)]
        if hits:
            out[w] = min(hits)[1:]
    return out


def test_first_hit_equals_brute_force(spark):
    rng = random.Random(1)
    made = lambda n, most: ["".join(rng.choices("ab_C1", k=rng.randint(1, most))) for _ in range(n)]
    wanted = sorted({*made(150, 12), "", "__", "b1", "total_precipitation_sum", "Temperature 2m max"})
    available = [(n, p) for p, n in enumerate([*made(60, 9), "sum", "temperature_2m_max_mean", "total_precipitation_sum"])]
    got = match_names(spark.createDataFrame([(w,) for w in wanted], "wanted string"),
                      spark.createDataFrame(available, "name string, position long")).collect()
    assert len(got) == len({r.wanted for r in got})
    want = brute(wanted, available)
    assert {r.wanted: (r.position, r.matched) for r in got} == want


def test_nulls_groups_and_empty_tables(spark):
    w = spark.createDataFrame([("x", "wind"), ("y", "wind"), ("x", None), ("y", "rain")], "file string, wanted string")
    a = spark.createDataFrame([("x", "WIND speed", 2), ("x", None, 1), ("y", "w", 5), ("y", "wind", 9)], "file string, name string, position int")
    got = {(r.file, r.wanted): r.matched for r in match_names(w, a, group_cols=["file"]).collect()}
    assert got == {("x", "wind"): "WIND speed", ("y", "wind"): "wind"}
    assert match_names(w, a.limit(0), group_cols=["file"]).count() == 0
    assert "NestedLoop" not in match_names(w, a, group_cols=["file"])._jdf.queryExecution().toString()


def test_long_names_explode_to_few_keys(spark):
    from pyspark.sql import functions as F

    from cinder.functions.names import _grams
    n = spark.createDataFrame([("".join(random.Random(2).choices("abcdefgh", k=512)),)], "c string").select(F.size(_grams(F.col("c")))).first()[0]
    assert n <= 512 * 10
