import random
import re
from collections import Counter, defaultdict

import numpy as np

from cinder.llm import divergence as dv
from cinder.llm.catalog import ORACLE, op12_divergence
from oracle_check import compare, duck

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=dv.LEAST_DOCS):
    """(lang, source, part, item, value, rank) by walking over (text, lang, source)."""
    docs = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        groups[lang].add(source)
        n[lang, source].update(terms(text))
        df[lang].update(set(terms(text)))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= least]
        everything = sum((n[lang, s] for s in sources), Counter())

        def p(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        shares, q = {s: p(n[lang, s]) for s in sources}, p(everything)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            marked = [(-f(shares[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s][t] and shares[s][t] > q[t]]
            out |= {(lang, s, "pair", i, -v, k + 1) for k, (v, _, i) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", i, -v, k + 1) for k, (v, _, i) in enumerate(sorted(marked)[:10])}
    return out


def check(spark, rows, least=dv.LEAST_DOCS):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    got = [tuple(r) for r in dv.audit(docs, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least)
    return got


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    ok, msg = compare(op12_divergence(spark, sf).toPandas(), duck(ORACLE["op12_divergence"], sf))
    assert ok, msg


def test_random_corpora_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["a", "b", "the", "The", "über", "Über", "naïve", "😀", "é", "e", "x" * 9, "x" * 8, "x" * 17, "yz1yz", "z_z", "Q"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "é", None, "S"]))
            for _ in range(400)]
    rows += [(None, "de", "lone"), (None, "xx", "one"), ("a b", "xx", "two"), ("", "xx", None)]
    got = check(spark, rows)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in got)


def test_blocks_add_up(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(" ".join("".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(30)), "en", rng.choice("stuvw")) for _ in range(150)]
    monkeypatch.setattr(dv, "BLOCK_CELLS", 16)
    check(spark, rows, least=3)


def terms_of(data):
    return [t.encode("utf-8", "surrogatepass") for t in re.findall(r"[a-z\x80-\U0010ffff]+", data)]


def test_pointer_sort_orders_all_terms():
    rng = random.Random(6)
    for make in (lambda: "".join(rng.choices("ab", k=rng.randint(1, 30))), lambda: "a" * rng.randint(1, 120),
                 lambda: rng.choice(["same", "samé", "😀" * 20, "z" * 300, "z" * 299 + "y"])):
        words = [make() for _ in range(9000)]
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        data = np.concatenate([dv._FOLD[raw], np.zeros(9, np.uint8)])
        start, length = dv.term_pointers(data)
        order, runs = dv.pointer_sort(data, start, length)
        encoded = [w.encode() for w in words]
        assert [encoded[i] for i in order] == sorted(encoded) and sorted(order) == list(range(len(words)))
        assert [encoded[i] for i in order[runs]] == sorted(set(encoded))


def test_long_texts_in_pieces_equal_whole_ones(monkeypatch):
    rng = random.Random(7)
    text = " ".join("".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(3000)) + " " + "w" * 5000
    monkeypatch.setattr(dv, "SLICE_BYTES", 700)
    terms, n = dv._long_text(np.frombuffer(text.encode(), np.uint8))
    assert dict(zip(terms, map(int, n))) == Counter(terms_of(text))


def test_counts_with_small_slices(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["un", "deux", "trois", "Quatre"], k=rng.randint(0, 200))), "fr", rng.choice("ab")) for i in range(60)]
    monkeypatch.setattr(dv, "SLICE_BYTES", 300)
    got = {(r.source, r.term): (r.n, r.docs) for r in dv.term_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    n, docs = Counter(), Counter()
    for _, text, _, s in rows:
        n.update((s, t) for t in text.lower().split())
        docs.update({(s, t) for t in text.lower().split()})
    assert {k: v for k, v in got.items() if k[1]} == {k: (n[k], docs[k]) for k in n}


def test_shares_are_exact_for_huge_counts(spark):
    n, total, v = 9_000_000_000_000_000, 9_100_000_000_000_007, 12_345
    from pyspark.sql import functions as F
    c = [F.lit(x).cast("long") for x in (n, total, v)]
    assert spark.range(1).select(dv.share(*c)).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_odd_rows(spark, odd_rows, empty_docs, clashing_docs):
    got = {tuple(r) for r in dv.audit(clashing_docs).collect()}
    assert got == brute([(r[1], r[2], r[3]) for r in odd_rows])
    assert dv.audit(empty_docs).count() == 0
