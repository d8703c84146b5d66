import random
import re
from collections import Counter

from cinder.llm import quality_rules as qr
from cinder.llm.catalog import ORACLE, op13_quality_rules
from oracle_check import compare, duck

SF = "/root/testdata/sf0.01"


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by walking."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    places = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places))


def check(rows, got):
    assert len(rows) == len(got)
    want = Counter((d, *brute(t)) for d, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept == (r.failed == "")


def test_query_matches_sql_and_brute_force(spark):
    got = op13_quality_rules(spark, SF)
    ok, msg = compare(got.toPandas(), duck(ORACLE["op13_quality_rules"], SF))
    assert ok, msg
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check([(d.doc_id, d.text) for d in docs], got.collect())


def test_clean_texts_stay_and_junk_goes(spark):
    rng = random.Random(1)
    clean = " ".join(rng.choice(["the", "of", "river", "ran", "through", "valley", "and", "stones", "were", "old"]) + rng.choice(["", "", ","])
                     for _ in range(200)).replace(",", ",\n")
    rows = [(1, clean), (2, "### *** $$$ " * 60 + clean), (3, "1234 5678 " * 100), (4, "same line of the text here\n" * 40),
            (5, "\n".join("- the item of number n" + "x" * i for i in range(40))), (6, "zzgh klmp " * 10 + "qrst vwxz " * 60),
            (7, "\n".join("and so on of the " + "y" * i + "..." for i in range(40)))]
    got = {r.doc_id: r for r in qr.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept
    for i, rule in ((2, "symbols"), (3, "letter_words"), (4, "duplicate_lines"), (5, "bullet_lines"), (6, "stop_words"), (7, "ellipsis_lines")):
        assert not got[i].kept and rule in got[i].failed.split(","), got[i]
    kept = qr.keep_good(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(1, clean)]


def test_repeats_at_the_edges(spark):
    rows = list(enumerate(["a b c a b c", "a a a", "a a a a", "a b c d a b c", "a b", "", None, "x y z w x y z w x y", "a b a b",
                           "é é é é", "l\nl\n \n\n l\nl"]))
    check(rows, qr.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_a_table_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id long, text string")
    rules = (qr.Rule("three", "n_words", None, 3, None),)
    assert [r.doc_id for r in qr.keep_good(docs, rules).collect()] == [1]


def test_no_user_function_and_no_shuffle(spark):
    plan = op13_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and "Window" not in plan


def test_odd_rows(odd_docs, odd_rows, empty_docs, clashing_docs):
    check([(r[0], r[1]) for r in odd_rows], qr.report(clashing_docs).collect())
    out = qr.judge(clashing_docs)
    assert out.columns == [*clashing_docs.columns, "__quality"] and qr.report(empty_docs).count() == 0
