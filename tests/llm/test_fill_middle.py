import hashlib
import random

import regex
from pyspark.sql import functions as F

from cinder.llm import fill_middle as fm
from cinder.llm.catalog import ORACLE, op11_fill_middle
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def units(text):
    """Units by a walk over the code points."""
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in SPACE:
            end += 1
        while end < len(text) and text[end] not in SPACE:
            end += 1
        out.append(text[at:end])
        at = end
    return out


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    u = units(text)
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema)
    got = (fm.fill_in_middle(docs).select("doc_id", "text", "__fim.*")
           .withColumn("back", fm.rebuilt(F.col("output"), F.col("form"))).collect())
    want = sorted([(str(r[0]), r[1] or "", *map(str, brute(r[0], r[1]))) for r in rows])
    assert sorted((str(r.doc_id), r.text or "", str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got) == want
    assert all(r.back == (r.text or "") for r in got)
    return got


def test_query_matches_sql_and_reruns_agree(spark):
    got = op11_fill_middle(spark, SF).toPandas()
    ok, msg = compare(got, duck(ORACLE["op11_fill_middle"], SF))
    assert ok, msg
    assert compare(got, op11_fill_middle(spark, SF).toPandas())[0]


def test_digests_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in op11_fill_middle(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    forms = set()
    for d in docs:
        n, form, p, m, out = brute(d.doc_id, d.text)
        r = got[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (
            n, form, p, m, sha(out), sha(d.text or ""))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"} and len(got) == len(docs)


def test_hard_texts(spark):
    rng = random.Random(5)
    alphabet = ["a", "é", "😀", "<", ">", "P", "S", "M", " ", "\n", "\t", " ", "\x0b", "\x1c", "0"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 40)))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate(["<P>", "a <S> b", "x<M", "<<P", "<P >", "   ", "\n", "a", " a", "a ", None, ""])]
    rows += [(None, "one two three"), (None, None), (7, "x"), (7, "x"), (7, "y z")]
    got = check(spark, rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_marker_pieces_next_to_markers(spark):
    rows = [(i, t) for i in range(60) for t in ("< a <", "P> b <S", "<P a <M >")]
    assert {r.form for r in check(spark, rows)} == {"plain", "psm", "spm"}


def test_one_match_keeps_every_repetition_of_a_long_text():
    text = "word  and\tanother\n" * 100_000
    n, start, stop = fm.cut_places(text, 17, 250_000, regex.compile(f"({fm.UNIT})*+"))
    u = units(text)
    assert (n, start, stop) == (len(u), sum(map(len, u[:17])), sum(map(len, u[:250_000])))


def test_odd_rows(spark, odd_docs, odd_rows, empty_docs, clashing_docs):
    got = fm.fill_in_middle(clashing_docs)
    assert got.columns == [*clashing_docs.columns, "__fim"]
    rows = got.select("doc_id", "text", "__fim.*").collect()
    assert len(rows) == len(odd_rows) and fm.digests(empty_docs).count() == 0
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
    check(spark, [(r[0], r[1]) for r in odd_rows])
