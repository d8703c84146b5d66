"""Source divergence audit by a token-start pointer sort.

Counting terms.  Each task takes its texts as Arrow buffers, in slices of some
megabytes: one byte buffer, lower-cased by a table, and an array of pointers to the
starts of its terms.  The pointers are sorted by the bytes they point at with a
multikey quicksort: three-way partitions on eight bytes at a time, the equal part
going on with the next eight; small parts are finished by one sort on all their
bytes.  Equal runs are the terms of the slice, and each run, cut by (lang, source)
and document, yields occurrences and documents.  Rows (lang, source, term, n, docs)
leave the task already counted, Spark adds them up: documents of a language per term
are the sum over its sources.

Comparing sources.  Terms in enough documents of a language are kept.  Smoothed
shares are integers, in 38-digit arithmetic where a count could overflow.  Sums over
all kept terms for each pair of sources are taken over blocks of terms of bounded
size: one block is a matrix of sources by terms, and only its sums leave it.

Scale: texts are read once and never shuffled; what is shuffled is counted rows.  A
source or language that holds a third of all rows only adds to counts.  Blocks hold
about ``BLOCK_CELLS`` cells, however many terms and sources there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinder.session import materialise

LEAST_DOCS = 10
TOP = 10
SHARE = 1_000_000_000
SLICE_BYTES = 8 << 20        # of text sorted at a time
BLOCK_CELLS = 1 << 16        # sources times terms compared at a time; at least as many terms as sources
_LEAF = 4096                 # pointers of a part that one plain sort finishes
_LEAF_BYTES = 48             # if their terms are no longer than this

# Bytes of terms (ASCII letters, A-Z lower-cased, and non-ASCII bytes); all others are 0.
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
# The first k bytes of eight, big-endian.
_FIRST = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(9)], np.uint64)


def term_pointers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the terms in folded bytes that end with a zero byte."""
    inside = data != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate([[0], edge])
    return edge[::2], edge[1::2] - edge[::2]


def pointer_sort(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run starts): positions of ``start`` sorted by term, equal terms in their
    order, and where each run of equal terms begins in that order.

    ``data`` is followed by at least eight more bytes.
    """
    eights = np.lib.stride_tricks.as_strided(data, (max(len(data) - 7, 0), 8), (1, 1))

    def chunk(at: np.ndarray, depth: int) -> np.ndarray:
        raw = eights[np.minimum(start[at] + depth, len(eights) - 1)].view(">u8")[:, 0].astype(np.uint64)
        return raw & _FIRST[np.clip(length[at] - depth, 0, 8)]

    order: list[np.ndarray] = []
    runs: list[np.ndarray] = []
    done = 0

    def give(at: np.ndarray, first: np.ndarray) -> None:
        nonlocal done
        order.append(at)
        runs.append(first + done)
        done += len(at)

    zero = np.zeros(1, np.int64)
    todo = [(np.arange(len(start)), 0)] if len(start) else []
    while todo:
        at, depth = todo.pop()
        if len(at) == 1:
            give(at, zero)
            continue
        longest = int(length[at].max()) - depth
        if longest <= 0:                                    # all ended: one run
            give(at, zero)
            continue
        if len(at) <= _LEAF and longest <= _LEAF_BYTES:
            keys = [chunk(at, depth + d) for d in range(0, longest, 8)]
            by = np.lexsort(keys[::-1])
            new = np.zeros(len(at), bool)
            new[0] = True
            for k in keys:
                k = k[by]
                new[1:] |= k[1:] != k[:-1]
            give(at[by], np.flatnonzero(new))
            continue
        keys = chunk(at, depth)
        pivot = np.sort(keys[:: max(1, len(keys) // 9)][:9])[len(keys[:: max(1, len(keys) // 9)][:9]) // 2]
        below, above = keys < pivot, keys > pivot
        # Last in, first out: the part below comes next.
        todo += [(part, d) for part, d in ((at[above], depth), (at[~below & ~above], depth + 8), (at[below], depth)) if len(part)]
    return (np.concatenate(order), np.concatenate(runs)) if order else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def count_terms(data: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term of row, group of row, occurrences, documents) of texts laid end to
    end: ``ends`` are their last bytes' ends, ``group`` a number for each."""
    # A zero byte after each text keeps terms apart; eight more can be read past the end.
    size = np.diff(ends, prepend=0)
    folded = np.zeros(int(ends[-1]) + len(ends) + 8 if len(ends) else 8, np.uint8)
    folded[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(np.arange(len(ends)), size)] = _FOLD[data]
    start, length = term_pointers(folded)
    order, runs = pointer_sort(folded, start, length)
    terms = [folded[s:s + n].tobytes() for s, n in zip(start[order[runs]], length[order[runs]], strict=True)]
    doc = np.searchsorted(ends + np.arange(1, len(ends) + 1), start[order], side="right")
    of = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(order))))
    by = np.lexsort((doc, group[doc], of))
    of, doc = of[by], doc[by]
    g = group[doc]
    row = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (g[1:] != g[:-1]))) if len(of) else np.zeros(0, np.int64)
    new_doc = np.append(True, (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])).astype(np.int64) if len(of) else np.zeros(0, np.int64)
    n = np.diff(np.append(row, len(of)))
    docs = np.add.reduceat(new_doc, row) if len(row) else new_doc
    return terms, of[row], g[row], n, docs


def _long_text(data: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Terms and occurrences of one text that is too long for a slice, piece by piece."""
    seen: dict[bytes, int] = {}
    at = 0
    while at < len(data):
        to = min(at + SLICE_BYTES, len(data))
        while to < len(data) and _FOLD[data[to - 1]] and _FOLD[data[to]]:      # not inside a term
            rest = np.flatnonzero(_FOLD[data[to:to + SLICE_BYTES]] == 0)
            to = to + int(rest[0]) if len(rest) else min(to + SLICE_BYTES, len(data))
        terms, of, _, n, _ = count_terms(data[at:to], np.array([to - at]), np.zeros(1, np.int64))
        for t, k in zip(of, n, strict=True):
            seen[terms[t]] = seen.get(terms[t], 0) + int(k)
        at = to
    return list(seen), np.array(list(seen.values()), np.int64)


_COUNTS = "lang string, source string, term string, n long, docs long"
_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted terms of (lang, source, text) batches, and one row with an empty term for each group."""
    for batch in batches:
        pair = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        names = list(dict.fromkeys((p["lang"], p["source"]) for p in pair.to_pylist()))
        number = {p: i for i, p in enumerate(names)}
        group = np.array([number[p["lang"], p["source"]] for p in pair.to_pylist()], np.int64)
        lang, source = (pa.array([p[i] for p in names], pa.string()) for i in (0, 1))

        def rows(terms: list[bytes], of: np.ndarray, g: np.ndarray, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
            words = pa.array(terms, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([lang.take(pa.array(g)), source.take(pa.array(g)), words.take(pa.array(of)),
                                               pa.array(n), pa.array(docs)], schema=_SCHEMA)

        nothing = np.zeros(len(names), np.int64)
        yield rows([b""], nothing, np.arange(len(names)), nothing, nothing)
        text = batch.column(2).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        held = text.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(text):
            last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
            if last <= first:                               # one text above the limit
                terms, n = _long_text(data[offsets[first]:offsets[first + 1]])
                one = np.ones(len(terms), np.int64)
                yield rows(terms, np.arange(len(terms)), one * group[first], n, one)
                first += 1
                continue
            part = data[offsets[first]:offsets[last]]
            yield rows(*count_terms(part, offsets[first + 1:last + 1] - offsets[first], group[first:last]))
            first = last


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each
    group, and a row with an empty term for each group that occurs."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return (texts.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SHARE * (n + 2) / (total + 2 * terms)), exact for any long counts."""
    top = F.lit(SHARE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    # Decimal arguments keep the quotient of the SQL operator exact.
    return F.lit(1).cast("long") + F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)"))


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): below 2^62, as shares are at most SHARE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value), a < b: sums over all kept terms of the distance of two sources.

    ``kept`` are counts of kept terms, ``groups`` (lang, source, terms, sources, p0) with
    the share of a term that does not occur."""
    blocks = F.ceil(F.col("terms") * F.col("sources") / F.greatest(
        F.lit(BLOCK_CELLS).cast("long"), F.col("sources") * F.col("sources"))).cast("int")
    shape = groups.groupBy(F.col("lang").alias("s_lang")).agg(F.first(blocks).alias("blocks"))
    cells = kept.join(shape, F.col("lang") == F.col("s_lang")).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
    frame = groups.where("terms > 0").select("lang", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "source", "p0")

    def compare(sources: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", key=lambda s: s.map(lambda t: t.encode("utf-8", "surrogatepass"))).reset_index(drop=True)
        place = pd.Series(sources.index, index=sources["source"])
        codes, terms = pd.factorize(rows["term"])
        table = np.repeat(sources["p0"].to_numpy(np.int64)[:, None], len(terms), axis=1)
        table[place[rows["source"]].to_numpy(), codes] = rows["p"].to_numpy(np.int64)
        out = []
        for a in range(len(sources) - 1):
            p, q = table[a], table[a + 1:]
            value = ((p - q) ** 2 // (p + q)).sum(axis=1)
            out.append(pd.DataFrame({"lang": sources["lang"].iloc[0], "a": sources["source"].iloc[a],
                                     "b": sources["source"].to_numpy()[a + 1:], "value": value}))
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})

    return (frame.groupBy("lang", "block").cogroup(cells.groupBy("lang", "block"))
            .applyInPandas(compare, "lang string, a string, b string, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's wording is from
    the other sources of its language, and by which terms it differs from the language.

    Null text, lang and source count as ''.  A group without kept terms has the
    smoothed shares of no occurrences; a language without kept terms has pairs of value
    0 and no terms; a language with one source has no pairs.  Ties go to the smaller
    item by UTF-8 bytes.  Repeated rows are documents of their own; the doc_id and other
    columns are not looked at; an empty table gives no rows.
    """
    counts = materialise(term_counts(docs), "divergence-counts")
    terms = materialise(
        counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_docs).select(F.col("lang").alias("k_lang"), F.col("term").alias("k_term"), "lang_n"),
        "divergence-terms")
    found = materialise(
        counts.where("term <> ''").join(terms, (F.col("lang") == F.col("k_lang")) & (F.col("term") == F.col("k_term")))
        .select("lang", "source", "term", "n", "lang_n"), "divergence-kept")
    of_lang = terms.groupBy(F.col("k_lang").alias("l_lang")).agg(
        F.sum("lang_n").alias("l_total"), F.count("*").alias("l_terms"))
    of_group = found.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(F.sum("n").alias("g_total"))
    all_groups = counts.where("term = ''").select("lang", "source")
    many = all_groups.groupBy(F.col("lang").alias("m_lang")).agg(F.count("*").alias("sources"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = (all_groups.join(many, F.col("lang") == F.col("m_lang"))
              .join(of_lang, F.col("lang") == F.col("l_lang"), "left")
              .join(of_group, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")), "left")
              .select("lang", "source", "sources", zero("l_terms").alias("terms"), zero("l_total").alias("lang_total"),
                      zero("g_total").alias("total")))
    # Without kept terms nothing is shared out; one term in the denominator avoids 0 / 0 there.
    groups = materialise(groups.withColumn("p0", share(
        F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1).cast("long")))), "divergence-groups")

    g = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "terms", "total", "lang_total")
    shares = materialise(
        found.join(g, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
        .select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
                share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")), "divergence-shares")

    sums = _pair_sums(shares, groups)
    other = groups.select(F.col("lang").alias("o_lang"), F.col("source").alias("item"))
    wanted = groups.join(other, (F.col("lang") == F.col("o_lang")) & (F.col("source") != F.col("item"))).select(
        "lang", "source", "item")
    both = sums.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("v_source"), F.col("b").alias("v_item")),
        F.struct(F.col("b").alias("v_source"), F.col("a").alias("v_item")))).alias("s"), "value").select(
        F.col("lang").alias("v_lang"), "s.*", "value")
    pairs = wanted.join(both, (F.col("lang") == F.col("v_lang")) & (F.col("source") == F.col("v_source"))
                        & (F.col("item") == F.col("v_item")), "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", zero("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    marked = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    return (pairs.select("*", rank).unionByName(marked.select("*", rank).where(F.col("rank") <= top)))


def oracle_sql() -> str:
    """The same rows in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share_of = lambda n, total: f"(1 + CAST({SHARE} AS HUGEINT) * ({n} + 2) // ({total} + 2 * v))"
    distance = "((p - q) * (p - q) // (p + q))"
    order = "ORDER BY value DESC, encode(item)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM counts GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, sum(n) AS total FROM counts JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         {share_of('coalesce(c.n, 0)', 'coalesce(t.total, 0)')} AS p, {share_of('k.lang_n', 'l.lang_total')} AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
sums AS (
  SELECT lang, source, item, sum({distance}) AS value
  FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q
        FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) x GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
marked AS (SELECT lang, source, 'term' AS part, term AS item, {distance} AS value FROM cells WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part {order}) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marked) x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
