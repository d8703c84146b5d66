"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask keeps 4 of 5 to 7 consecutive tokens and ignores the others, so a
substituted word under an ignored position does not hide a match.  Each
benchmark item and each document is hashed under both masks at every position;
documents join the benchmark's hashes and every hit names an alignment
(document position minus item position).  Along each alignment the item's words
are compared one by one: the document holds a leak where at least 0.8 of some
``WINDOW`` consecutive item words (of all its words if it has fewer) are equal.
The two masks together are lossless for that rule: however the allowed
substitutions fall, one of them fits between them (tests enumerate this).

Scale: one pass over the documents with no shuffle of texts.  Only the
benchmark's hashes are broadcast, in blocks of at most ``BLOCK_SEEDS`` rows (24
bytes each); a larger benchmark takes more passes.  Hits carry just the item's
length in words, collapse per document and alignment before the shuffle, and
group by document, so a passage in a third of all documents stays spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinder.llm.common import drop_ids
from cinder.session import materialise

MASKS = ((0, 1, 2, 4), (0, 3, 5, 6))
WINDOW = 16
LEAST_WORDS = 8             # shorter items are left to short_copies
SHARE = 0.8
BLOCK_SEEDS = 500_000
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def tokens(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and non-ASCII characters; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), "")


def _seeds(hashes: str) -> str:
    """SQL: array of (key, at) of every position under every mask."""
    parts = []
    for mask_no, mask in enumerate(MASKS):
        picked = ", ".join(f"element_at({hashes}, i + {o + 1})" for o in mask)
        parts.append(
            f"CASE WHEN size({hashes}) > {mask[-1]} THEN transform(sequence(0, size({hashes}) - {mask[-1] + 1}), "
            f"i -> named_struct('key', xxhash64({mask_no}, {picked}), 'at', i)) "
            f"ELSE cast(array() AS array<struct<key: bigint, at: int>>) END")
    return f"concat({', '.join(parts)})"


def item_seeds(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items(item_id, item_words), seeds(key, item_id, item_at, item_size)), both written."""
    items = (benchmark.select("item_id", tokens(F.col("text")).alias("item_words"))
             .where(F.col("item_id").isNotNull() & (F.size("item_words") >= LEAST_WORDS)))
    items = materialise(items.dropDuplicates(["item_id", "item_words"]), "bench-items")
    seeds = (items.withColumn("hashes", F.expr("transform(item_words, w -> xxhash64(w))"))
             .select("item_id", F.size("item_words").alias("item_size"), F.explode(F.expr(_seeds("hashes"))).alias("s"))
             .select(F.col("s.key").alias("key"), "item_id", F.col("s.at").alias("item_at"), "item_size"))
    return items, materialise(seeds, "bench-seeds")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, places, overlap, matched) for each document that holds an item.

    ``places``: alignments that pass; ``overlap``: the largest share of equal
    words in a window; ``matched``: the most equal words on one alignment.  Null
    texts hold nothing; rows with a null doc_id cannot be named and are left
    out; rows that repeat a doc_id count as one document, which holds what any of
    them holds; items of fewer than 8 words (see ``short_copies``) and items without an
    id are left out.  Empty tables give no rows.
    """
    items, seeds = item_seeds(benchmark)
    n_blocks = max(1, math.ceil(seeds.count() / BLOCK_SEEDS))
    probes = (docs.select("doc_id", tokens(F.col("text")).alias("words")).where("doc_id is not null")
              .withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
              .select("doc_id", "words", F.explode(F.expr(_seeds("hashes"))).alias("s")))
    found = None
    for block in range(n_blocks):
        part = seeds.where(F.pmod(F.xxhash64("key", "item_id", "item_at"), F.lit(n_blocks)) == block)
        # Bounded: at most about BLOCK_SEEDS rows whatever the benchmark's size.
        hits = probes.join(F.broadcast(part), F.col("s.key") == F.col("key")).select(
            "doc_id", "item_id", (F.col("s.at") - F.col("item_at")).alias("shift"),
            # the document's words beside the item's, from its first word inside the document on
            F.expr("slice(words, greatest(s.at - item_at, 0) + 1, item_size + least(s.at - item_at, 0))").alias("beside"))
        found = hits if found is None else found.unionByName(hits)
    lines = found.distinct()       # rows that repeat a doc_id keep their own words
    equal = ("transform(item_words, (w, i) -> CASE WHEN i + least(shift, 0) >= 0 "
             "AND get(beside, i + least(shift, 0)) = w THEN 1 ELSE 0 END)")
    width = f"least(size(item_words), {WINDOW})"
    best = (f"array_max(transform(sequence(0, size(item_words) - {width}), "
            f"s -> aggregate(slice(equal, s + 1, {width}), 0, (a, x) -> a + x)))")
    return (lines.join(items.withColumnRenamed("item_id", "of_item"), F.col("item_id") == F.col("of_item"))
            .withColumn("equal", F.expr(equal))
            .withColumn("matched", F.expr("aggregate(equal, 0, (a, x) -> a + x)"))
            .where(F.expr(f"matched >= {SHARE} * {width}"))          # else no window can pass
            .withColumn("overlap", F.expr(f"{best} / {width}"))
            .where(F.col("overlap") >= SHARE)
            .groupBy("doc_id", "item_id")
            .agg(F.countDistinct("shift").alias("places"), F.max("overlap").alias("overlap"),
                 F.max("matched").cast("long").alias("matched")))


def short_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, places, overlap, matched) for each document that holds all words, in
    order, of an item of fewer than ``LEAST_WORDS`` words: what ``contaminated`` leaves out.

    Documents' runs of each length that such items have join the items' words.  Without
    such items the documents are not read.  Null ids and texts as in ``contaminated``.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item_words")).where(
        F.col("item_id").isNotNull() & (F.size("item_words") > 0) & (F.size("item_words") < LEAST_WORDS))
    items = materialise(items.select("item_id", F.size("item_words").alias("item_size"),
                                     F.concat_ws(" ", "item_words").alias("run")).distinct(), "bench-short")
    sizes = sorted(r["item_size"] for r in items.select("item_size").distinct().collect())      # at most 7 values
    n_blocks = max(1, math.ceil(items.count() / BLOCK_SEEDS))
    runs = " ".join(f"WHEN {n} THEN transform(sequence(0, size(words) - {n}), "
                    f"i -> named_struct('run', concat_ws(' ', slice(words, i + 1, {n})), 'at', i))" for n in sizes)
    none = "cast(array() AS array<struct<run: string, at: int>>)"
    probes = docs.select("doc_id", tokens(F.col("text")).alias("words")).where("doc_id is not null")
    if not sizes:
        probes = probes.limit(0)
    probes = probes.select("doc_id", "words", F.explode(F.array(*[F.lit(n) for n in sizes or [0]])).alias("size")).select(
        "doc_id", F.explode(F.expr(f"CASE WHEN size(words) >= size THEN CASE size {runs} END ELSE {none} END" if sizes else none)).alias("r"))
    found = None
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "run"), F.lit(n_blocks)) == block)
        # Bounded: at most about BLOCK_SEEDS rows whatever the benchmark's size.
        hits = probes.join(F.broadcast(part), F.col("r.run") == F.col("run")).select("doc_id", "item_id", F.col("r.at").alias("at"), "item_size")
        found = hits if found is None else found.unionByName(hits)
    return (found.groupBy("doc_id", "item_id", "at").agg(F.max("item_size").alias("item_size"))
            .groupBy("doc_id", "item_id").agg(F.countDistinct("at").alias("places"), F.lit(1.0).alias("overlap"),
                                              F.max("item_size").cast("long").alias("matched")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item of at least ``LEAST_WORDS`` words."""
    return drop_ids(docs, materialise(contaminated(docs, benchmark).select("doc_id").distinct(), "bench-leaks"))


def keep_without_short(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a whole benchmark item of fewer words."""
    return drop_ids(docs, materialise(short_copies(docs, benchmark).select("doc_id").distinct(), "bench-short-leaks"))


_WORDS_SQL = ("regexp_extract_all(lower(coalesce(text, '')), "
              "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


def oracle_sql() -> str:
    """DuckDB SQL for :func:`contaminated` over documents and benchmark."""
    def seeds(rows: str, names: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {names}, {n} AS mask, i AS at, "
            f"{', '.join(f'words[i + {o + 1}] AS k{j}' for j, o in enumerate(mask))} "
            f"FROM (SELECT *, unnest(range(0, len(words) - {mask[-1]})) AS i FROM {rows})"
            for n, mask in enumerate(MASKS))

    return f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS words FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, words FROM (SELECT item_id, {_WORDS_SQL} AS words FROM benchmark
      WHERE item_id IS NOT NULL) WHERE len(words) >= {LEAST_WORDS}),
ds AS ({seeds('d', 'doc_id')}),
bs AS ({seeds('b', 'item_id')}),
lines AS (SELECT DISTINCT doc_id, item_id, ds.at - bs.at AS shift FROM ds JOIN bs USING (mask, k0, k1, k2, k3)),
w AS (SELECT doc_id, item_id, shift, b.words AS iw, least(len(b.words), {WINDOW}) AS width,
      list_transform(range(0, len(b.words)), lambda i: CASE WHEN i + shift >= 0
        AND d.words[i + shift + 1] = b.words[i + 1] THEN 1 ELSE 0 END) AS equal
      FROM lines JOIN d USING (doc_id) JOIN b USING (item_id)),
o AS (SELECT doc_id, item_id, shift, list_sum(equal) AS matched,
      list_max(list_transform(range(0, len(iw) - width + 1), lambda s: list_sum(equal[s + 1:s + width]))) / width AS overlap
      FROM w)
SELECT doc_id, item_id, count(DISTINCT shift) AS places, max(overlap) AS overlap,
       CAST(max(matched) AS BIGINT) AS matched
FROM o WHERE overlap >= {SHARE} GROUP BY doc_id, item_id"""
