"""Sharding by extendible hashing, in DataFrame functions only.

A document's key hash is read bit by bit from the top.  A bucket is a prefix of
those bits; only a bucket above the byte limit splits on one more bit, so a
shard is the shortest prefix whose documents fit.  The directory is built from
byte sums of fine prefixes, rolled up to every depth (never a task per bucket);
only rows of buckets that are still too large at the finest prefix are read
again, with finer ones.  Rows with equal hashes cannot be told apart by more
bits: a bucket of one hash value above the limit is cut into overflow pages by
running bytes, summed by written partition first, so one key that holds a third
of all rows is spread over many tasks.

The directory has one entry for each distinct prefix of the shallowest shard's
depth, holding the few shards below it, and joins the documents on that prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinder.session import materialise

BITS = 60
SHARD_BYTES = 1 << 20
_FINER = 4                   # bits below the expected depth in the first byte sums
_STEP = 8                    # bits more for buckets that are still too large


def key_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5 as a long; a null id counts as an empty key."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def directory(keys: DataFrame, limit: int) -> DataFrame:
    """Shards ``(depth, prefix, shard_bytes, shard_rows, one_key)`` of ``keys(hash, bytes)``."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + _FINER)
    shards, rows = None, keys
    while True:
        cells = (rows.groupBy(F.expr(f"shiftright(hash, {BITS - high})").alias("cell"))
                 .agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi")))
        buckets = (cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
                   .groupBy("depth", F.expr(f"shiftright(cell, {high} - depth)").alias("prefix"))
                   .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"),
                        (F.min("lo") == F.max("hi")).alias("one_key"))
                   .withColumn("splits", (F.col("shard_bytes") > limit) & ~F.col("one_key")))
        buckets = materialise(buckets, "shard-buckets")
        split = buckets.where("splits").select((F.col("depth") + 1).alias("below"), F.col("prefix").alias("parent"))
        fit = buckets.where("not splits").select("depth", "prefix", "shard_bytes", "shard_rows", "one_key")
        leaves = fit.where(F.col("depth") == low).unionByName(
            fit.join(split, (F.col("depth") == F.col("below")) & (F.expr("shiftright(prefix, 1)") == F.col("parent")), "left_semi"))
        shards = leaves if shards is None else shards.unionByName(leaves)
        still = split.where(F.col("below") == high + 1).select(F.col("parent").alias("over"))
        if high == BITS or still.isEmpty():
            return materialise(shards, "shards")
        # Only these buckets' rows are read again; their children start one bit below.
        rows = materialise(rows.join(still, F.expr(f"shiftright(hash, {BITS - high})") == F.col("over"), "left_semi"),
                           "shard-rest")
        low, high = high + 1, min(BITS, high + _STEP)


def sharded(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``rows`` (with doc_id and text, or with doc_id and ``__bytes``) and the columns
    ``shard_id, shard_depth, shard_page, shard_bytes``.

    ``shard_id``: ``s`` and the prefix bits, then ``.page`` for overflow pages
    after the first.  ``shard_bytes``: of the bucket.  A row above half the limit
    has a page to itself where a key needs pages, the others fill theirs by half on
    average or more.  Null texts have 0 bytes; null ids share one key; repeated
    rows share a key and spread over pages if needed; columns of these names
    that ``rows`` has are replaced; an empty table gives no rows.
    """
    if "__bytes" not in rows.columns:
        rows = rows.withColumn("__bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    rows = rows.withColumn("__hash", key_hash(F.col("doc_id"))).drop("shard_id", "shard_depth", "shard_page", "shard_bytes")
    keys = materialise(rows.select(F.col("__hash").alias("hash"), F.col("__bytes").alias("bytes")), "shard-keys")
    shards = directory(keys, limit)
    base = shards.agg(F.min("depth")).first()[0] or 0
    entries = materialise(
        shards.groupBy(F.expr(f"shiftright(prefix, depth - {base})").alias("__base"))
        .agg(F.collect_list(F.struct("depth", "prefix", "shard_bytes", "shard_rows", "one_key")).alias("__below")), "shard-directory")
    placed = (rows.join(entries, F.expr(f"shiftright(__hash, {BITS - base})") == F.col("__base"))
              .withColumn("__shard", F.expr(
                  f"element_at(filter(__below, x -> shiftright(__hash, {BITS} - x.depth) = x.prefix), 1)"))
              .drop("__below", "__base"))
    too_large = (F.col("__shard.shard_bytes") > limit) & (F.col("__shard.shard_rows") > 1)
    if shards.where((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).isEmpty():
        paged = placed.withColumn("shard_page", F.lit(0).cast("long"))
    else:
        over = materialise(placed.where(too_large).withColumn("__row", F.monotonically_increasing_id()), "shard-overflow")
        # A row above half the limit has a page to itself; the others fill pages by running bytes,
        # each page holding those that begin in it, so that it stays below the limit.
        part, large = F.shiftright("__row", 33), F.col("__bytes") * 2 > limit
        over = over.withColumns({"__part": part, "__large": large.cast("long"), "__small": F.when(large, 0).otherwise(F.col("__bytes"))})
        sums = over.groupBy(F.col("__hash").alias("__h"), F.col("__part").alias("__p")).agg(
            F.sum("__small").alias("__sum"), F.max("__small").alias("__top"), F.sum("__large").alias("__count"))
        key, before = Window.partitionBy("__h"), Window.partitionBy("__h").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        sums = sums.select("__h", "__p", zero(F.sum("__sum").over(before)).alias("__before"), zero(F.sum("__count").over(before)).alias("__counted"),
                           F.max("__top").over(key).alias("__most"), F.sum("__sum").over(key).alias("__all"))
        own = Window.partitionBy("__hash", "__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
        room = F.lit(limit) - F.col("__most")
        pages = (over.withColumns({"__own": zero(F.sum("__small").over(own)), "__nth": zero(F.sum("__large").over(own))})
                 .join(sums, (F.col("__hash") == F.col("__h")) & (F.col("__part") == F.col("__p")))
                 .withColumn("shard_page", F.when(F.col("__large") == 1, F.ceil(F.col("__all") / room) + F.col("__counted") + F.col("__nth"))
                             .otherwise(F.floor((F.col("__before") + F.col("__own")) / room))))
        paged = placed.where(~too_large).withColumn("shard_page", F.lit(0).cast("long")).unionByName(
            pages.select(*placed.columns, "shard_page"))
    bits = F.when(F.col("__shard.depth") == 0, F.lit("")).otherwise(
        F.expr("lpad(bin(__shard.prefix), __shard.depth, '0')"))
    return paged.select(
        "*", F.concat(F.lit("s"), bits, F.when(F.col("shard_page") > 0, F.concat(F.lit("."), F.col("shard_page").cast("string")))
                      .otherwise(F.lit(""))).alias("shard_id"),
        F.col("__shard.depth").alias("shard_depth"), F.col("__shard.shard_bytes").alias("shard_bytes")).drop("__shard", "__hash", "__bytes")


def shard_list(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, shard_id, shard_depth, shard_page, shard_bytes) for each row of ``docs``."""
    narrow = materialise(docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "shard-rows")
    return sharded(narrow.withColumn("__bytes", F.col("n_bytes")), limit)


def oracle_sql(limit: int = SHARD_BYTES) -> str:
    """DuckDB SQL for :func:`shard_list` where no key repeats: the shortest prefix that fits."""
    return f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
      CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) AS h FROM documents),
p AS (SELECT *, unnest(range(0, {BITS + 1})) AS depth FROM d),
b AS (SELECT depth, h >> ({BITS} - depth) AS prefix, sum(n_bytes) AS total, min(h) = max(h) AS one FROM p GROUP BY ALL),
leaf AS (SELECT d.doc_id, n_bytes, h, min(b.depth) AS depth FROM d JOIN b ON h >> ({BITS} - b.depth) = b.prefix
      WHERE total <= {limit} OR one GROUP BY ALL)
SELECT leaf.doc_id, n_bytes, 's' || CASE WHEN leaf.depth = 0 THEN '' ELSE
         lpad(bin(h >> ({BITS} - leaf.depth)), CAST(leaf.depth AS INTEGER), '0') END AS shard_id,
       CAST(leaf.depth AS INTEGER) AS shard_depth, CAST(0 AS BIGINT) AS shard_page, CAST(b.total AS BIGINT) AS shard_bytes
FROM leaf JOIN b ON b.depth = leaf.depth AND b.prefix = h >> ({BITS} - leaf.depth)"""
