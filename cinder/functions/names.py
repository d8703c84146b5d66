"""Band-name helpers (C1-C3): normalise, make unique, fuzzy-match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize_name(c) -> Column:
    """Lower-case and drop everything but ``[a-z0-9]``."""
    x = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def safe_base(c) -> Column:
    """C2 base: NULL/blank -> 'band'; non-word -> '_'; collapse; strip; '' -> 'band'."""
    x = F.col(c) if isinstance(c, str) else c
    t = F.trim(x)
    s = F.regexp_replace(F.regexp_replace(t, "[^a-zA-Z0-9_]", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(x.isNull() | (t == ""), F.lit("band")).when(s == "", F.lit("band")).otherwise(s)


def sanitize_names(df: DataFrame, name_col: str, group_cols, position_col: str,
                   out_col: str = "safe_name") -> DataFrame:
    """Unique safe names within each group (one file's bands): the k-th
    repeat (k >= 2, by position) of a base name gets suffix ``_k``.

    The window is partitioned by (group, base name), i.e. by the repeats of one
    name in one file."""
    d = df.withColumn("_base", safe_base(name_col))
    w = Window.partitionBy(*group_cols, "_base").orderBy(position_col)
    k = F.row_number().over(w)
    return d.withColumn(out_col, F.when(k == 1, F.col("_base"))
                        .otherwise(F.concat(F.col("_base"), F.lit("_"), k.cast("string")))).drop("_base")


def _anchor(c: Column) -> Column:
    """The start of a name, as long as the greatest power of two up to its length ('' for '')."""
    n = F.length(c)
    return F.substring(c, F.lit(1), F.when(n > 0, F.pow(F.lit(2), F.floor(F.log2(n))).cast("int")).otherwise(F.lit(0)))


def _grams(c: Column) -> Column:
    """All different substrings whose length is a power of two, and '': L log L items for a name of L characters."""
    n = F.length(c)
    sizes = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor(F.log2(n)).cast("int")),
                                      lambda e: F.pow(F.lit(2), e).cast("int"))).otherwise(F.array().cast("array<int>"))
    of_size = lambda size: F.transform(F.sequence(F.lit(1), n - size + F.lit(1)), lambda i: F.substr(c, i, size))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(sizes, of_size))))


def match_names(wanted: DataFrame, available: DataFrame, wanted_col: str = "wanted",
                avail_col: str = "name", avail_pos: str = "position", group_cols=()) -> DataFrame:
    """For each wanted name, the available band with the same normalised
    name, else the first band (by position, then name) whose normalised name
    contains or is contained in it.

    A name inside another one starts with an anchor, which is one of the other's
    power-of-two substrings and over half of the name, so both directions are
    equi-joins with the containment test on top.  The first hit is a minimum, not a
    window.  NULL names match nothing; a name without letters and digits is inside
    every other; wanted names without a match have no row."""
    g = list(group_cols)
    w = wanted.select(*g, wanted_col, normalize_name(wanted_col).alias("_wn"))
    a = available.select(*g, avail_col, avail_pos, normalize_name(avail_col).alias("_an"))
    keyed = lambda names, key: names.withColumn("_key", key)
    inside = keyed(w, _anchor(F.col("_wn"))).join(keyed(a, F.explode(_grams(F.col("_an")))), [*g, "_key"]).where(
        F.contains("_an", "_wn"))
    around = keyed(w, F.explode(_grams(F.col("_wn")))).join(keyed(a, _anchor(F.col("_an"))), [*g, "_key"]).where(
        F.contains("_wn", "_an"))
    hit = F.struct((F.col("_wn") != F.col("_an")).cast("int").alias("prio"), F.col(avail_pos).alias("at"), F.col(avail_col).alias("name"))
    first = (inside.select(*g, wanted_col, hit.alias("_hit")).unionByName(around.select(*g, wanted_col, hit.alias("_hit")))
             .groupBy(*g, wanted_col).agg(F.min("_hit").alias("_hit")))
    return first.select(*g, wanted_col, F.col("_hit.name").alias("matched"), F.col("_hit.at").alias(avail_pos))
