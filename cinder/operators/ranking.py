"""Exact ranks, quotas, running sums and quantiles without single-task windows.

A plain ``row_number().over(Window.partitionBy(g).orderBy(k))`` sorts a whole
group in one task; with a group holding a third of 100 TB that task never ends.
Every helper here splits each group into key buckets first:

1. a row's bucket follows from its key alone: a prefix of a hash key, or its place
   among ``CUTS`` quantiles of all keys (:func:`quantile_bucket`).  Cuts need not be
   exact: they balance the work, ranks come from exact counts;
2. counts (or sums) of each (group, bucket) -> prefix sums over the buckets of a
   group, a small table;
3. the order inside a bucket comes from a window partitioned by (group, bucket),
   and the prefix joins on the same columns, so both share one shuffle.

Everything is lazy: building a query runs no job, nothing passes through the
driver but the cuts (a scalar subquery of ``CUTS - 1`` numbers), and no join is
hinted, so adaptive execution chooses by measured bytes.  A value that many rows
hold is collapsed to (value, count) first or split by ``tie_cols``.  Rows whose
group is NULL belong to no group and are left out of grouped results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 1024          # quantile buckets; no bucket holds over twice the mean of distinct keys
SKETCH_ACCURACY = 8  # rank error of a cut: one part in SKETCH_ACCURACY * CUTS of the rows


def attach_small(d: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Add the columns of ``small`` (one row per value of ``keys``) to ``d``.

    Without keys the one row comes as a scalar subquery: no join and no job while
    the query is built; NULLs if ``small`` is empty."""
    if keys:
        return d.join(small, keys)
    cols = small.columns
    row = small.agg(F.first(F.struct(*cols))).scalar()
    return d.withColumn("_row", row).withColumns({c: F.col("_row")[c] for c in cols}).drop("_row")


def quantile_bucket(d: DataFrame, key_col: str) -> DataFrame:
    """Add ``_b``: how many of the ``CUTS - 1`` approximate quantiles of ``key_col``
    (over all rows, whatever their group) a row's key reaches, by binary search."""
    n = CUTS
    probs = ", ".join(f"{i / n!r}D" for i in range(1, n))
    k = F.col(key_col).cast("double")
    cuts = d.select(k.alias("_key")).agg(
        F.expr(f"percentile_approx(_key, array({probs}), {SKETCH_ACCURACY * n})")).scalar()
    steps = [1 << s for s in reversed(range((n - 1).bit_length()))]

    def narrower(at, step):
        # beyond the last cut (and for a NULL key) the comparison is not true
        return F.when(F.get(F.col("_cuts"), at + step - 1) <= k, at + step).otherwise(at)

    return (d.withColumn("_cuts", cuts)
            .withColumn("_b", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), narrower)).drop("_cuts"))


def _before(d: DataFrame, g: list[str], sums: dict[str, Column], totals: bool = False,
            own: bool = False) -> DataFrame:
    """Per (group, bucket): each sum over all earlier buckets of the group, under its
    name; with ``totals`` over the whole group too as ``{name}_total``, with ``own``
    over the bucket itself as ``{name}_own``."""
    per = d.groupBy(*g, "_b").agg(*[c.alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    out = [F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums]
    if totals:
        out += [F.sum(n).over(Window.partitionBy(*g)).alias(f"{n}_total") for n in sums]
    if own:
        out += [F.col(n).alias(f"{n}_own") for n in sums]
    return per.select(*g, "_b", *out)


def bucketed_rank(df: DataFrame, group_cols, key: Column, tie_cols=(), out: str = "rank",
                  descending: bool = False, bucket: Column | None = None,
                  quota: DataFrame | None = None) -> DataFrame:
    """Exact 1-based ``row_number`` per group ordered by ``key`` (then ``tie_cols``).

    ``bucket``: an integer that never falls as ``key`` grows (a prefix of a hash);
    by default quantile buckets.  ``quota`` (group columns, ``_q`` and any more
    columns, which the rows get too) keeps ranks up to ``_q``: rows of buckets past
    every group's quota go before anything is shuffled."""
    g = list(group_cols)
    d = df.withColumn("_k", -key if descending else key)
    d = d.withColumn("_b", bucket) if bucket is not None else quantile_bucket(d, "_k")
    before = _before(d, g, {"_pre": F.count(F.lit(1))})
    if quota is not None:
        before = attach_small(before, quota, g).where(F.col("_pre") < F.col("_q"))
        d = d.where(F.col("_b") <= before.agg(F.max("_b")).scalar())
    w = Window.partitionBy(*g, "_b").orderBy("_k", *tie_cols)
    ranked = (d.join(before, [*g, "_b"])
              .withColumn(out, (F.col("_pre") + F.row_number().over(w)).cast("bigint")).drop("_k", "_b", "_pre"))
    return ranked if quota is None else ranked.where(F.col(out) <= F.col("_q")).drop("_q")


def first_n(df: DataFrame, group_cols, key: Column, tie_cols, quota: DataFrame | int | float,
            quota_col: str = "quota", bucket: Column | None = None) -> DataFrame:
    """Rows whose rank by ``key`` (ties by ``tie_cols``) is <= the group's quota.

    ``quota``: a number (same for every group) or a DataFrame ``group_cols +
    quota_col`` (one row per group; groups absent get nothing)."""
    g = list(group_cols)
    if isinstance(quota, DataFrame):
        quota = quota.select(*g, F.col(quota_col).alias("_q"))
    else:
        one = df.select(*g).distinct() if g else df.agg(F.count(F.lit(1)))
        quota = one.select(*g, F.lit(quota).cast("double").alias("_q"))
    return bucketed_rank(df, g, key, tie_cols, "_rank", bucket=bucket, quota=quota).select(*df.columns)


def weighted_cumsum(df: DataFrame, group_cols, order_col: str, sum_cols: list[str],
                    descending: bool = False, suffix: str = "_cum", totals: bool = False) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` per group in ``order_col`` order, and
    with ``totals`` the group's sums as ``{col}_total``.

    Rows should already be distinct on ``group_cols + order_col`` (e.g. counts
    per distinct score), so running sums are well defined without ties."""
    g = list(group_cols)
    d = quantile_bucket(df.withColumn("_k", -F.col(order_col) if descending else F.col(order_col)), "_k")
    before = _before(d, g, {f"_p_{c}": F.sum(c) for c in sum_cols}, totals)
    before = before.withColumnsRenamed({f"_p_{c}_total": f"{c}_total" for c in sum_cols})
    w = Window.partitionBy(*g, "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return (d.join(before, [*g, "_b"])
            .withColumns({f"{c}{suffix}": F.col(f"_p_{c}") + F.sum(c).over(w) for c in sum_cols})
            .drop("_k", "_b", *[f"_p_{c}" for c in sum_cols]))


def order_stats(df: DataFrame, value_col: str, positions: DataFrame, group_cols=()) -> DataFrame:
    """Linear-interpolation quantiles at 0-based fractional ``_pos`` per (group, ``_i``).

    ``positions`` has ``group_cols + _i + _pos``.  Values are collapsed to (value,
    count); the bucket counts tell which buckets hold the two order statistics
    around each position, and only values of those buckets are put in order."""
    g = list(group_cols)
    v = F.col(value_col).cast("double")
    values = (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*g, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    d = quantile_bucket(values, "_v")
    lo, hi = F.floor("_pos").cast("bigint") + 1, F.ceil("_pos").cast("bigint") + 1
    wanted = positions.select(*g, "_i", "_pos", F.explode(F.array(
        F.struct(F.lit("lo").alias("s"), lo.alias("r")), F.struct(F.lit("hi").alias("s"), hi.alias("r")))).alias("_x"))
    wanted = wanted.select(*g, "_i", "_pos", F.col("_x.s").alias("_s"), F.col("_x.r").alias("_r"))
    sums = _before(d, g, {"_pre": F.sum("_c")}, own=True)
    if g:
        held = sums.join(wanted, g)
    else:       # a few positions: one array, matched on each bucket
        listed = wanted.agg(F.collect_list(F.struct(*wanted.columns))).scalar()
        held = sums.withColumn("_w", listed).select(*sums.columns, F.inline("_w"))
    held = held.where((F.col("_pre") < F.col("_r")) & (F.col("_r") <= F.col("_pre") + F.col("_pre_own")))
    w = Window.partitionBy(*g, "_b", "_i", "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    at = (d.join(held, [*g, "_b"]).withColumn("_upto", F.col("_pre") + F.sum("_c").over(w))
          .where((F.col("_upto") - F.col("_c") < F.col("_r")) & (F.col("_r") <= F.col("_upto"))))
    both = at.groupBy(*g, "_i", "_pos").agg(F.max(F.when(F.col("_s") == "lo", F.col("_v"))).alias("_vlo"),
                                            F.max(F.when(F.col("_s") == "hi", F.col("_v"))).alias("_vhi"))
    return both.select(*g, "_i", (F.col("_vlo") + (F.col("_pos") - F.floor("_pos"))
                                  * (F.col("_vhi") - F.col("_vlo"))).alias("_q"))


def _totals(df: DataFrame, value_col: str, g: list[str]) -> DataFrame:
    v = F.col(value_col).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float], group_cols=(),
                    prefix: str = "q") -> DataFrame:
    """Linear-interpolation percentiles (``numpy.percentile`` default,
    DuckDB ``quantile_cont``) per group, one row per group with columns
    ``{prefix}0..`` in the order of ``probs``."""
    g = list(group_cols)
    pos = [F.struct(F.lit(i).alias("i"), ((F.col("_n") - 1).cast("double") * F.lit(float(p))).alias("pos"))
           for i, p in enumerate(probs)]
    t = (_totals(df, value_col, g).select(*g, F.explode(F.array(*pos)).alias("_t"))
         .select(*g, F.col("_t.i").alias("_i"), F.col("_t.pos").alias("_pos")))
    q = order_stats(df, value_col, t, g)
    aggs = [F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"{prefix}{i}") for i in range(len(probs))]
    return q.groupBy(*g).agg(*aggs)
