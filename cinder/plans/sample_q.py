"""Queries for sampling, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinder.functions.hashing import sql_hash32
from cinder.functions.labels import fraction_bin
from cinder.operators.sampling import (balanced_sample, bernoulli_split, cap_rows, class_guard,
                                       equal_bins, kfold_assign, loyo_folds, nested_negative_sweep,
                                       shuffle_place, stratified_split, unequal_bins, CHECKSUM_MOD)
from cinder.plans.common import obs
from cinder.plans.registry import query
from cinder.schema import NEG_POS_RATIO_FULL
from cinder.sources.tables import with_obs

K = "grid_row, grid_col, year, month"
KEY = ["grid_row", "grid_col", "year", "month"]
KEEP = min(1.0, 100.0 / NEG_POS_RATIO_FULL)


def _strong(spark, sf):
    """Strongly imbalanced label: fully burned pixel-months (fraction >= 1.0)."""
    return obs(spark, sf).withColumn("label", (F.col("fraction") >= 1.0).cast("int"))


STRONG = "(SELECT * REPLACE (CAST(fraction >= 1.0 AS INTEGER) AS label) FROM obs)"


@query("bernoulli_split", with_obs(
    f"SELECT {K}, CASE WHEN u_test < 0.1 THEN 'test' WHEN label = 1 OR u_neg < {KEEP!r} THEN 'train' END AS role "
    "FROM obs"))
def q_bernoulli_split(spark, sf):
    o = obs(spark, sf)
    return bernoulli_split(o, F.col("u_test"), F.col("u_neg")).select(*KEY, "role")


@query("balanced_sample", with_obs(f"""
SELECT {K}, label FROM s WHERE label = 1
UNION ALL
SELECT {K}, label FROM (SELECT *, row_number() OVER (ORDER BY h, {K}) AS rn FROM s WHERE label = 0) t
WHERE rn <= least((SELECT count(*) FROM s WHERE label = 1) * 10.0, (SELECT count(*) FROM s WHERE label = 0))""",
    f"s AS (SELECT {K}, label, {sql_hash32('neg', K)} AS h FROM {STRONG} x)"))
def q_balanced_sample(spark, sf):
    """All positives + exactly min(n_neg, 10 n_pos) negatives."""
    return balanced_sample(_strong(spark, sf).select(*KEY, "label"), KEY)


_BIN_SQL = ("CASE WHEN fraction <= 0.0 + 1e-8 THEN 0 WHEN fraction >= 0.01 - 1e-8 AND fraction <= 0.33 + 1e-8 THEN 1 "
            "WHEN fraction >= 0.34 - 1e-8 AND fraction <= 0.66 + 1e-8 THEN 2 "
            "WHEN fraction >= 0.67 - 1e-8 AND fraction <= 1.00 + 1e-8 THEN 3 END")
_BINNED = f"b AS (SELECT {K}, bin, {sql_hash32('bin', K)} AS h FROM (SELECT *, {_BIN_SQL} AS bin FROM obs) t WHERE bin IS NOT NULL)"


def _binned(spark, sf):
    o = obs(spark, sf).select(*KEY, fraction_bin("fraction").alias("bin"))
    return o.where(F.col("bin").isNotNull())


@query("equal_bins", with_obs(f"""
SELECT {K}, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h, {K}) AS rn FROM b) t
WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM b GROUP BY bin) c)""", _BINNED))
def q_equal_bins(spark, sf):
    return equal_bins(_binned(spark, sf), "bin", KEY)


@query("unequal_bins", with_obs(f"""
SELECT {K}, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h, {K}) AS rn FROM b) t
WHERE bin <> 0 OR rn <= (SELECT count(*) FROM b WHERE bin = 1)""", _BINNED))
def q_unequal_bins(spark, sf):
    return unequal_bins(_binned(spark, sf), "bin", KEY)


def _sweep_sql(steps_values: str, quota_sql: str, group: str = "", step_type: str = "INTEGER") -> str:
    gsel = f"{group}, " if group else ""
    gpart = f"PARTITION BY {group} " if group else ""
    gjoin = f"rk.{group} = st.{group} AND " if group else ""
    ggrp = f"st.{group}, " if group else ""
    return with_obs(f"""
SELECT {ggrp}st.step, st.n_pos, count(rk.r) AS n_neg_selected, coalesce(sum(rk.h % {CHECKSUM_MOD}), 0) AS neg_key_checksum
FROM st LEFT JOIN rk ON {gjoin}rk.r <= st.quota GROUP BY {ggrp}st.step, st.n_pos""", f"""
src AS (SELECT * FROM {STRONG} x),
cnt AS (SELECT {gsel}CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg FROM src {"GROUP BY " + group if group else ""}),
st AS (SELECT {gsel}CAST(step AS {step_type}) AS step, n_pos, CAST({quota_sql} AS BIGINT) AS quota FROM cnt, (VALUES {steps_values}) v(step)),
rk AS (SELECT {gsel}h, row_number() OVER ({gpart}ORDER BY h, {K}) AS r FROM (
        SELECT *, {sql_hash32('neg', K)} AS h FROM src WHERE label = 0) n)""")


PCTS = list(range(10, 101, 10))


@query("neg_ratio_sweep", _sweep_sql(", ".join(f"({p})" for p in PCTS),
                                     "greatest(1, least(round_even(CAST(step AS DOUBLE) / 100.0 * 2.0 * n_pos, 0), n_neg))"))
def q_neg_ratio_sweep(spark, sf):
    """negatives = round(pct/100 * 2 n_pos) for pct 10..100 (nested)."""
    return nested_negative_sweep(
        _strong(spark, sf), KEY, PCTS,
        lambda s, npos, nneg: F.greatest(F.lit(1), F.least(F.rint(s / 100.0 * 2.0 * npos), nneg)))


FRACS = [round(1.0 - 0.1 * i, 1) for i in range(10)]


@query("neg_fraction_sweep", _sweep_sql(", ".join(f"({f!r})" for f in FRACS),
                                        "greatest(1, round_even(step * n_neg, 0))", step_type="DOUBLE"))
def q_neg_fraction_sweep(spark, sf):
    """Keep round(frac * n_neg) negatives, frac 1.0 .. 0.1 (nested)."""
    return nested_negative_sweep(_strong(spark, sf), KEY, FRACS,
                                 lambda s, npos, nneg: F.greatest(F.lit(1), F.rint(s * nneg)))


RATIOS = list(range(1, 11))


@query("neg_pos_ratio_sweep", _sweep_sql(", ".join(f"({r})" for r in RATIOS),
                                         "least(round_even(step * n_pos, 0), n_neg)", group="zone_id"))
def q_neg_pos_ratio_sweep(spark, sf):
    """Per zone, neg:pos target ratio 1..10 capped at the pool (nested)."""
    return nested_negative_sweep(_strong(spark, sf), KEY, RATIOS,
                                 lambda s, npos, nneg: F.least(F.rint(s * npos), nneg), group_cols=["zone_id"])


VAL_SHARE = 0.2 / 0.9


@query("stratified_split", with_obs(f"""
SELECT {K}, label, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + ceil((nc - nt) * CAST({VAL_SHARE!r} AS DOUBLE)) THEN 'val' ELSE 'train' END AS role
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, {K}) AS r, count(*) OVER (PARTITION BY label) AS nc,
             ceil(count(*) OVER (PARTITION BY label) * CAST(0.1 AS DOUBLE)) AS nt
      FROM (SELECT {K}, label, {sql_hash32('split', K)} AS h FROM obs) a) t"""))
def q_stratified_split(spark, sf):
    """Stratified 70/20/10 train/val/test."""
    o = obs(spark, sf).select(*KEY, "label")
    return stratified_split(o, KEY, test_frac=0.1, val_frac=0.2)


@query("kfold_assign", with_obs(f"""
SELECT {K}, label, CAST((row_number() OVER (PARTITION BY label ORDER BY h, {K}) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT {K}, label, {sql_hash32('fold', K)} AS h FROM obs) t"""))
def q_kfold_assign(spark, sf):
    return kfold_assign(obs(spark, sf).select(*KEY, "label"), KEY, 5)


@query("loyo_folds", with_obs(f"""
SELECT fold_year, role, label, count(*) AS n, sum(h2 % {CHECKSUM_MOD}) AS key_checksum FROM (
  SELECT fy AS fold_year, 'test' AS role, label, h2 FROM x JOIN ys ON x.year = ys.fy
  UNION ALL
  SELECT fold_year, CASE WHEN r <= ceil(nc * CAST(0.2 AS DOUBLE)) THEN 'val' ELSE 'train' END, label, h2 FROM (
    SELECT ys.fy AS fold_year, x.label, x.h2,
           row_number() OVER (PARTITION BY ys.fy, x.label ORDER BY x.h, {', '.join('x.' + c for c in KEY)}) AS r,
           count(*) OVER (PARTITION BY ys.fy, x.label) AS nc
    FROM x JOIN ys ON x.year <> ys.fy) t) u
GROUP BY 1, 2, 3""", f"""
x AS (SELECT {K}, label, {sql_hash32('loyo', K)} AS h, {sql_hash32('chk', K)} AS h2 FROM obs),
ys AS (SELECT DISTINCT year AS fy FROM obs)"""))
def q_loyo_folds(spark, sf):
    """Leave-one-year-out roles, summarised per (fold, role, class)."""
    from cinder.functions.hashing import hash32
    o = obs(spark, sf).select(*KEY, "label")
    by_roles = (loyo_folds(o, KEY).groupBy("label", "roles").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pmod(hash32("chk", *KEY), F.lit(CHECKSUM_MOD))).alias("c")))
    return (by_roles.select("label", "n", "c", F.explode("roles").alias("r"))     # a few rows by now
            .groupBy("r.fold_year", "r.role", "label").agg(F.sum("n").alias("n"), F.sum("c").alias("key_checksum")))


@query("cap_negatives", with_obs(f"""
SELECT {K} FROM (SELECT {K}, row_number() OVER (ORDER BY {sql_hash32('cap', K)}, {K}) AS rn FROM obs WHERE label = 0) t
WHERE rn <= 10000"""))
def q_cap_negatives(spark, sf):
    """Cap the negatives used for tuning (10,000 here; 300,000 in production)."""
    neg = obs(spark, sf).where("label = 0").select(*KEY)
    return cap_rows(neg, KEY, 10000)


@query("sample_n", with_obs(f"""
SELECT {K} FROM (SELECT {K}, row_number() OVER (ORDER BY {sql_hash32('sample', K)}, {K}) AS rn FROM obs) t
WHERE rn <= 5000"""))
def q_sample_n(spark, sf):
    """Reproducible random sub-sample of n rows for diagnostics."""
    return cap_rows(obs(spark, sf).select(*KEY), KEY, 5000, salt="sample")


@query("class_guard", with_obs(
    f"SELECT zone_id FROM {STRONG} x GROUP BY zone_id HAVING count(DISTINCT label) = 2"))
def q_class_guard(spark, sf):
    """Zones whose sample has both classes."""
    return class_guard(_strong(spark, sf), ["zone_id"])


@query("shuffle_place", with_obs(f"SELECT {K}, row_number() OVER (ORDER BY {sql_hash32('shuffle', K)}, {K}) AS place FROM obs"))
def q_shuffle_place(spark, sf):
    """H8: every pixel-month's place in a reproducible shuffle."""
    return shuffle_place(obs(spark, sf), KEY).select(*KEY, "place")
