"""Joins of the pipeline.

* E1: an N-way full outer join on shared keys is written as ``unionByName`` +
  one ``groupBy`` (one shuffle for N sources instead of N-1 shuffles, and no
  coalesce chains of join keys).
* E2: a left join guarded by a one-to-one check on the right side's key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinder.operators.geometry import snap


class CardinalityError(ValueError):
    """Raised when a join that must be one-to-one is not."""


def assert_unique(df: DataFrame, keys) -> None:
    """Fail if ``keys`` repeat (one distributed aggregate, a few rows collected)."""
    dup = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if dup:
        raise CardinalityError(f"duplicate keys {keys}: {[tuple(r) for r in dup]}")


def join_predictions(cells: DataFrame, preds: DataFrame, keys, validate: bool = True) -> DataFrame:
    """Left join predictions onto cells, validated one-to-one; rows without
    a prediction keep NULLs (count them with ``pred_prob IS NULL``)."""
    if validate:
        assert_unique(preds, keys)
        assert_unique(cells, keys)
    return cells.join(preds, list(keys), "left")


def label_to_pixels(pixels: DataFrame, cells: DataFrame, size_deg: float, label_col: str = "burned_label",
                    lon_col: str = "longitude", lat_col: str = "latitude") -> DataFrame:
    """Attach the coarse label to each pixel by its snapped cell key."""
    p = pixels.withColumns({"big_lon": snap(lon_col, size_deg), "big_lat": snap(lat_col, size_deg)})
    c = cells.select("year", "big_lon", "big_lat", label_col)
    return p.join(c, ["year", "big_lon", "big_lat"], "left")


def attach_bands(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Inner join of two band stacks on the pixel-month key."""
    return left.join(right, list(keys), "inner")


def join_sources(sources: list[DataFrame], keys, month_col: str = "month") -> DataFrame:
    """Full outer join of per-source tables on ``keys``.

    Sources without ``month_col`` are skipped; rows with NULL or < 1 months are
    dropped.  Each non-key column must come from exactly one source, so
    ``max`` picks that source's value deterministically."""
    usable = [s for s in sources if month_col in s.columns]
    usable = [s.where(F.col(month_col).isNotNull() & (F.col(month_col) >= 1)) for s in usable]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), usable)
    values = [c for c in u.columns if c not in keys]
    return u.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def write_store(sources: dict[str, DataFrame], table: str, path: str, keys, buckets: int, month_col: str = "month") -> None:
    """Keep predictor sources in one table, bucketed and sorted by the pixel-month key,
    a folder for each source.  Values of a source go into its own columns (others are null,
    which Parquet keeps for nothing); a further source is one more append with the same
    buckets.  Sources without ``month_col`` are skipped, rows with NULL or < 1 months dropped."""
    usable = {n: s.where(F.col(month_col).isNotNull() & (F.col(month_col) >= 1)).withColumn("source", F.lit(n))
              for n, s in sources.items() if month_col in s.columns}
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), usable.values())
    (rows.repartition(buckets, *keys).write.mode("append").partitionBy("source").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(table))


def merge_store(store: DataFrame, keys) -> DataFrame:
    """The full outer join of all sources of a store: one grouped aggregate that its buckets
    already serve, so nothing is shuffled.  Keys with a null in them are kept, as groups."""
    values = [c for c in store.columns if c not in (*keys, "source")]
    return store.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])
