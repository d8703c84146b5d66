"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = "[^\\x20\\x09-\\x0D]+"      # a word: a run without ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def unit_draw(seed: int, *keys: Column) -> Column:
    """A seeded draw in [0, 2**52) as a long: the same for the same keys, null keys included."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12)


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (one column, distinct).

    ``ids`` should be a written table: its real size then lets Spark broadcast a
    small one and shuffle only where it is large.  Rows with a null doc_id stay.
    """
    gone = ids.select(F.col(ids.columns[0]).alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def int64_array(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])
