"""Hash-uniform numbers: deterministic, partition-independent replacements for
seeded random draws.

``u = int(first 8 hex digits of md5("<salt>_<k1>_<k2>..."), 16) / 2**32``

The same value is computed by the DuckDB oracle with
``('0x' || substr(md5(concat_ws('_', ...)), 1, 8))::BIGINT / 4294967296.0``,
so every sample, split and fold is reproducible and checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(salt: str, cols) -> Column:
    parts = [F.lit(salt)] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                             for c in cols]
    return F.concat_ws("_", *parts)


def hash32(salt: str, *cols) -> Column:
    """Unsigned 32-bit hash as BIGINT in [0, 2**32)."""
    return F.conv(F.substring(F.md5(_key(salt, cols)), 1, 8), 16, 10).cast("bigint")


def hash_uniform(salt: str, *cols) -> Column:
    """Uniform double in [0, 1) from ``salt`` and key columns."""
    return hash32(salt, *cols).cast("double") / F.lit(TWO_32)


def sql_hash32(salt: str, *cols: str) -> str:
    """DuckDB twin of :func:`hash32` (for oracle SQL)."""
    args = ", ".join([f"'{salt}'"] + list(cols))
    return f"(('0x' || substr(md5(concat_ws('_', {args})), 1, 8))::BIGINT)"


def sql_hash_uniform(salt: str, *cols: str) -> str:
    return f"({sql_hash32(salt, *cols)} / 4294967296.0)"
