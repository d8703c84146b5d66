"""Small generators for repeated oracle-SQL fragments (DuckDB dialect).

Only the oracle uses these; Spark plans are built with the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinder.schema import COARSE_MODE, FEATURES
from cinder.operators.coarse import coarse_rule

PK = "grid_row, grid_col"
PYK = "grid_row, grid_col, year"


def round_doubles(df: DataFrame, n: int = 6) -> DataFrame:
    """Round every DOUBLE/FLOAT output column (the oracle does the same)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # pre-round at 10 places first so summation-order noise cannot
            # flip a value that sits on a half step at n places
            out.append(F.round(F.round(F.col(f.name).cast("double"), 10), n).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def rnd(expr: str, n: int = 6) -> str:
    return f"round(round(CAST({expr} AS DOUBLE), 10), {n})"


def mode_cte(name: str, src: str, keys: str, col: str, where: str = "") -> str:
    """Mode of ``col`` per ``keys`` with ties to the lowest value, NULLs ignored."""
    w = f"AND {where}" if where else ""
    return (f"{name} AS (SELECT {keys}, {col} FROM (SELECT {keys}, {col}, row_number() OVER "
            f"(PARTITION BY {keys} ORDER BY count(*) DESC, {col}) AS rn FROM {src} "
            f"WHERE {col} IS NOT NULL {w} GROUP BY {keys}, {col}) t WHERE rn = 1)")


def annual_composite_ctes(src: str = "obs", name: str = "ac") -> str:
    """G1 twin: max fraction, mean predictors, mode b1 per pixel and year."""
    means = ", ".join(f"avg({f}) AS {f}" for f in FEATURES if f not in COARSE_MODE)
    return (f"{name}0 AS (SELECT {PYK}, max(fraction) AS fraction, {means}, "
            f"any_value(longitude) AS longitude, any_value(latitude) AS latitude FROM {src} GROUP BY {PYK}),\n"
            + mode_cte(f"{name}_b1", src, PYK, "b1") + ",\n"
            f"{name} AS (SELECT a.*, m.b1 FROM {name}0 a LEFT JOIN {name}_b1 m USING ({PYK}))")


def coarse_grid_ctes(src: str = "ac", size: float = 1.0, thr: float = 0.05, rules: str = "analytical",
                     name: str = "cg") -> str:
    s = f"CAST({float(size)} AS DOUBLE)"
    snapped = (f"SELECT *, {s} * floor(longitude / {s}) AS big_lon, {s} * floor(latitude / {s}) AS big_lat "
               f"FROM {src} WHERE fraction IS NOT NULL")
    parts = []
    for f in FEATURES:
        r = coarse_rule(f, rules)
        if r == "mode":
            continue
        parts.append(f"{ {'min': 'min', 'max': 'max', 'mean': 'avg'}[r] }({f}) AS {f}")
    keys = "year, big_lon, big_lat"
    return (f"{name}_src AS ({snapped}),\n"
            f"{name}0 AS (SELECT {keys}, avg(CAST(fraction > 0 AS INTEGER)) AS burned_frac_4km, "
            f"avg(fraction) AS frac_4km, {', '.join(parts)} FROM {name}_src GROUP BY {keys}),\n"
            + mode_cte(f"{name}_b1", f"{name}_src", keys, "b1") + ",\n"
            f"{name} AS (SELECT c.*, m.b1, CAST(c.burned_frac_4km >= {thr} AS INTEGER) AS burned_label, "
            f"{s} AS grid_deg, CAST(row_number() OVER (PARTITION BY c.year ORDER BY c.big_lat, c.big_lon) - 1 "
            f"AS BIGINT) AS ID FROM {name}0 c LEFT JOIN {name}_b1 m USING ({keys}))")


def rounded_select(cols_double: list[str], cols_plain: list[str], src: str, n: int = 6,
                   tail: str = "") -> str:
    sel = cols_plain + [f"{rnd(c, n)} AS {c}" for c in cols_double]
    return f"SELECT {', '.join(sel)} FROM {src} {tail}"
