"""Labels, bins and categories as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinder.schema import BIN_EPS, BURN_CATEGORIES, FRACTION_BINS, PIXEL_BURN_THRESHOLD


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip01(c) -> Column:
    """Clip to [0, 1] (NULL stays NULL)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(c).cast("double")))


def burned_label(c, threshold: float = PIXEL_BURN_THRESHOLD) -> Column:
    """``fraction > t`` as 0/1 (NULL fraction -> NULL)."""
    return (_c(c) > F.lit(threshold)).cast("int")


def ternary_label(c, threshold: float = PIXEL_BURN_THRESHOLD) -> Column:
    """1 above, 0 below, NULL at exactly the threshold or NULL input."""
    x = _c(c)
    return F.when(x > threshold, F.lit(1)).when(x < threshold, F.lit(0))


def any_burn(c) -> Column:
    """Any burn ``fraction > 0``."""
    return (_c(c) > 0).cast("int")


def fraction_bin(c, eps: float = BIN_EPS) -> Column:
    """0 for <= 0, then the three closed bins with tolerance ``eps``;
    values in the gaps get NULL (and are dropped by callers)."""
    x = _c(c)
    out = F.when(x <= F.lit(0.0 + eps), F.lit(0))
    for b, lo, hi in FRACTION_BINS:
        out = out.when((x >= F.lit(lo - eps)) & (x <= F.lit(hi + eps)), F.lit(b))
    return out


def confusion_label(obs, pred) -> Column:
    """C20: TP / FN / TN / FP; 'NA' when either side is NULL."""
    o, p = _c(obs), _c(pred)
    return (F.when(o.isNull() | p.isNull(), F.lit("NA"))
             .when((p == 1) & (o == 1), F.lit("TP")).when((p == 0) & (o == 1), F.lit("FN"))
             .when((p == 0) & (o == 0), F.lit("TN")).when((p == 1) & (o == 0), F.lit("FP"))
             .otherwise(F.lit("NA")))


def burn_category(c) -> Column:
    """Burn-count category 0 / 1-5 / 6-10 / 11+."""
    n = _c(c)
    return (F.when(n == 0, F.lit(BURN_CATEGORIES[0])).when(n <= 5, F.lit(BURN_CATEGORIES[1]))
             .when(n <= 10, F.lit(BURN_CATEGORIES[2])).otherwise(F.lit(BURN_CATEGORIES[3])))


def burn_frequency_bin(c) -> Column:
    """Frequency bins {1}, then width-4 bins from 2 (2-5, 6-9, ...).

    Returns the bin label ``"1 time"`` or ``"a-b times"``; counts < 1 -> NULL."""
    n = _c(c)
    start = F.lit(2) + F.floor((n - 2) / 4).cast("int") * 4
    return (F.when(n == 1, F.lit("1 time"))
             .when(n >= 2, F.concat(start.cast("string"), F.lit("-"), (start + 3).cast("string"),
                                    F.lit(" times"))))


def sigmoid(c) -> Column:
    """Logistic sigmoid."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def at_threshold(c, t) -> Column:
    """``p >= t`` as 0/1."""
    tt = t if isinstance(t, Column) else F.lit(float(t))
    return (_c(c) >= tt).cast("int")
