"""Many standardised L2 logistic models in one grouped fit.

Every row belongs to some of the models (a zone at some sampling ratios).  A fit is
Newton's method (iteratively reweighted least squares) for all models together: one
round is one pass over the rows in which each task adds up, for every model it
meets, the loss, the gradient X'(p - y) and the curvature X'WX; the sums are added by
(model, entry) in a shuffle, and the small systems are solved where the sums of a model
meet.  So a round is two jobs' worth of stages whatever the number of models, and no
model scans the rows by itself.

Scale: rows are written once, dealt by group, so that a task holds few groups and its
sums are a small part of its rows; a group of any size spreads over tasks.  The driver
holds coefficients only, (models x columns) numbers.  The penalty makes every system
positive definite; where a full step would raise a model's loss it is halved.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinder.functions.hashing import hash32
from cinder.operators.ranking import bucketed_rank
from cinder.session import materialise

TOLERANCE = 1e-9       # of the largest coefficient step, in standard deviations
MAX_ROUNDS = 50
# Functions that run in tasks travel with the job: executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def indicator_columns(df: DataFrame, col: str, least: int = 0, most: int = 99) -> list[int]:
    """The codes of a categorical column that occur, in order (at most ``most - least + 1``)."""
    code = F.rint(F.col(col)).try_cast("int")
    rows = df.where(code.between(least, most)).select(code.alias("c")).distinct().collect()
    return sorted(r["c"] for r in rows)


def design(features: Sequence[str], codes: dict[str, Sequence[int]]) -> Column:
    """The row's inputs as one array: numeric columns, then an indicator for each code of a
    categorical one (a code outside its list has none)."""
    parts = [F.col(f).cast("double") for f in features if f not in codes]
    parts += [(F.coalesce(F.rint(F.col(f)).try_cast("int"), F.lit(-1)) == c).cast("double") for f in features if f in codes for c in codes[f]]
    return F.array(*parts)


def ratio_roles(df: DataFrame, group: str, key_cols: Sequence[str], label: str, ratios: Sequence[int],
                test_frac: float = 0.1, val_frac: float = 0.2, salt: str = "ratio") -> DataFrame:
    """Add ``role`` (test, val, train, or null for rows no ratio takes) and ``from_ratio``,
    the place in ``ratios`` (ascending) from which on a row belongs to the samples.

    Per group and class, in hash order: the first ``test_frac`` are the fixed test set; of
    the rest all positives count for every ratio and the first ``ratio * n_pos`` negatives
    for each.  Every sample is a prefix of that order, and validation rows are spread
    evenly over it, so each sample has its share of them, exact to one row a class.
    """
    ranked = bucketed_rank(df, [group, label], hash32(salt, *key_cols), list(key_cols), out="_r")
    sizes = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(group)                                      # two rows a group
    held = F.col("_n") - F.ceil(F.col("_n") * F.lit(test_frac))
    sizes = sizes.withColumns({"_test": F.ceil(F.col("_n") * F.lit(test_frac)),
                               "_pos": F.sum(F.when(F.col(label) == 1, held).otherwise(0)).over(own),
                               "_neg": F.sum(F.when(F.col(label) == 0, held).otherwise(0)).over(own)})
    d = ranked.join(sizes.drop("_n"), [group, label])
    place = F.col("_r") - F.col("_test")
    steps = F.array(*[F.lit(int(r)) for r in ratios])
    first = F.when(F.col(label) == 1, F.lit(0)).otherwise(F.size(F.filter(steps, lambda r: r * F.col("_pos") < place)))
    share = val_frac / (1 - test_frac)
    val = F.floor(place * F.lit(share)) > F.floor((place - 1) * F.lit(share))
    role = (F.when(place <= 0, "test").when(first >= len(ratios), F.lit(None))
            .when(val, "val").otherwise("train"))
    return d.withColumns({"role": role, "from_ratio": first.cast("int"), "n_pos_tv": F.col("_pos"), "n_neg_tv": F.col("_neg")}).drop(
        "_r", "_test", "_pos", "_neg")


def _moments(rows: DataFrame, many: int) -> pd.DataFrame:
    """Mean and population deviation of every input for each model (g, m): one aggregate."""
    long = rows.withColumn("m", F.explode(F.sequence(F.col("first"), F.lit(many - 1)))).select("g", "m", F.posexplode("x").alias("j", "v"))
    per = long.groupBy("g", "m", "j").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n"))
    return per.groupBy("g", "m").agg(F.sort_array(F.collect_list(F.struct("j", "mu", "sd", "n"))).alias("s")).toPandas()


class GroupedFit:
    """The coefficients of all models, by (group, ratio place)."""

    def __init__(self, keys: list[tuple], mean: np.ndarray, scale: np.ndarray, rows: np.ndarray, l2: float) -> None:
        self.keys, self.place = keys, {k: i for i, k in enumerate(keys)}
        self.mean, self.scale, self.rows, self.l2 = mean, scale, rows, l2
        self.beta = np.zeros((len(keys), mean.shape[1] + 1))             # the intercept first
        self.rounds = 0

    def raw(self) -> tuple[np.ndarray, np.ndarray]:
        """(intercepts, coefficients) for inputs that are not standardised."""
        coef = self.beta[:, 1:] / self.scale
        return self.beta[:, 0] - (coef * self.mean).sum(axis=1), coef


def _sums(rows: DataFrame, fit: GroupedFit, many: int) -> DataFrame:
    """(i, j, v): entries of loss, gradient and upper curvature of model number ``i`` at ``fit.beta``."""
    place, mean, scale, beta = fit.place, fit.mean, fit.scale, fit.beta
    d = beta.shape[1]
    upper = np.triu_indices(d)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, part in batch.groupby("g", sort=False):
                x, y, first = np.stack(part["x"].to_numpy()), part["y"].to_numpy(float), part["first"].to_numpy()
                for m in range(int(first.min()), many):
                    i = place.get((g, m))
                    if i is None:
                        continue
                    take = first <= m
                    z = np.hstack([np.ones((int(take.sum()), 1)), (x[take] - mean[i]) / scale[i]])
                    t = z @ beta[i]
                    p = 1 / (1 + np.exp(-np.clip(t, -500, 500)))
                    loss = np.logaddexp(0, t).sum() - (y[take] * t).sum()
                    curve = (z * (p * (1 - p))[:, None]).T @ z
                    s = np.concatenate([[loss], z.T @ (p - y[take]), curve[upper]])
                    held[i] = held[i] + s if i in held else s
        for i, s in held.items():
            yield pd.DataFrame({"i": i, "j": np.arange(len(s)), "v": s})

    return rows.select("g", "first", "y", "x").mapInPandas(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def _solved(sums: DataFrame, fit: GroupedFit) -> pd.DataFrame:
    """(i, loss, step): the penalised loss of each model and its Newton step, solved in tasks."""
    beta, l2, d = fit.beta, fit.l2, fit.beta.shape[1]
    upper = np.triu_indices(d)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        i = int(rows["i"].iloc[0])
        s = np.zeros(1 + d + len(upper[0]))
        s[rows["j"]] = rows["v"]
        penalty = np.full(d, l2)
        penalty[0] = 0.0
        b = beta[i]
        curve = np.zeros((d, d))
        curve[upper] = s[1 + d:]
        curve = curve + np.triu(curve, 1).T + np.diag(penalty + 1e-12)
        step = -np.linalg.solve(curve, s[1:1 + d] + penalty * b)
        return pd.DataFrame({"i": [i], "loss": [s[0] + 0.5 * float(penalty @ (b * b))], "step": [step.tolist()]})

    return sums.groupBy("i").applyInPandas(solve, "i int, loss double, step array<double>").toPandas()


def fit_groups(df: DataFrame, group: str, label: str, inputs: Column, first: Column, many: int, l2: float = 1.0,
               tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> GroupedFit:
    """Fit one model for every value of ``group`` and every place ``m < many``: on the group's
    rows with ``first <= m``, minimising the sum of log losses + l2 / 2 * |b|^2 over
    standardised inputs (the intercept is free).

    Rows with a null group, label or input are left out.  Constant inputs get no weight.
    A model whose rows hold one class only is fitted as well: its intercept is held by
    ``max_rounds``; callers leave such groups out.
    """
    rows = df.select(F.col(group).alias("g"), first.alias("first"), F.col(label).cast("double").alias("y"), inputs.alias("x"))
    rows = rows.where("g is not null and y is not null and first is not null").where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    # Dealt by group, large groups over several tasks, so that each task adds up few models.
    rows = materialise(rows.repartitionByRange(F.col("g"), F.xxhash64("x")), "logistic-rows")
    s = _moments(rows, many)
    keys = list(zip(s["g"], s["m"].astype(int)))
    stat = lambda k: np.array([[e[k] for e in row] for row in s["s"]], float)
    sd = stat("sd") if keys else np.zeros((0, 0))
    fit = GroupedFit(keys, stat("mu") if keys else sd, np.where(sd > 0, sd, 1.0), stat("n")[:, 0] if keys else sd, l2)
    if not keys:
        return fit
    base, base_loss, step = fit.beta.copy(), np.full(len(keys), np.inf), np.zeros_like(fit.beta)
    open_ = np.ones(len(keys), bool)
    for fit.rounds in range(1, max_rounds + 1):
        got = _solved(_sums(rows, fit, many), fit).set_index("i").sort_index()
        for i, loss, new in zip(got.index, got["loss"], got["step"]):
            if loss <= base_loss[i] + 1e-9 * abs(loss):
                base[i], base_loss[i], step[i] = fit.beta[i], loss, np.array(new)
            else:                                                        # too far: half the way
                step[i] = step[i] / 2
            open_[i] = np.abs(step[i]).max() > tolerance
            fit.beta[i] = base[i] + step[i]
        if not open_.any():
            break
    return fit


def model_table(spark, fit: GroupedFit, group: str, group_type: str = "int") -> DataFrame:
    """(group, m, intercept, coef) for inputs as they come: one row a model."""
    intercept, coef = fit.raw()
    rows = [(g.item() if hasattr(g, "item") else g, m, float(a), [float(c) for c in b]) for (g, m), a, b in zip(fit.keys, intercept, coef)]
    return spark.createDataFrame(rows, f"{group} {group_type}, m int, intercept double, coef array<double>")


def score_groups(df: DataFrame, models: DataFrame, group: str, inputs: Column, out: str = "p") -> DataFrame:
    """``df`` once for every model of its group, with ``m`` and the probability ``out``: the
    models of a group come as one row's array, so the input is scanned once."""
    packed = models.groupBy(F.col(group).alias("_g")).agg(F.collect_list(F.struct("m", "intercept", "coef")).alias("_models"))
    d = df.withColumn("_x", inputs).join(packed, F.col(group) == F.col("_g")).drop("_g")
    d = d.withColumn("_model", F.explode("_models")).drop("_models")
    products = F.zip_with("_x", F.col("_model.coef"), lambda x, c: x * c)
    margin = F.aggregate(products, F.col("_model.intercept"), lambda a, v: a + v)
    return d.withColumns({"m": F.col("_model.m"), out: 1 / (1 + F.exp(-margin))}).drop("_x", "_model")
