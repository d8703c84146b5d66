"""Mixing sources to target weights: subset-sum budget fitting.

Every source gets a share of the corpus size by its weight, at most
``max_repeat`` times its own size.  A source's target is met by whole repeats of
all its documents plus a subset of them that fills the remaining budget:

* documents are counted by (source, exact length) in one combinable aggregate;
* each length first gives its proportional part, rounded down; the residue and
  some 65,536 words of the shortest documents taken so far are fitted by a
  bounded-knapsack dynamic programme over the lengths left (bit sets of reachable
  sums, exact counts);
* of each (source, length) the wanted number of documents is selected by a
  seeded draw: those with the smallest draws.  The cut draw is found from
  sqrt(n) buckets of about sqrt(n) rows each, so a (source, length) that holds a
  third of all rows is neither sorted nor held by one task; equal rows, which share
  their draw, count as one row with a number.

The choice is one row for each (source, length), joined back to the documents;
the programme sees a source's distinct lengths only (at most as many as its
longest document has words), never its documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinder.llm.common import WORD_GAP, unit_draw
from cinder.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)     # by the source's place, repeating
MAX_REPEAT = 3
SEED = 20
FIT_WORDS = 1 << 16           # of each source's budget, about as many words are fitted exactly


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with the length in words and the seeded draw of each row."""
    return docs.withColumns({
        "__size": F.coalesce(F.regexp_count("text", F.lit(WORD_GAP)), F.lit(0)).cast("long"),
        "__draw": unit_draw(seed, F.col("doc_id"), F.col("text"))})


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> with ``target``: shares by weight, none above ``max_repeat`` sizes.

    Sources count from the first by code point, null last.  Resharing the excess
    by weight until no target is above its limit ends where every open source
    has weight times one common level; walking the sources by limit over weight
    finds that level in one pass.  One row for each source passes through.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    limits = (sources.withColumn("weight", weight)
              .withColumn("limit", F.col("source_size") * F.lit(float(max_repeat)))
              .withColumn("ratio", F.col("limit") / F.col("weight")))
    up_to = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    levels = (limits
              .withColumn("level", (F.sum("source_size").over(everything) - F.sum("limit").over(up_to) + F.col("limit"))
                          / (F.sum("weight").over(everything) - F.sum("weight").over(up_to) + F.col("weight")))
              .withColumn("open", F.col("ratio") > F.col("level"))
              .withColumn("common", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("ratio"))).over(everything)))
    return levels.select(
        "source", "source_size",
        F.when(F.col("open"), F.col("weight") * F.col("common")).otherwise(F.col("limit")).alias("target"))


def fit_budget(size: np.ndarray, n: np.ndarray, budget: int) -> np.ndarray:
    """How many of the ``n`` documents of each distinct ``size`` to take so that the sum is next to ``budget``."""
    total = int((size * n).sum())
    take = np.zeros(len(size), np.int64)
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return n.copy()
    take = np.minimum((n * (budget / total)).astype(np.int64), n)
    left = budget - int((size * take).sum())
    while left < 0:                                   # rounding of very large products only
        i = int(np.argmax(take * size))
        take[i] -= 1
        left += int(size[i])
    order = np.argsort(-size, kind="stable")
    for i in order:                                   # at most one more of each length, long ones first
        if 0 < size[i] <= left and take[i] < n[i]:
            take[i] += 1
            left -= int(size[i])
    for i in order[::-1]:                             # give short ones back, so that the programme has a choice
        if size[i] > 0 and left < FIT_WORDS:
            back = min(int(take[i]), -(-(FIT_WORDS - left) // int(size[i])))
            take[i] -= back
            left += back * int(size[i])
    return take + _knapsack(size, n - take, left)


def _knapsack(size: np.ndarray, room: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: counts whose sum is nearest to ``budget`` (the smaller of equals)."""
    out = np.zeros(len(size), np.int64)
    limit = 2 * budget                                # a sum above it is farther off than nothing
    if budget <= 0:
        return out
    keep = (1 << (limit + 1)) - 1
    reach, by = 1, np.full(limit + 1, -1, np.int64)
    bundles: list[tuple[int, int]] = []
    for i in np.argsort(-size, kind="stable"):
        length, most = int(size[i]), int(room[i])
        if length <= 0 or length > limit or most <= 0:
            continue
        most, bundle = min(most, limit // length), 1
        while most > 0 and not reach >> budget & 1:   # bundles of 1, 2, 4, ... and the rest
            count = min(bundle, most)
            most, bundle = most - count, bundle * 2
            new = (reach << (length * count)) & keep & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(bundles)
                bundles.append((int(i), count))
                reach |= new
        if reach >> budget & 1:
            break
    best = next(s for d in range(budget + 1) for s in (budget - d, budget + d) if reach >> s & 1)
    while best:
        i, count = bundles[by[best]]
        out[i] += count
        best -= int(size[i]) * count
    return out


def plan_mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(p_source, p_size, source_size, target, whole, cut) from ``(source, size, draw)`` rows.

    A row of that source and size is taken ``whole`` times, and once more if its
    draw is at most ``cut`` (null: no further).
    """
    lengths = materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    targets = materialise(source_targets(
        lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
        weights, max_repeat), "mix-targets")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size").reset_index(drop=True)
        all_of_it, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = min(int(target // all_of_it), max_repeat) if all_of_it else 0
        budget = round(target - whole * all_of_it) if whole < max_repeat else 0
        rows["whole"] = whole
        rows["take"] = fit_budget(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), budget)
        return rows[["source", "size", "n", "source_size", "target", "whole", "take"]]

    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    plan = materialise(
        lengths.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
        .groupBy("source").applyInPandas(
            fit, "source string, size long, n long, source_size long, target double, whole long, take long"), "mix-plan")

    # The cut: bucket the draws of each (source, size), find the bucket that holds
    # the wanted rank, and rank the different draws of that one bucket.
    some = plan.where("take > 0 and take < n").select(
        F.col("source").alias("c_source"), F.col("size").alias("c_size"), "take",
        F.ceil(F.sqrt("n")).alias("buckets"))
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))
    bucketed = sized.join(some, same).select(
        "c_source", "c_size", "take", "draw",
        F.floor(F.col("draw") / F.lit(float(1 << 52)) * F.col("buckets")).alias("bucket"))
    counts = bucketed.groupBy("c_source", "c_size", "take", "bucket").agg(F.count("*").alias("rows"))
    so_far = Window.partitionBy("c_source", "c_size").orderBy("bucket")
    edge = (counts.withColumn("upto", F.sum("rows").over(so_far))
            .where("upto >= take and upto - rows < take")
            .select(F.col("c_source").alias("e_source"), F.col("c_size").alias("e_size"),
                    F.col("bucket").alias("e_bucket"), (F.col("take") - F.col("upto") + F.col("rows")).alias("nth")))
    # Equal rows share their draw: they collapse to one row with their number before the window.
    in_edge = (bucketed.join(edge, F.col("c_source").eqNullSafe(F.col("e_source"))
                             & (F.col("c_size") == F.col("e_size")) & (F.col("bucket") == F.col("e_bucket")))
               .groupBy("c_source", "c_size", "nth", "draw").agg(F.count("*").alias("copies")))
    upto = F.sum("copies").over(Window.partitionBy("c_source", "c_size").orderBy("draw"))
    cuts = (in_edge.withColumn("upto", upto).where("upto >= nth and upto - copies < nth")
            .select("c_source", "c_size", F.col("draw").alias("cut"), (F.col("nth") - F.col("upto") + F.col("copies")).alias("at_cut"),
                    F.col("copies")))
    top = float(1 << 53)
    return materialise(
        plan.join(cuts, same, "left").select(
            F.col("source").alias("p_source"), F.col("size").alias("p_size"), "source_size", "target", "whole",
            F.when(F.col("take") == F.col("n"), F.lit(int(top))).otherwise(F.col("cut")).alias("cut"),
            F.when(F.col("at_cut") < F.col("copies"), F.col("at_cut")).alias("at_cut")), "mix-choice")


def _chosen(rows: DataFrame, plan: DataFrame, source: str, size: str, draw: str) -> DataFrame:
    """``rows`` with the plan's columns as ``__p_...`` and ``__times``.

    Where only ``at_cut`` of several rows with the draw of the cut are taken, these rows
    are written and numbered: by counts of each file part, then inside the parts, so that
    any number of equal rows spreads over tasks.
    """
    p = plan.select(*[F.col(c).alias(f"__p_{c.removeprefix('p_')}") for c in plan.columns])
    placed = rows.join(p, F.col(source).eqNullSafe(F.col("__p_source")) & (F.col(size) == F.col("__p_size")))
    once = F.coalesce(F.col(draw) <= F.col("__p_cut"), F.lit(False))
    plain = placed.withColumn("__times", F.col("__p_whole") + once.cast("long"))
    if plan.where("at_cut is not null").isEmpty():
        return plain
    tied = F.coalesce((F.col(draw) == F.col("__p_cut")) & F.col("__p_at_cut").isNotNull(), F.lit(False))
    ties = materialise(placed.where(tied).withColumn("__row", F.monotonically_increasing_id()), "mix-ties").withColumn(
        "__part", F.shiftright("__row", 33))
    key = ["__p_source", "__p_size"]
    parts = ties.groupBy(*key, "__part").agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("__p_source").alias("__q_source"), F.col("__p_size").alias("__q_size"),
                         F.col("__part").alias("__q_part"), before.alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*key, "__part").orderBy("__row")) + F.col("__before")
    numbered = (ties.join(parts, F.col("__p_source").eqNullSafe(F.col("__q_source")) & (F.col("__p_size") == F.col("__q_size"))
                          & (F.col("__part") == F.col("__q_part")))
                .withColumn("__times", F.col("__p_whole") + (nth <= F.col("__p_at_cut")).cast("long")))
    return plain.where(~tied).unionByName(numbered.select(*plain.columns))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``.

    Null texts have size 0; a null source is a source of its own, the last; a
    null doc_id is drawn like any other; of rows equal in id and text, which share their
    draw, as many are taken as the budget wants; an empty table gives no rows.
    """
    sized = materialise(_sized(docs.select("doc_id", "source", "text"), seed).select(
        "doc_id", "source", F.col("__size").alias("size"), F.col("__draw").alias("draw")), "mix-sizes")
    return _chosen(sized, plan_mix(sized, weights, max_repeat), "source", "size", "draw").select(
        "doc_id", "size", F.col("__p_source_size").alias("source_size"), F.col("__p_target").alias("target"),
        (F.col("size") * F.col("__times")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: rows repeated, or left out where nothing is taken."""
    sized = materialise(_sized(docs.select("doc_id", "source", "text"), seed).select(
        "source", F.col("__size").alias("size"), F.col("__draw").alias("draw")), "mix-sizes")
    taken = _chosen(_sized(docs, seed), plan_mix(sized, weights, max_repeat), "source", "__size", "__draw")
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times").cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
