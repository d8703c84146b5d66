"""SimHash near-dedup: fingerprints, segment-popcount range join, components.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the vector of the
segments' bit counts is an embedding in which the Manhattan distance never
exceeds the number of differing bits (one flipped bit changes one count by
one).  Fingerprints within ``max_bits`` therefore lie within that Manhattan
distance, so a range join on the integer grid of count vectors finds every such
pair, and ``bit_count(xor)`` decides exactly.

Range join: each distinct fingerprint is put into its own cell and the 32 cells
one step away.  Two vectors at Manhattan distance 0, 1 or 2 share a cell, and
the roles (own cell, one step down, one step up) are matched so that a pair
meets in one cell, or two.  The join is an equi-join on the cell (33 narrow rows
for each distinct fingerprint), never all pairs; copies collapse before it.
Both sides are shuffled: Spark's estimate of a side is that of the fingerprints
before the 33 rows, by which it would send 33 times its limit through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinder.llm.common import drop_ids
from cinder.llm.components import connected_components
from cinder.session import materialise

SHINGLE_WORDS = 3
MAX_BITS = 2
SEGMENTS = 16
SEED = 42
_BLOCK = 1 << 15          # shingles whose bits are counted at a time


def fingerprint_of(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash as a signed 64-bit integer; 0 for null and for no words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()     # bytes: A-Z and ASCII space only
    if not words:
        return 0
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _BLOCK):
        part = words[at:min(at + _BLOCK, n) + shingle - 1]
        raw = b"".join([digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(shingle)), strict=False)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; text is read whole, other columns are not read."""
    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in text], dtype="int64")

    return docs.select("doc_id", fp(F.col("text")).alias("fp"))


# Packed offsets (3 bits a segment): stay, one step down, one step up in each segment.
_STEPS = [0] + [sign << (3 * i) if sign > 0 else -(1 << (3 * i)) for i in range(SEGMENTS) for sign in (-1, 1)]


def near_pairs(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)`` of ``rep`` whose ``fp`` differ in at most ``max_bits`` (1 or 2) bits.

    ``points(fp, rep)`` holds each fingerprint once.
    """
    if max_bits not in (1, 2):
        raise ValueError("the cells one step away cover 1 or 2 differing bits")
    # Counts of 0..4 are stored plus 1 in 3 bits each, so that a step never carries.
    own = None
    for i in range(SEGMENTS):
        count = F.bit_count(F.shiftrightunsigned("fp", 4 * i).bitwiseAND(F.lit(15).cast("long"))).cast("long")
        part = F.shiftleft(count + F.lit(1).cast("long"), 3 * i)
        own = part if own is None else own + part
    cells = points.select(
        "fp", "rep", own.alias("own"),
        F.explode(F.array(*[F.lit(s).cast("long") for s in _STEPS])).alias("step"))
    cells = cells.select("fp", "rep", "step", (F.col("own") + F.col("step")).alias("cell"))
    x, y = cells.alias("x"), cells.alias("y")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits
    ordered = F.col("x.rep") < F.col("y.rep")
    xs, ys = F.col("x.step"), F.col("y.step")
    role = (((xs == 0) & (ys == 0) & ordered)                        # equal count vectors
            | ((xs < 0) & (ys < 0) & (xs != ys) & ordered)           # one up, one down
            | ((xs < 0) & (ys >= 0)))                                # x has one or two bits more
    return (x.join(y.hint("merge"), (F.col("x.cell") == F.col("y.cell")) & role & near)
            .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
            .distinct())


def simhash_components(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits.  Null and empty texts have fingerprint 0 and
    link like any other; repeated rows stay repeated; a row with a null doc_id
    makes no link and takes its fingerprint's component, null if no row with an
    id has that fingerprint.  An empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, shingle), "simhash-fps")
    points = materialise(
        fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "simhash-points")
    joined = connected_components(near_pairs(points, max_bits))
    classes = (points.join(joined.hint("merge"), points.rep == joined.node, "left")
               .select(F.col("fp").alias("class_fp"), F.coalesce("label", "rep").alias("component_id")))
    return (fps.join(classes.hint("merge"), fps.fp == classes.class_fp, "left")
            .select("doc_id", "fp", "component_id"))


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row left of each component: the one with the smallest doc_id.

    Rows with a null doc_id belong to no group and stay; of rows that repeat a
    doc_id one stays: the one with the smallest text, then the smallest other columns.
    """
    groups = simhash_components(docs, shingle, max_bits).where("doc_id is not null")
    gone = materialise(
        groups.where("doc_id <> component_id").select("doc_id").distinct(), "simhash-gone")
    repeats = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    left = drop_ids(docs, gone)
    again = materialise(repeats.select("doc_id"), "simhash-repeats")
    if again.isEmpty():
        return left
    once = left.join(again.select(F.col("doc_id").alias("__again")), F.col("doc_id") == F.col("__again"), "left_semi")
    # Ordered by content, so that reruns keep the same row; equal rows are the same whichever stays.
    rest = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    one = once.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]),
                                              F.struct(F.coalesce("text", F.lit("")), F.col("text").isNotNull(), *rest)).alias("__one"))
    return drop_ids(left, again).unionByName(one.select("__one.*"))
