"""Document fingerprints by a randomised edit embedding.

A text's characters are walked with shared random bits: at step j the embedded
string holds the current character, and a bit that depends only on j and that
character decides whether the walk moves on to the next one.  Texts at a small
edit distance fall back into step soon after an edit, so edit distance becomes
Hamming distance of the embedded strings (the walk of Chakraborty, Goldenberg
and Koucky).

A fingerprint samples the embedded string: each of ``SAMPLES`` bins owns the
steps that hash to it and keeps the one of smallest rank among the steps the
walk reached, so texts of nearly equal length sample nearly the same steps.  A
sample is four bits of a hash of its character, a fingerprint one hex digit for
each bin.  The likeness of two fingerprints is their share of equal digits.

The bits repeat with a period, which makes the walk a table look-up: from step j
with character class c the next character starts at j + jump[j mod period][c].
The walk is vectorised over the texts of an Arrow batch and reads every
character; between records of the sampled steps nothing is kept.

``edit_pairs`` bands the fingerprints, adds the pairs that share a piece of text
which no allowed edits can avoid, and verifies candidates by their exact edit
distance.  The bands alone are lossy; with the pieces no pair is lost.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinder.session import materialise

SAMPLES = 128
PERIOD = 4096
CLASSES = 256
SEED = 77
BUCKET_DOCS = 4000           # documents of a range of ids, processed together
MAX_RANGES = 1 << 20         # ranges hold more documents beyond 4 billion
BLOCK_CHARS = 1 << 22        # characters walked at a time


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), for arrays."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    return _mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED * 1000 + salt))


class Walk:
    """The shared random choices: jumps of the walk and sampled steps."""

    def __init__(self) -> None:
        steps = np.arange(PERIOD * CLASSES, dtype=np.uint64).reshape(PERIOD, CLASSES)
        moves = (_hash(steps, 1) & np.uint64(1)).astype(bool)            # [step, class]: move on?
        moves[-1] = True                                                 # so that no wait passes the period twice
        jump = np.zeros((PERIOD, CLASSES), np.int64)
        wait = np.ones(CLASSES, np.int64)
        for j in range(2 * PERIOD - 1, -1, -1):                          # backwards, twice round
            wait = np.where(moves[j % PERIOD], 1, wait + 1)
            jump[j % PERIOD] = wait
        self.jump = jump.ravel()
        self.records: list[tuple[np.ndarray, np.ndarray]] = []
        self.reach = 0

    def sampled(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For bins 0..SAMPLES-1 the sampled step below ``length`` (-1: none), by records of the rank."""
        self._extend(length)
        at = np.full(SAMPLES, -1, np.int64)
        for bins, steps in self.records:
            known = steps < length
            at[bins[known]] = steps[known]                               # later records are smaller ranks
        return np.flatnonzero(at >= 0), at[at >= 0]

    def _extend(self, length: int) -> None:
        """Records (bin, step): steps whose rank is the smallest of their bin so far, in order."""
        while self.reach < length:
            steps = np.arange(self.reach, self.reach + (1 << 16), dtype=np.int64)
            bins = (_hash(steps, 2) % np.uint64(SAMPLES)).astype(np.int64)
            rank = _hash(steps, 3)
            if not self.records:
                self.best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
            new_bins, new_steps = [], []
            for b in range(SAMPLES):
                own = np.flatnonzero(bins == b)
                low = np.minimum.accumulate(np.concatenate([self.best[b:b + 1], rank[own]]))
                rec = own[low[1:] < low[:-1]]
                new_bins.append(np.full(len(rec), b))
                new_steps.append(steps[rec])
                self.best[b] = low[-1]
            order = np.argsort(np.concatenate(new_steps), kind="stable")
            self.records.append((np.concatenate(new_bins)[order], np.concatenate(new_steps)[order]))
            self.reach += 1 << 16


_SHARED: list[Walk] = []


def shared_walk() -> Walk:
    """One walk for each worker process."""
    if not _SHARED:
        _SHARED.append(Walk())
    return _SHARED[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classes(points: np.ndarray) -> np.ndarray:
    return (_hash(points, 4) % np.uint64(CLASSES)).astype(np.int64)


def _trails(walk: Walk, texts: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    """For each text (classes of its characters) the step at which each character starts, and the end."""
    trail = [np.zeros(len(t) + 1, np.int64) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = [len(texts[i]) for i in order]
    step = starts[order].copy()
    for i, s in zip(order, step, strict=True):
        trail[i][0] = s
    many, at, block = len(order), 0, 512
    while many and lengths[0] > at:
        while many and lengths[many - 1] <= at:
            many -= 1
        wide = min(block, lengths[0] - at)
        if many > 24:                                    # all open texts, one character at a time
            part = np.zeros((wide, many), np.int64)
            for col, i in enumerate(order[:many]):
                own = texts[i][at:at + wide]
                part[:len(own), col] = own
            seen = np.empty((wide, many), np.int64)
            now = step[:many].copy()
            for k in range(wide):
                now += walk.jump[(now % PERIOD) * CLASSES + part[k]]
                seen[k] = now
            for col, i in enumerate(order[:many]):
                own = min(wide, lengths[col] - at)
                trail[i][at + 1:at + 1 + own] = seen[:own, col]
                step[col] = seen[own - 1, col]
            at += wide
        else:                                            # few long texts are left: one after the other
            jump = walk.jump.reshape(PERIOD, CLASSES).tolist() if not hasattr(walk, "rows") else walk.rows
            walk.rows = jump
            for col, i in enumerate(order[:many]):
                now, own = int(step[col]), texts[i][at:].tolist()
                out = []
                for c in own:
                    now += jump[now % PERIOD][c]
                    out.append(now)
                trail[i][at + 1:] = out
            break
    return trail


def _fingerprint(walk: Walk, points: np.ndarray, trail: np.ndarray) -> str:
    """Samples of the embedded string: hex digits by bin; ``-`` where the walk reached no step of a bin."""
    digits = ["-"] * SAMPLES
    bins, steps = walk.sampled(int(trail[-1]))
    held = np.searchsorted(trail, steps, side="right") - 1
    nibble = _hash(points[held].astype(np.uint64) * np.uint64(1 << 20) + (steps % PERIOD).astype(np.uint64), 5) >> np.uint64(60)
    for b, v in zip(bins, nibble, strict=True):
        digits[b] = f"{int(v):x}"
    return "".join(digits)


def fingerprints_of(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """Fingerprints of whole texts, and their trails."""
    walk = shared_walk()
    points = [_points(t) for t in texts]
    trails = _trails(walk, [_classes(p) for p in points], np.zeros(len(texts), np.int64))
    return [_fingerprint(walk, p, t) for p, t in zip(points, trails, strict=True)], trails


def likeness(a: str, b: str) -> float:
    """Share of equal digits of two fingerprints, over the bins that either reached; two empty texts are alike."""
    held = [(x, y) for x, y in zip(a, b, strict=True) if x != "-" or y != "-"]
    return sum(x == y for x, y in held) / len(held) if held else 1.0


def _edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _compare(texts: list[str], following: list[str]) -> pd.DataFrame:
    """Fingerprints of texts, of their edited texts and of the texts that follow them."""
    walk = shared_walk()
    own, trails = fingerprints_of(texts)
    # An edited text shares its first two thirds, and so the walk over them.
    kept = [len(t) - len(t) // 3 for t in texts]
    tails = [f[:len(t) // 3] for t, f in zip(texts, following, strict=True)]
    starts = np.array([int(t[k]) for t, k in zip(trails, kept, strict=True)], np.int64).reshape(len(texts))
    tail_points = [_points(t) for t in tails]
    tail_trails = _trails(walk, [_classes(p) for p in tail_points], starts)
    rows = []
    for i, t in enumerate(texts):
        points = np.concatenate([_points(t)[:kept[i]], tail_points[i]])
        print_ = _fingerprint(walk, points, np.concatenate([trails[i][:kept[i]], tail_trails[i]]))
        sha = hashlib.sha256(_edited(t, following[i]).encode("utf-8", "surrogatepass")).hexdigest()
        rows.append((len(t), sha, own[i], print_, likeness(own[i], print_)))
    return pd.DataFrame(rows, columns=["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited"])


def _ranges(ids: DataFrame) -> tuple[list[int], DataFrame]:
    """Ranges of ``ids(doc_id)`` in two levels: cuts between coarse ranges, and for each
    coarse range a row ``(in_coarse, cuts, heads, closes)``: the cuts between its fine
    ranges, each fine range's largest id, and the fine range that this id closes.

    A fine range is numbered coarse * side + fine, ascending by id; about
    sqrt(ranges) coarse ranges hold about as many fine ones each.
    """
    n = ids.count()
    many = min(MAX_RANGES, max(1, -(-n // BUCKET_DOCS)))
    side = max(1, math.isqrt(many - 1) + 1)
    shares = [i / side for i in range(1, side)] or [0.5]
    first = (ids.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []) if side > 1 else []
    coarse_cuts = sorted(set(first))                                     # fewer than sqrt(MAX_RANGES) values
    placed = ids.withColumn("coarse", _place(F.col("doc_id"), coarse_cuts))
    inner = F.array_sort(F.array_distinct(F.percentile_approx("doc_id", shares, 10_000)))
    cuts = materialise(placed.groupBy(F.col("coarse").alias("in_coarse")).agg(
        (inner if side > 1 else F.array().cast("array<bigint>")).alias("cuts")), "edit-cuts")
    heads = (placed.join(F.broadcast(cuts), F.col("coarse") == F.col("in_coarse"))
             .groupBy((F.col("coarse") * side + _fine()).alias("range")).agg(F.max("doc_id").alias("head")))
    # One row for each range.  The largest id of a range follows the smallest of the next higher one.
    order = Window.orderBy("range")
    heads = heads.withColumn("closes", F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy())))
    by_coarse = heads.groupBy(F.floor(F.col("range") / side).cast("int").alias("of_coarse")).agg(
        F.collect_list(F.struct("range", "head", "closes")).alias("heads"))
    table = cuts.join(by_coarse, F.col("in_coarse") == F.col("of_coarse")).drop("of_coarse")
    return coarse_cuts, materialise(table.withColumn("side", F.lit(side)), "edit-ranges")


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of ``cuts`` are below ``value``."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < value))


def _fine() -> Column:
    return F.size(F.filter("cuts", lambda c: c < F.col("doc_id")))


def next_documents(docs: DataFrame) -> DataFrame:
    """(bucket, lead, doc_id, text, has_id): documents dealt by ranges of doc_id, each range with the
    first document of the one after it (``lead``), so that every document's successor by
    descending id stands in its own range.

    Ranges hold about ``BUCKET_DOCS`` rows; their table has at most ``MAX_RANGES``
    entries of 24 bytes, so it is broadcast.  The last range is followed by the first
    document of all.
    """
    ids = docs.select("doc_id").where("doc_id is not null")
    coarse_cuts, ranges = _ranges(ids)
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "has_id").where("doc_id is not null")
            .withColumn("coarse", _place(F.col("doc_id"), coarse_cuts))
            .join(F.broadcast(ranges), F.col("coarse") == F.col("in_coarse"))
            .withColumn("own", F.col("coarse") * F.col("side") + _fine()))
    own = F.struct(F.col("own").alias("bucket"), F.lit(0).alias("lead"))
    also = F.transform(F.filter("heads", lambda h: h["head"] == F.col("doc_id")),
                       lambda h: F.struct(h["closes"].alias("bucket"), F.lit(1).alias("lead")))
    return (rows.select("doc_id", "text", "has_id", F.explode(F.concat(F.array(own), also)).alias("at"))
            .select("at.bucket", "at.lead", "doc_id", "text", "has_id"))


def compare_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Null texts count as empty.  Rows that repeat a doc_id follow one another in
    the order of their texts; of the last of them the successor is the next id.
    Rows with a null doc_id come after all others, as if they shared one smallest id;
    rows of one id are compared in one task.  A single document follows itself.  An empty table gives no rows.
    """
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None                 # the last row waits for its successor

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            """All rows but the last, compared with the row after them."""
            texts = list(rows["text"])
            out = _compare(texts[:-1], texts[1:])
            after = fingerprints_of(texts[-1:])[0]
            prints = [*out["fingerprint"], *after]
            out["near_next"] = [likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)]
            out.insert(0, "doc_id", rows["doc_id"].astype("Int64").where(rows["has_id"])[:-1])
            same = (rows["bucket"].to_numpy()[:-1] == rows["bucket"].to_numpy()[1:]) & (rows["lead"].to_numpy()[:-1] == 0)
            return out[same]

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = rows.iloc[-1:].reset_index(drop=True)
            block = rows["text"].str.len().cumsum() // BLOCK_CHARS
            edges = [0, *(np.flatnonzero(block.to_numpy()[1:] != block.to_numpy()[:-1]) + 1).tolist(), len(rows) - 1]
            for first, last in zip(edges, edges[1:], strict=False):
                if last > first:
                    yield done(rows.iloc[first:last + 1].reset_index(drop=True))

    # A null id stands below every other; whether a row has one is told beside it.
    least = F.lit(-(1 << 63)).cast("long")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc_id"), "text", F.col("doc_id").isNotNull().alias("has_id"))
    rows = next_documents(keyed).repartition("bucket").sortWithinPartitions(
        "bucket", "lead", F.col("doc_id").desc(), F.col("has_id").desc(), "text")
    return rows.mapInPandas(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                     "edited_fingerprint string, near_edited double, near_next double")


BANDS, BAND_DIGITS = 96, 5
LIKE = 0.35


PIECE_CLASSES = (1, 100, 400)     # lengths of the longer text from which longer pieces are certain
FEW_EDITS = 50
LONGEST_RUN = 64                  # windows of pieces are no longer, also where longer runs are certain


def _same(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _may_be_within(a: str, b: str, most: int) -> bool:
    """False only if ``b`` has more pieces that ``a`` has nowhere than ``most`` edits can touch."""
    size = 10
    if len(b) // size <= most or len(a) < size:
        return True
    grams = []
    for points in (_points(a), _points(b)):
        gram = np.zeros(len(points) - size + 1, np.uint64)
        for o in range(size):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + points[o:len(points) - size + 1 + o]
        grams.append(gram)
    return int((~np.isin(grams[1][::size], grams[0])).sum()) <= most


def _few_edits(a: str, b: str, most: int) -> int | None:
    """Edit distance if at most ``most``, by the farthest places reached on each diagonal (for few edits)."""
    goal = len(b) - len(a)

    def run(i: int, j: int) -> int:
        step = 16
        while a[i:i + step] == b[j:j + step]:
            i, j, step = i + step, j + step, step * 2
            if i >= len(a) or j >= len(b):
                return min(len(a), len(b) - j + i)
        return i + _same(a[i:i + step], b[j:j + step])

    reach = {0: run(0, 0)}
    for edits in range(most + 1):
        if reach.get(goal, -1) >= len(a):
            return edits
        after = {}
        for d in range(max(-edits - 1, -len(a)), min(edits + 1, len(b)) + 1):        # j - i
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            i = min(i, len(a), len(b) - d)
            if i >= max(0, -d):
                after[d] = run(i, i + d)
        reach = after
    return None


def edit_distance_within(a: str, b: str, most: int) -> int | None:
    """Edit distance of two texts if at most ``most``, else None.

    What both texts begin and end with is cut off first.  A few edits are looked for
    along diagonals; for more, the columns of the distance matrix are bit vectors in
    integers (Myers, Hyyro).
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return None
    same = _same(a, b)
    a, b = a[same:], b[same:]
    same = _same(a[::-1], b[::-1])
    a, b = a[:len(a) - same], b[:len(b) - same]
    if not a:
        return len(b)
    if not _may_be_within(a, b, most):
        return None
    few = min(most, FEW_EDITS)
    if (found := _few_edits(a, b, few)) is not None or few == most:
        return found
    held: dict[str, int] = {}
    for c in set(a) & set(b):
        held[c] = int("".join("1" if x == c else "0" for x in reversed(a)), 2)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score, left = full, 0, len(a), len(b)
    for c in b:
        equal = held.get(c, 0)
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, lower = minus | (full & ~(across | plus)), plus & across
        score += bool(up & top) - bool(lower & top)
        left -= 1
        if score - left > most:
            return None
        up = (up << 1 | 1) & full
        lower = lower << 1 & full
        plus, minus = lower | (full & ~(down | up)), up & down
    return score


def certain_run(least: int, share: float) -> int:
    """Length of an exact piece that any two texts within ``share`` of the longer one's length must share,
    if that length is at least ``least``: k edits leave at least n - k characters in at most k + 1 runs."""
    many = max(4000, 2 * least)
    runs = [-(-(n - k) // (k + 1)) for n in range(least, many) if (k := int(share * n))]
    return min([*runs, math.ceil((1 - share) * many / (share * many + 1) - 1e-9), LONGEST_RUN])


def _pieces(points: np.ndarray, share: float, runs: list[int]) -> dict[int, tuple[int, int]]:
    """Keys of a text, each with its first and last place: of every window of a certain run the piece of smallest hash.

    A run in two texts has the same windows and so the same smallest pieces, as far
    apart in the texts as the run.  A text has keys for each class of lengths that
    the longer text of a pair may have.
    """
    out: dict[int, tuple[int, int]] = {}
    n = len(points)
    longest = int(n / (1 - share)) + 2
    for number, run in enumerate(runs):
        above = PIECE_CLASSES[number + 1] if number + 1 < len(runs) else longest + 1
        if longest < PIECE_CLASSES[number] or n >= above or not int(share * longest) or n < run:
            continue
        size = run // 2 + 1
        gram = np.zeros(n - size + 1, np.uint64)
        for o in range(size):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + points[o:n - size + 1 + o]
        gram = _hash(gram, 10 + number)
        windows = np.lib.stride_tricks.sliding_window_view(gram, run - size + 1)
        places = np.unique(np.arange(len(windows)) + windows.argmin(axis=1))
        keys, which = np.unique(gram[places], return_inverse=True)
        first, last = np.full(len(keys), n), np.zeros(len(keys), np.int64)
        np.minimum.at(first, which, places)
        np.maximum.at(last, which, places)
        out.update(zip(keys.view(np.int64).tolist(), zip(first.tolist(), last.tolist(), strict=True), strict=True))
    return out


def _piece_pairs(texts: DataFrame, share: float) -> DataFrame:
    """(a, b): all texts that share a certain piece at places and with lengths that the distance allows."""
    runs = [certain_run(least, share) for least in PIECE_CLASSES]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                rows = []
                for doc, text in zip(batch["doc_id"][at:at + 200], batch["text"][at:at + 200], strict=True):
                    n = len(text)
                    rows += [(key, doc, n, first, last)
                             for key, (first, last) in _pieces(_points(text), share, runs).items()]
                yield pd.DataFrame(rows, columns=["key", "doc_id", "n", "first", "last"])

    pieces = texts.mapInPandas(cut, "key long, doc_id long, n int, first int, last int")
    most = f"cast({float(share)!r}D * greatest(x.n, y.n) as int)"
    x, y = pieces.alias("x"), pieces.alias("y")
    return (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") < F.col("y.doc_id")) & F.expr(
        f"abs(x.n - y.n) <= {most} and x.first - y.last <= {most} and y.first - x.last <= {most}"))
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")))


def edit_pairs(docs: DataFrame, share: float = 0.05) -> DataFrame:
    """(a, b, distance): ids a < b of texts within an edit distance of ``share`` of the longer
    text, found by bit-sampled banding and by certain pieces, and verified exactly.

    Equal texts collapse to their smallest doc_id first: each copy has one row with that id
    and distance 0 (membership), links between different texts are between these ids.
    Each band is 5 digits sampled with a fixed seed, none of a step that the walk does not
    reach; texts that share a band and whose reached digits are alike in at least ``LIKE``
    are verified, and so are all that share a piece which the allowed edits cannot avoid,
    so that every pair is found.  Texts too short to differ by one allowed edit from any
    other are in neither join.  Null and empty texts and null ids have no rows; an empty
    table gives none.
    """
    if not 0 <= share < 1:
        raise ValueError("share must be at least 0 and below 1")
    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(fingerprint=fingerprints_of(list(batch["text"]))[0])

    named = docs.where("doc_id is not null and text <> ''").select("doc_id", "text")
    texts = named.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("ids"))
    copies = (named.join(texts.where("ids > 1").select(F.col("text").alias("of_text"), F.col("doc_id").alias("rep")), F.col("text") == F.col("of_text"))
              .where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(0).cast("long").alias("distance")).distinct())
    # The longest text within the distance must allow an edit.
    texts = texts.where(F.floor(F.lit(share) * F.floor(F.char_length("text") / F.lit(1 - share) + 2)) >= 1).select("doc_id", "text")
    printed = materialise(texts.mapInPandas(prints, "doc_id long, text string, fingerprint string"), "edit-prints")
    rng = random.Random(SEED)
    picks = [rng.sample(range(1, SAMPLES + 1), BAND_DIGITS) for _ in range(BANDS)]
    bands = printed.select("doc_id", "fingerprint", F.explode(F.array(*[
        F.concat(F.lit(f"{i}:"), *[F.substring("fingerprint", at, 1) for at in pick]) for i, pick in enumerate(picks)])).alias("band")).where("instr(band, '-') = 0")
    x, y = bands.alias("x"), bands.alias("y")
    reached = lambda both: f"size(filter(sequence(1, {SAMPLES}), i -> {both}))"
    one, two = "substring(x.fingerprint, i, 1)", "substring(y.fingerprint, i, 1)"
    alike = F.expr(f"""{reached(f"{one} = {two} and {one} <> '-'")} >= {LIKE} * {reached(f"{one} <> '-' or {two} <> '-'")}""")
    pairs = (x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.doc_id") < F.col("y.doc_id")) & alike)
             .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
             .unionByName(_piece_pairs(printed.select("doc_id", "text"), share)).distinct())
    left = printed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = printed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    @F.pandas_udf("long")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edit_distance_within(s, t, int(share * max(len(s), len(t)))) for s, t in zip(a, b, strict=True)], dtype="Int64")

    return (pairs.join(left, "a").join(right, "b").withColumn("distance", distance("text_a", "text_b"))
            .where("distance is not null").select("a", "b", "distance").unionByName(copies))
