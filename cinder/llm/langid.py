"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of orders 0 to 4 is counted over training
texts and then frozen.  A text's code length under a language is exact: at each
byte the longest seen context codes it with probability n/(T+q) if it has
followed that context (T: bytes seen after it, q: different ones), otherwise it
codes an escape with q/(T+q) and passes on to the next shorter context; contexts
never seen pass on for nothing; below order 0 stand 256 equal bytes.  The
language with the shortest code wins, and the score is its posterior under equal
priors.

Statistics are frozen, so the cost of a byte depends on the last five bytes
only: costs of all seen five-byte windows are tabled for all languages at once
and texts are scored by vectorised hash-table look-ups inside Arrow batches,
other windows by the same tables of the shorter orders.  Texts are lower-cased
and whole.

Bound: at most ``train_docs`` texts of each language (those with the smallest
seeded draw, as long as they hold at most ``TRAIN_BYTES`` together) are counted.  The
counting runs in Spark; the tree is a written table, of which the driver gets one order
at a time as columns of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinder.llm.common import id_remainder, unit_draw
from cinder.session import materialise

ORDER = 4
TRAIN_DOCS = 600            # of each language
TRAIN_BYTES = 4 << 20       # of each language, longer texts left out
HOLD_OUT = 5                # remainder 0 of the id's crc32 is never learnt from
UNKNOWN = "und"
SEED = 11
_BLOCK = 1 << 20            # bytes scored at a time


def _windows(data: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, packed (the byte lowest)."""
    key = data.astype(np.int64)
    for k in range(1, order + 1):
        key[k:] |= data[:-k].astype(np.int64) << (8 * k)
    return key


def _bytes(text: str) -> bytes:
    """A text as scored: lower case, UTF-8, after ``ORDER`` zero bytes for its start."""
    return b"\0" * ORDER + text.lower().encode("utf-8", "replace")


def count_contexts(texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts of the packed windows of orders 0 to ``ORDER`` over whole texts."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    keys = [_windows(np.frombuffer(_bytes(t), np.uint8), ORDER)[ORDER:] for t in texts]
    top = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    for k in range(ORDER, -1, -1):
        out[k] = np.unique(top & ((1 << (8 * (k + 1))) - 1), return_counts=True)
    return out


class HashTable:
    """Open-addressing look-up from int64 keys to their positions, for arrays of keys."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.at = np.zeros(size, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.longest = 1
        while len(left):
            free = self.keys[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.at[slot[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)
            self.longest += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of ``keys``; -1 where absent."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for _ in range(self.longest):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.at[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


class PpmModel:
    """Frozen context trees of all languages: code lengths in bits.

    Built from order 0 up by ``add_order``; an order's counts are freed before the next one comes.
    """

    def __init__(self, languages: list[str]) -> None:
        self.languages = languages
        self.keys: list[HashTable] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[HashTable] = []
        self.escape: list[np.ndarray] = []

    def add_order(self, gram: np.ndarray, lang: np.ndarray, n: np.ndarray) -> None:
        """The next order's rows: ``n`` times the packed window ``gram`` in language number ``lang``."""
        k, many = len(self.keys), len(self.languages)
        grams, row = np.unique(gram, return_inverse=True)
        ctx, of = np.unique(grams >> 8, return_inverse=True)
        n = n.astype(np.float32)
        total, kinds = np.zeros((len(ctx), many), np.float32), np.zeros((len(ctx), many), np.float32)
        np.add.at(total, (of[row], lang), n)
        np.add.at(kinds, (of[row], lang), np.float32(1))
        direct = np.log2((total + kinds)[of[row], lang]) - np.log2(n)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), np.float32(0))
        if k:
            cost = self.cost[k - 1][self.keys[k - 1].find(grams & ((1 << (8 * k)) - 1))]
        else:
            cost = np.full((len(grams), many), 8.0, np.float32)
        cost += escape[of]
        cost[row, lang] = direct
        self.keys.append(HashTable(grams))
        self.cost.append(cost)
        self.contexts.append(HashTable(ctx))
        self.escape.append(escape)

    def costs(self, windows: np.ndarray) -> np.ndarray:
        """Bits of each window's last byte under each language."""
        out = np.zeros((len(windows), len(self.languages)), np.float32)
        left = np.arange(len(windows))
        for k in range(ORDER, -1, -1):
            keys = windows[left] & ((1 << (8 * (k + 1))) - 1)
            at = self.keys[k].find(keys)
            hit = at >= 0
            out[left[hit]] += self.cost[k][at[hit]]
            left, keys = left[~hit], keys[~hit]
            if not len(left):
                return out
            ctx = self.contexts[k].find(keys >> 8)
            known = ctx >= 0
            out[left[known]] += self.escape[k][ctx[known]]
        out[left] += 8.0
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each whole text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[bytes] = []
        rows: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                starts = np.cumsum([0] + [len(b) for b in held[:-1]])
                cost = self.costs(_windows(np.frombuffer(b"".join(held), np.uint8), ORDER))
                for k in range(ORDER):
                    cost[starts + k] = 0.0                       # the zero bytes, or bytes already counted
                np.add.at(out, rows, np.add.reduceat(cost.astype(np.float64), starts, axis=0))
            held.clear()
            rows.clear()
            size = 0

        for i, text in enumerate(texts):
            data = _bytes(text)
            for at in range(0, max(1, len(data) - ORDER), _BLOCK):   # a very long text in overlapping pieces
                held.append(data[at:at + _BLOCK + ORDER])
                rows.append(i)
                size += len(held[-1])
                if size >= _BLOCK:
                    flush()
        flush()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        bits = self.code_lengths([texts[i] for i in able])
        for i, row in zip(able, bits, strict=True):
            best = int(row.argmin())
            lang[i] = self.languages[best]
            score[i] = float(1.0 / np.exp2(np.maximum(row[best] - row, -1000.0)).sum())
        return lang, score


def training_sample(docs: DataFrame, train_docs: int) -> DataFrame:
    """(lang, text) of at most ``train_docs`` learnable texts of each language and ``TRAIN_BYTES`` of them."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & (id_remainder(F.col("doc_id"), HOLD_OUT) != 0))
    # Written first (a row for each language), so that its real size is known and texts are
    # filtered by the draw where they are read, before any shuffle.
    sizes = materialise(known.groupBy(F.col("lang").alias("of_lang")).agg(F.count("*").alias("n")), "lang-sizes")
    drawn = known.select("lang", "text", unit_draw(SEED, F.col("doc_id")).alias("draw"))
    # Twice the wanted rate first, so that only a few rows of a language reach its window.
    few = drawn.join(sizes, F.col("lang") == F.col("of_lang")).where(
        F.col("draw") / F.lit(float(1 << 52)) * F.col("n") < 2.0 * train_docs)
    by_draw = Window.partitionBy("lang").orderBy("draw", "text")
    first = few.withColumn("nth", F.row_number().over(by_draw)).where(F.col("nth") <= train_docs)
    # Texts up to the limit count towards it in the order of their draws.
    upto = Window.partitionBy("lang").orderBy("nth")
    return (first.withColumn("bytes", F.octet_length("text")).where(F.col("bytes") <= TRAIN_BYTES)
            .withColumn("upto", F.sum("bytes").over(upto)).where(F.col("upto") <= TRAIN_BYTES).select("lang", "text"))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> PpmModel:
    """Count the trees in Spark and freeze them."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                for k, (keys, n) in count_contexts(list(rows["text"])).items():
                    yield pd.DataFrame({"lang": lang, "k": k, "gram": keys, "n": n})

    parts = training_sample(docs, train_docs).mapInPandas(partial, "lang string, k int, gram long, n long")
    tree = materialise(parts.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")), "lang-tree")
    languages = sorted(r["lang"] for r in tree.select("lang").distinct().collect())     # one row a language
    model = PpmModel(languages)
    if not languages:
        return model
    number = F.array_position(F.array(*[F.lit(name) for name in languages]), F.col("lang")) - 1
    for k in range(ORDER + 1):
        # Arrow columns of one order at a time: numbers only, no row objects on the driver.
        rows = tree.where(F.col("k") == k).select("gram", number.cast("int").alias("lang"), "n").toArrow()
        model.add_order(*(rows.column(c).to_numpy() for c in ("gram", "lang", "n")))
    return model


def with_language(docs: DataFrame, model: PpmModel, to: str = "__lang") -> DataFrame:
    """``docs`` and a struct column ``to`` (lang, score); only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        lang, score = shared.value.predict(list(text))
        return pd.DataFrame({"lang": lang, "score": score})

    return docs.withColumn(to, predict(F.col("text")))


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``.

    Null text or no letter: ``und`` with score 0, as is all if nothing can be
    learnt.  A null doc_id is not held out and not learnt from.  Equal code
    lengths: the first language in code-point order.  Repeated rows stay.
    """
    named = with_language(docs.select("doc_id", "text"), train(docs, train_docs))
    return named.select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), HOLD_OUT) == 0, F.lit(False)).alias("held_out"),
        F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"))


def keep_identified(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` without the texts in which no language is found (null or without a letter)."""
    return (with_language(docs, train(docs, train_docs)).where(F.col("__lang.lang") != UNKNOWN)
            .drop("__lang"))
