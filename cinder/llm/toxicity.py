"""Toxicity by a linear-chain conditional random field over tokens.

Only documents carry labels, so tokens are labelled from them: over the labelled
sample Spark counts in how many toxic and clean ones each token
feature (the word, its first 4 and 5 letters, its last 4) occurs; evidence is a
feature that hardly any clean documents hold and more toxic ones than chance
explains (a likelihood ratio against the share of toxic documents).  Near copies
are no independent finds: a feature counts at most once for each pair of
neighbouring words, so a group of copies of one text makes no evidence.  A
token of a toxic document that has an evidence feature is labelled toxic, all
other tokens clean.  The field has two tags, emission weights on evidence
features and a bias, and transition weights; it is fitted by gradient ascent on
the exact log-likelihood (forward-backward) of a bounded sample of token runs.

A text is scored whole: forward-backward marginals give each token's probability
of the toxic tag; the document's score is that of at least one toxic token among
those with evidence; tokens of at least ``TAGGED`` are the offending offsets
(code points).  Tokens without evidence share one emission, so a run of them is
one exact power of the same 2x2 matrix, and long clean texts cost one pass.

Bounds: the classifier is fitted on a seeded sample of about ``TRAIN_DOCS``
labelled documents, on at most ``VOCABULARY`` evidence features (those in the
most toxic documents) and ``RUNS`` token runs of at most ``RUN`` tokens of each
class.  The scoring covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinder.llm.common import id_remainder, unit_draw
from cinder.session import materialise

FOLDS, HELD_OUT = 4, 2       # the remainder of the id's crc32 that is never learnt from
SURPRISE = 16.0              # least likelihood ratio (G squared, one degree of freedom): four standard deviations
EVIDENCE = 0.9               # share of toxic ones among the documents that hold a feature
VOCABULARY = 50_000
TRAIN_DOCS = 10_000
RUNS, RUN = 2_000, 48
ROUNDS = 120
THRESHOLD = 0.3
TAGGED = 0.5
SEED = 5

_TOKEN = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """Features of a lower-cased word."""
    out = ["w:" + word]
    if len(word) > 4:
        out += ["p4:" + word[:4], "s4:" + word[-4:]]
    if len(word) > 5:
        out.append("p5:" + word[:5])
    return out


class Field:
    """Two tags (0 clean, 1 toxic): evidence weights, their bias, transitions and start, all as log potentials."""

    def __init__(self, names: list[str]) -> None:
        self.weight = dict.fromkeys(names, 0.0)
        self.bias = -2.0
        self.move = np.zeros((2, 2))
        self.known: dict[str, float | None] = {}
        self.powers: list[np.ndarray] = []

    def emission(self, word: str) -> float | None:
        """Log potential of the toxic tag; None for a word without evidence."""
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            held = [self.weight[f] for f in features(word) if f in self.weight]
            self.known[word] = self.bias + sum(held) if held else None
        return self.known[word]

    def _power(self, n: int) -> np.ndarray:
        """The message of ``n`` tokens without evidence, each after a transition, scaled to sum to 1."""
        if not self.powers:
            step = np.exp(self.move) * np.exp([0.0, self.bias])
            self.powers.append(step / step.sum())
        out = np.eye(2)
        bit = 0
        while n >> bit:
            if len(self.powers) <= bit:
                p = self.powers[-1] @ self.powers[-1]
                self.powers.append(p / p.sum())
            if n >> bit & 1:
                out = out @ self.powers[bit]
            bit += 1
        return out / out.sum()

    def marginals(self, at: list[int], emissions: list[float], n: int) -> list[float]:
        """P(toxic) of the tokens at places ``at`` of ``n``; the others have no evidence."""
        steps, before, last = [], np.ones(2), -1
        move = np.exp(self.move)
        for place, e in zip(at, emissions, strict=True):
            gap = place - last - 1
            if last < 0:                              # the start: no transition into the first token
                message = before if not gap else np.array([1.0, np.exp(self.bias)]) @ self._power(gap - 1) @ move
            else:
                message = before @ self._power(gap) @ move
            message = message * np.exp(np.array([0.0, e]) - max(e, 0.0))
            before = message / message.sum()
            steps.append(before)
            last = place
        out = [0.0] * len(at)
        after = np.ones(2)
        following = n
        for k in range(len(at) - 1, -1, -1):
            gap = following - at[k] - 1
            if following == n:
                after = self._power(gap) @ np.ones(2)
            else:
                e = emissions[k + 1]
                inner = move @ (after * np.exp(np.array([0.0, e]) - max(e, 0.0)))
                after = self._power(gap) @ inner
            after = after / after.sum()
            both = steps[k] * after
            out[k] = float(both[1] / both.sum())
            following = at[k]
        return out

    def tag(self, text: str | None) -> tuple[float, str]:
        """Score of a whole text, and its offending offsets ``start:end`` (code points)."""
        at, emissions, spans, n = [], [], [], 0
        for token in _TOKEN.finditer((text or "").lower()):
            e = self.emission(token[0])
            if e is not None:
                at.append(n)
                emissions.append(e)
                spans.append(token.span())
            n += 1
        if not at:
            return 0.0, ""
        p = self.marginals(at, emissions, n)
        score = 1.0 - float(np.prod(1.0 - np.array(p)))
        return min(1.0, max(0.0, score)), ",".join(f"{s}:{e}" for (s, e), q in zip(spans, p, strict=True) if q >= TAGGED)

    def fit(self, runs: list[tuple[list[str], list[int]]], rounds: int = ROUNDS) -> None:
        """Gradient ascent on the mean log-likelihood of tagged runs, vectorised over runs."""
        names = list(self.weight)
        number = {f: i for i, f in enumerate(names)}
        longest = max((len(w) for w, _ in runs), default=0)
        if not longest:
            return
        m = len(runs)
        tags = np.full((longest, m), -1)
        held_run, held_at, held_feature = [], [], []
        for r, (words, marks) in enumerate(runs):
            tags[:len(words), r] = marks
            for t, w in enumerate(words):
                for f in features(w):
                    if f in number:
                        held_run.append(r)
                        held_at.append(t)
                        held_feature.append(number[f])
        run, place, feature = np.array(held_run, int), np.array(held_at, int), np.array(held_feature, int)
        open_ = tags >= 0
        weight, bias, move = np.zeros(len(names)), self.bias, np.zeros((2, 2))
        sums = [np.zeros_like(weight), 0.0, np.zeros((2, 2))]
        for _ in range(rounds):
            e = np.full((longest, m), bias)
            np.add.at(e, (place, run), weight[feature])
            toxic, pairs = self._expect(e, move, open_)
            miss = np.where(open_, (tags == 1) - toxic, 0.0)
            slopes = [np.bincount(feature, miss[place, run], minlength=len(names)) - 0.02 * weight,
                      miss.sum(), np.zeros((2, 2))]
            both = open_[1:] & open_[:-1]
            for a in range(2):
                for b in range(2):
                    slopes[2][a, b] = (both & (tags[:-1] == a) & (tags[1:] == b)).sum() - pairs[a, b] - 0.02 * move[a, b]
            for k, g in enumerate(slopes):                # steps scaled by past slopes (AdaGrad)
                sums[k] = sums[k] + g * g
            weight = weight + 0.5 * slopes[0] / np.sqrt(sums[0] + 1e-9)
            bias = bias + 0.5 * slopes[1] / np.sqrt(sums[1] + 1e-9)
            move = move + 0.5 * slopes[2] / np.sqrt(sums[2] + 1e-9)
        self.weight = dict(zip(names, weight.tolist(), strict=True))
        self.bias, self.move = float(bias), move
        self.known, self.powers = {}, []

    @staticmethod
    def _expect(e: np.ndarray, move: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the toxic tag and expected transitions, by forward-backward over all runs at once."""
        n, m = e.shape
        step = np.exp(move)
        emit = np.stack([np.exp(-np.maximum(e, 0)), np.exp(e - np.maximum(e, 0))])       # [tag, place, run]
        ahead = np.empty((n, 2, m))
        ahead[0] = emit[:, 0] / emit[:, 0].sum(axis=0)
        for t in range(1, n):
            a = (step.T @ ahead[t - 1]) * emit[:, t]
            ahead[t] = np.where(open_[t], a / a.sum(axis=0), ahead[t - 1])
        behind = np.ones((2, m))
        toxic, pairs = np.zeros((n, m)), np.zeros((2, 2))
        for t in range(n - 1, -1, -1):
            p = ahead[t] * behind
            toxic[t] = p[1] / p.sum(axis=0)
            if t:
                right = emit[:, t] * behind
                joint = ahead[t - 1][:, None, :] * step[:, :, None] * right[None, :, :]
                pairs += (joint / joint.sum(axis=(0, 1)) * open_[t]).sum(axis=2)
                b = step @ right
                behind = np.where(open_[t], b / b.sum(axis=0), behind)
        return toxic, pairs


def _surprise(found: Column, clean: Column, rate: float) -> Column:
    """Likelihood ratio of ``found`` toxic and ``clean`` clean documents against a share ``rate`` of toxic ones."""
    held = found + clean
    part = lambda n, share: F.when(n > 0, n * F.log(n / (held * F.lit(share)))).otherwise(F.lit(0.0))
    return F.when(found > held * F.lit(rate), 2 * (part(found, rate) + part(clean, 1 - rate))).otherwise(F.lit(0.0))


def _evidence(known: DataFrame) -> tuple[list[str], int, int]:
    """The evidence features, from document counts over the labelled sample."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                for f in {f for w in set(_TOKEN.findall(text.lower())) for f in features(w)}:
                    seen.setdefault(f, [0, 0])[toxic] += 1
            yield pd.DataFrame({"feature": list(seen), "clean": [v[0] for v in seen.values()], "toxic": [v[1] for v in seen.values()]})

    sizes = known.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic = int(sizes["t"] or 0)
    clean = int(sizes["n"]) - toxic
    if not toxic or not clean:
        return [], toxic, clean
    rate = toxic / (toxic + clean)
    counts = known.select("text", "toxic").mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    held = F.col("toxic") + F.col("clean")
    likely = materialise(counts.where((F.col("toxic") + 0.5) / (held + 1.0) >= EVIDENCE)
                         .where(_surprise(F.col("toxic"), F.col("clean"), rate) >= SURPRISE)
                         .orderBy(F.col("toxic").desc(), "feature").limit(VOCABULARY), "toxic-likely")
    shared = known.sparkSession.sparkContext.broadcast(frozenset(r["feature"] for r in likely.select("feature").collect()))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.value
        for batch in batches:
            for text in batch["text"]:
                words = ["", *_TOKEN.findall(text.lower()), ""]
                rows = {(f, f"{before} {after}") for before, word, after in zip(words, words[1:-1], words[2:], strict=False)
                        for f in features(word) if f in wanted}
                yield pd.DataFrame(list(rows), columns=["of_feature", "beside"])

    varied = (known.where("toxic = 1").select("text").mapInPandas(places, "of_feature string, beside string")
              .groupBy("of_feature").agg(F.countDistinct("beside").alias("places")))
    rows = (likely.join(varied, F.col("feature") == F.col("of_feature"))
            .where(_surprise(F.least("toxic", "places"), F.col("clean"), rate) >= SURPRISE)
            .orderBy(F.col("toxic").desc(), "feature").select("feature").collect())
    shared.destroy()
    return [r["feature"] for r in rows], toxic, clean


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """Fit the field on about ``train_docs`` labelled rows that are not held out."""
    marks = (labels.where(F.col("toxic").isNotNull() & (id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
             .groupBy(F.col("doc_id").alias("of_doc")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    marks = materialise(marks, "toxic-labels")
    rate = train_docs / max(1, marks.count())
    # Bounded and written: about ``train_docs`` narrow rows, so that only their texts are moved.
    marks = materialise(marks.where(unit_draw(SEED, F.col("of_doc")) < int(min(1.0, rate) * (1 << 52))), "toxic-sample")
    # Copies count once: a text repeated under many ids is no evidence for its words.
    known = materialise(
        docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(marks, F.col("doc_id") == F.col("of_doc"))
        .groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "toxic-train")
    names, toxic, clean = _evidence(known)
    field = Field(names)
    if not names:
        return field
    shared = known.sparkSession.sparkContext.broadcast(frozenset(names))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = shared.value
        for batch in batches:
            rows = []
            for doc, text, bad in zip(batch["doc_id"], batch["text"], batch["toxic"], strict=True):
                words = _TOKEN.findall(text.lower())
                for k in range(0, len(words), RUN):
                    own = words[k:k + RUN]
                    tags = [int(bad and any(f in evidence for f in features(w))) for w in own]
                    rows.append((doc, k, int(any(tags)), own, tags))
            yield pd.DataFrame(rows, columns=["doc_id", "k", "bad", "words", "tags"])

    runs = known.mapInPandas(cut, "doc_id long, k long, bad int, words array<string>, tags array<int>")
    runs = materialise(runs.withColumn("draw", unit_draw(SEED, F.col("doc_id"), F.col("k")))
                       .where(F.col("draw") < (1 << 52) * F.when(F.col("bad") == 1, 40.0 * RUNS / max(1, toxic))
                              .otherwise(20.0 * RUNS / max(1, toxic + clean))), "toxic-runs")
    sample = [row for bad in (0, 1) for row in
              runs.where(F.col("bad") == bad).orderBy("draw", "doc_id", "k").limit(RUNS).collect()]
    field.fit([(list(r["words"]), list(r["tags"])) for r in sample])
    return field


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, offsets) for each row of ``docs``.

    Null and empty texts score 0; a null doc_id is neither held out nor learnt
    from; labels that contradict each other count as toxic; without toxic or
    without clean training rows every score is 0.  Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("score double, offsets string")
    def tagged(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.tag(t) for t in text], columns=["score", "offsets"])

    return docs.select("doc_id", tagged(F.col("text")).alias("tagged")).select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("tagged.score").alias("score"), (F.col("tagged.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("tagged.offsets").alias("offsets"))
