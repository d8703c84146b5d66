"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidate spans come from strict base patterns and from wider ones.  Labelers
vote on each candidate: its pattern, a plausibility rule, a gazetteer of endings
or prefixes, the words before it, and its edges.  Votes are counted by pattern
over all documents (kinds times vote patterns, a few hundred rows, whatever the
corpus); expectation-maximisation over those counts estimates each labeler's
reliabilities per kind and the posterior of each pattern; a logistic span
classifier is trained on votes and kinds against these posteriors; candidates
that it accepts join the base spans, which always stay.

Scale: texts are scanned once, by Java regular expressions that cannot backtrack
over long runs; candidates with their votes are written to the shared folder;
everything after works on them.  Documents are rows throughout: no shuffle but
that of the counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinder.session import materialise

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  Possessive repeats and look-behinds match the same places as
# the plain patterns, but in time linear in the text and without recursion.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns: spelt-out addresses, eight-group addresses, dotted card numbers, numbers without a plus.
WIDER = {
    "email": rf"(?<![{_LOCAL}])[A-Za-z0-9][{_LOCAL}]*+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:[.][0-9]{4}){3}(?![0-9.])|(?<![0-9])3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# Cheap tests that must hold where a pattern has a match.
_NEEDS = {"email": "contains(text, '@')", "ip": "contains(text, '.')", "card": "true", "phone": "contains(text, '+')"}

# Endings, prefixes and words that speak for or against a kind.
ENDINGS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|ch|at|it|nl|example|test"
CARD_PREFIXES = "3[47]|4|5[1-5]|2[2-7]|6"
WORDS_FOR = {"email": "mail|email|e-mail|contact|write", "ip": "ip|host|server|address|client",
             "card": "card|visa|mastercard|amex|credit|carte|tarjeta|karte", "phone": "call|tel|phone|mobile|fax|telefon"}
WORDS_AGAINST = "version|release|isbn|order|invoice|serial|token|password|key|sha|id"
LABELERS = ("pattern", "plausible", "gazetteer", "context", "edges", "against")
ACCEPT = 0.5
ROUNDS = 50
_CHUNK = 256
_SPAN = "struct<kind: int, at: bigint, m: string, before: string, after: string>"


def _spans(kind: int, ms: str, ps: str, starts: str) -> str:
    """SQL: the matches ``ms`` with their places, from the pieces ``ps`` between them."""
    size = "char_length(x.gap) + char_length(x.m)"
    return f"""flatten(transform({_chunks(ms, ps)}, (c, n) -> aggregate(c,
        named_struct('at', get({starts}, n), 'out', cast(array() AS array<{_SPAN}>)),
        (a, x) -> named_struct('at', a.at + {size}, 'out', array_append(a.out, named_struct(
            'kind', {kind}, 'at', a.at + char_length(x.gap), 'm', x.m, 'before', right(x.gap, 24), 'after', x.after))),
        a -> a.out)))"""


def _chunks(ms: str, ps: str) -> str:
    return (f"transform(CASE WHEN size({ms}) > 0 THEN sequence(0, (size({ms}) - 1) div {_CHUNK}) ELSE cast(array() AS array<bigint>) END, "
            f"b -> transform(slice({ms}, cast(b * {_CHUNK} + 1 AS int), {_CHUNK}), (m, i) -> named_struct("
            f"'gap', get({ps}, cast(b * {_CHUNK} + i AS int)), 'm', m, 'after', left(get({ps}, cast(b * {_CHUNK} + i + 1 AS int)), 2))))")


def _starts(ms: str, ps: str) -> str:
    """SQL: the place in the text where each chunk of matches begins."""
    return (f"aggregate(transform({_chunks(ms, ps)}, c -> aggregate(c, 0L, (a, x) -> a + char_length(x.gap) + char_length(x.m))), "
            "array(0L), (a, t) -> array_append(a, element_at(a, -1) + t))")


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    return (f"aggregate(transform(split(reverse({_digits(m)}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN coalesce(try_cast(c AS int), 0) "
            "ELSE get(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), coalesce(try_cast(c AS int), 0)) END), 0, (a, x) -> a + x) % 10 = 0")


# SQL over a span ``s``: what a base match must hold.
_KEEPS = {
    "email": "true",
    "ip": "forall(split(s.m, '[.]'), x -> coalesce(try_cast(x AS int) <= 255, false))",
    "card": f"length({_digits('s.m')}) BETWEEN 16 AND 19 AND {_luhn('s.m')}",
    "phone": f"length({_digits('s.m')}) BETWEEN 8 AND 15",
}
_PLAUSIBLE = {
    "email": "length(s.m) BETWEEN 6 AND 254 AND s.m rlike '[A-Za-z]$' AND NOT s.m rlike '[.][.]|^[.]'",
    "ip": "NOT s.m rlike '(^|[.])0[0-9]' AND NOT s.m rlike '^(0|255)[.]'",
    "card": f"length({_digits('s.m')}) BETWEEN 13 AND 19 AND {_luhn('s.m')}",
    "phone": f"length({_digits('s.m')}) BETWEEN 10 AND 13",
}
_GAZETTEER = {
    "email": f"lower(s.m) rlike '[. )\\\\]]({ENDINGS})$'",
    "ip": "s.m rlike '^(1|2|[3-9])' AND NOT s.m rlike '^127[.]'",
    "card": f"{_digits('s.m')} rlike '^({CARD_PREFIXES})'",
    "phone": f"{_digits('s.m')} rlike '^[1-9]'",
}


def _votes(kind: str, strict: bool) -> str:
    """SQL: the votes on span ``s`` as the bits of a number, in the order of ``LABELERS``."""
    votes = [
        "true" if strict else "false", _PLAUSIBLE[kind], _GAZETTEER[kind],
        f"lower(s.before) rlike '(^|[^a-z])({WORDS_FOR[kind]})[^a-z]*$'",
        "(s.before = '' OR s.before rlike '[\\\\s:;,(<>=\"]$') AND (s.after = '' OR s.after rlike '^[\\\\s.,;:!?)<>\"]')",
        f"lower(s.before) rlike '(^|[^a-z])({WORDS_AGAINST})[^a-z]*$'"]
    return " + ".join(f"CASE WHEN {v} THEN {1 << j} ELSE 0 END" for j, v in enumerate(votes))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more): arrays of (kind, at, end, votes) for each row of ``docs``.

    ``base``: base spans by kind, then start; ``more``: spans of the wider patterns
    that overlap no base span.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found, places = [], {}
    for k, kind in enumerate(KINDS):
        for strict, patterns in ((True, BASE), (False, WIDER)):
            ms, ps = f"m{k}{int(strict)}", f"p{k}{int(strict)}"
            need = _NEEDS[kind] if strict else "true"
            rx = F.lit(patterns[kind])
            found.append((ms, ps, rx, need))
            places[k, strict] = (ms, ps)
    rows = rows.select("*", *[F.when(F.expr(need), F.regexp_extract_all("text", rx, F.lit(0)))
                              .otherwise(F.array().cast("array<string>")).alias(ms) for ms, _, rx, need in found])
    rows = rows.select("*", *[F.when(F.size(ms) > 0, F.split("text", rx, -1)).alias(ps) for ms, ps, rx, _ in found]).drop("text")
    rows = rows.select("*", *[F.expr(_starts(ms, ps)).alias(f"s{ms}") for ms, ps, _, _ in found])

    def spans(k: int, kind: str, strict: bool) -> str:
        ms, ps = places[k, strict]
        kept = _KEEPS[kind] if strict else "true"
        return (f"transform(filter({_spans(k, ms, ps, 's' + ms)}, s -> {kept}), s -> named_struct('kind', s.kind, 'at', s.at, "
                f"'end', s.at + char_length(s.m), 'votes', {_votes(kind, strict)}))")

    for strict, to in ((True, "base"), (False, "wider")):
        rows = rows.withColumn(to, F.expr("concat(" + ", ".join(spans(k, kind, strict) for k, kind in enumerate(KINDS)) + ")"))
    return rows.select("doc_id", "base", F.expr(
        "filter(wider, w -> NOT exists(base, b -> b.at < w.end AND w.at < b.end))").alias("more"))


def vote_model(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """Posterior of each (kind, votes) by expectation-maximisation over pattern counts.

    Votes are independent given the truth; each labeler has a rate of voting on
    true and on false spans of a kind, which start from weak opinions (for, or
    against for the last labeler) that also smooth every round.
    """
    out: dict[tuple[int, int], float] = {}
    n = len(LABELERS)
    for kind in range(len(KINDS)):
        own = {v: c for (k, v), c in counts.items() if k == kind}
        prior = 0.5
        on_true, on_false = [0.8] * (n - 1) + [0.1], [0.3] * (n - 1) + [0.4]
        start = list(zip(on_true, on_false, strict=True))
        for _ in range(ROUNDS):
            weight_true = weight = 2.0
            weight_true /= 2
            true_votes, false_votes = [4.0 * a for a, _ in start], [4.0 * b for _, b in start]
            for v, c in own.items():
                yes, no = math.log(prior), math.log(1 - prior)
                for j in range(n):
                    a, b = on_true[j], on_false[j]
                    yes += math.log(a if v >> j & 1 else 1 - a)
                    no += math.log(b if v >> j & 1 else 1 - b)
                p = out[kind, v] = 1 / (1 + math.exp(max(-700.0, min(700.0, no - yes))))
                weight_true, weight = weight_true + c * p, weight + c
                for j in range(n):
                    if v >> j & 1:
                        true_votes[j] += c * p
                        false_votes[j] += c * (1 - p)
            prior = min(0.999, max(0.001, weight_true / weight))
            on_true = [min(0.999, max(0.001, t / (weight_true - 1 + 4))) for t in true_votes]
            on_false = [min(0.999, max(0.001, t / (weight - weight_true - 1 + 4))) for t in false_votes]
    return out


def span_classifier(counts: dict[tuple[int, int], int], posterior: dict[tuple[int, int], float]) -> list[list[float]]:
    """Logistic weights per kind (bias, then each labeler) against the posteriors, with a small penalty."""
    n = len(LABELERS)
    weights = [[0.0] * (n + 1) for _ in KINDS]
    for kind, w in enumerate(weights):
        own = [([1.0] + [float(v >> j & 1) for j in range(n)], c, posterior[k, v]) for (k, v), c in counts.items() if k == kind]
        total = sum(c for _, c, _ in own)
        for _ in range(400 if own else 0):
            slope = [0.01 * x for x in w]
            for x, c, p in own:
                q = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
                for j, xj in enumerate(x):
                    slope[j] += c / total * (q - p) * xj
            for j in range(n + 1):
                w[j] -= 1.0 * slope[j]
    return weights


def accepted_patterns(weights: list[list[float]]) -> list[int]:
    """Every (kind, votes) that the classifier accepts, as kind * 2**labelers + votes."""
    n = len(LABELERS)
    return [k << n | v for k, w in enumerate(weights) for v in range(1 << n)
            if 1 / (1 + math.exp(-(w[0] + sum(w[j + 1] for j in range(n) if v >> j & 1)))) >= ACCEPT and any(w)]


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (base and accepted, ``kind:start:end``), n_spans.

    Null and empty texts have no spans; repeated rows stay; a null doc_id is
    passed on; other columns are not read; without candidates nothing is learnt.
    """
    rows = materialise(candidates(docs), "pii-candidates")
    # At most kinds * 2**labelers rows.
    counted = (rows.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.kind", "s.votes")
               .agg(F.count("*").alias("n")).collect())
    counts = {(r["kind"], r["votes"]): r["n"] for r in counted}
    accepted = accepted_patterns(span_classifier(counts, vote_model(counts)))
    taken = f"array({', '.join(map(str, accepted))})" if accepted else "cast(array() AS array<int>)"
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    written = f"array_join(transform({{}}, s -> concat_ws(':', get({names}, s.kind), s.at, s.end)), ',')"
    rows = rows.withColumn("spans", F.expr(
        f"array_sort(concat(base, filter(more, s -> array_contains({taken}, s.kind * {1 << len(LABELERS)} + s.votes))), "
        "(x, y) -> CASE WHEN x.kind <> y.kind THEN x.kind - y.kind WHEN x.at < y.at THEN -1 WHEN x.at > y.at THEN 1 ELSE 0 END)"))
    return rows.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(F.expr(written.format("base")), 256).alias("base_sha256"), F.expr(written.format("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"))
