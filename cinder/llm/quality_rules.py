"""Quality rules: a threshold table compiled into one Spark projection.

``MEASURES`` names what is counted in a text, ``RULES`` bounds ratios of these
counts.  Both compile to column expressions: words, lines and three-word windows
are arrays inside the row, and every count is a built-in function over them, so
there is no user function, no shuffle and no second look at a text.

Words in windows that repeat: the windows with their places are sorted, equal
neighbours repeat, and the places that stay, sorted again, count three words each
less what the next one covers.  Time n log n, memory of one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 3
SYMBOL = "[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50           # percent of the words

# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "a al an and are as at au auf aus avec be but by ce con da das de del den der des dem die do du ein eine el elle "
    "en er es est et for from has have he hij il im in is ist it la las le les los mit ne nicht of on or ou para pas "
    "por pour que qui se sich sie sont sur that the this to un una und une von was were which with you zu y").split()


@dataclass(frozen=True)
class Rule:
    """``least <= numerator / denominator <= most``; a text without a denominator passes."""
    name: str
    numerator: str
    denominator: str | None
    least: float | None
    most: float | None


# The threshold table.  The first two rows are the base rules.
RULES = (
    Rule("words", "n_words", None, LEAST_WORDS, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, MOST_REPEATED / 100),
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("letter_words", "n_letter_words", "n_words", 0.7, None),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)
BASE_RULES = ("words", "repeated_words")


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def _windows(words: Column) -> Column:
    """All three-word windows, in order; words hold no space, so joined ones differ."""
    out = words
    for k in range(1, WINDOW):
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda w: w.isNotNull())          # the last ones have no further word


def _repeat_words(words: Column) -> Column:
    """Words in windows that stand twice or more in the text."""
    def repeated(ordered: Column) -> Column:
        same = lambda x, j: (F.get(ordered, j - 1)["w"] == x["w"]) | (F.get(ordered, j + 1)["w"] == x["w"])
        return F.sort_array(F.transform(F.filter(ordered, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["at"]))

    def covered(places: Column) -> Column:
        return F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, at: F.struct(
            (at + WINDOW).alias("end"), (a["n"] + at + WINDOW - F.greatest(a["end"], at)).alias("n")), lambda a: a["n"])

    # Only texts that hold a window twice are sorted; counting different ones is a hash set.
    def by_places(windows: Column) -> Column:
        placed = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("at")))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows),
                      _once(F.sort_array(placed), lambda o: covered(repeated(o)))).otherwise(0)

    return _once(_windows(words), by_places)


def measures(text: Column, stop_words=STOP_WORDS) -> Column:
    """A struct of all counts over a whole text (null: none), as longs."""
    has_word = lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))

    def counts(x: Column) -> Column:
        words, lines, t = x["words"], x["lines"], x["t"]
        kind = lambda test: F.size(F.filter(lines, test))
        first = lambda line: F.ltrim(line)
        named = {
            "n_words": F.size(words),
            "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOL)),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(words),
            "n_lines": F.size(lines),
            "n_letter_words": F.size(F.filter(words, lambda w: F.regexp_like(w, F.lit(r"\p{L}")))),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(list(stop_words)))),
            "n_bullet_lines": kind(lambda s: F.startswith(first(s), F.lit("- ")) | F.startswith(first(s), F.lit("* "))
                                   | F.startswith(first(s), F.lit("•"))),
            "n_ellipsis_lines": kind(lambda s: F.endswith(F.rtrim(s), F.lit("...")) | F.endswith(F.rtrim(s), F.lit("…"))),
        }
        return F.struct(*[c.cast("long").alias(name) for name, c in named.items()])

    whole = F.coalesce(text, F.lit(""))
    parts = F.struct(whole.alias("t"), F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias("words"),
                     F.filter(F.split(whole, "\n", -1), has_word).alias("lines"))
    return _once(parts, counts)


def failed_rules(counts: Column, rules=RULES) -> Column:
    """The names of the rules that a struct of counts fails, in the table's order.

    Products instead of ratios, so that no rounding decides a base rule."""
    def passes(r: Rule) -> Column:
        top, below = counts[r.numerator].cast("double"), F.lit(1.0) if r.denominator is None else counts[r.denominator].cast("double")
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (top >= F.lit(float(r.least)) * below)
        if r.most is not None:
            ok = ok & (top <= F.lit(float(r.most)) * below)
        return ok

    return F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def judge(docs: DataFrame, rules=RULES, to: str = "__quality") -> DataFrame:
    """``docs`` and a struct column ``to``: the counts, ``failed`` (names of failed rules) and ``kept``.

    Null and empty texts have no words, so they fail ``words``; the doc_id and all
    other columns are not looked at; repeated rows stay; an empty table gives no rows.
    """
    named = docs.withColumn("__counts", measures(F.col("text"))).withColumn(
        "__failed", failed_rules(F.col("__counts"), rules))
    return named.withColumn(to, F.struct(
        F.col("__counts.*"), F.col("__failed").alias("failed"), (F.size("__failed") == 0).alias("kept"))).select(
        *[F.col(f"`{c}`") for c in docs.columns], to)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, failed, kept) of each row; ``failed`` is comma-joined."""
    out = judge(docs.select("doc_id", "text")).select("doc_id", "__quality.*")
    base = F.arrays_overlap("failed", F.array(*map(F.lit, BASE_RULES)))
    return out.select(*[c for c in out.columns if c not in ("failed", "kept")],
                      base.alias("base_failed"), F.concat_ws(",", "failed").alias("failed"), "kept")


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` without the texts that fail a rule."""
    return judge(docs, rules).where(F.col("__quality.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql() -> str:
    """The same rows in DuckDB SQL."""
    def fails(r: Rule) -> str:
        below = "CAST(1 AS DOUBLE)" if r.denominator is None else f"CAST({r.denominator} AS DOUBLE)"
        tests = [f"CAST({r.numerator} AS DOUBLE) {op} CAST({bound!r} AS DOUBLE) * {below}"
                 for op, bound in (("<", r.least), (">", r.most)) if bound is not None]
        return f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END"

    has_letter = r"regexp_matches(x, '\p{L}')"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    count = lambda words, test: f"CAST(len(list_filter({words}, lambda x: {test})) AS BIGINT)"
    base = " OR ".join(f"list_contains(failed, '{name}')" for name in BASE_RULES)
    return rf"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT *, regexp_extract_all(t, '{WORD}') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM rows),
places AS (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS place FROM parts),
windows AS (SELECT r, place, words[place:place + {WINDOW - 1}] AS w FROM places),
repeated AS (SELECT r, place FROM (SELECT r, place, count(*) OVER (PARTITION BY r, w) AS n FROM windows) x WHERE n > 1),
covered AS (SELECT r, count(DISTINCT place + k) AS n FROM repeated, (SELECT unnest(range({WINDOW})) AS k) o GROUP BY r),
counts AS (
  SELECT p.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '{SYMBOL}')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
         {count('words', has_letter)} AS n_letter_words,
         {count('words', f'lower(x) IN ({stop})')} AS n_stop_words,
         {count('lines', "starts_with(ltrim(x, ' '), '- ') OR starts_with(ltrim(x, ' '), '* ') OR starts_with(ltrim(x, ' '), '•')")} AS n_bullet_lines,
         {count('lines', "ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…')")} AS n_ellipsis_lines
  FROM parts p LEFT JOIN covered c ON p.r = c.r),
judged AS (SELECT *, list_filter([{', '.join(map(fails, RULES))}], lambda x: x IS NOT NULL) AS failed FROM counts)
SELECT * EXCLUDE (failed), {base} AS base_failed, array_to_string(failed, ',') AS failed, len(failed) = 0 AS kept FROM judged"""
