"""Fill-in-the-middle transformation by repeated-capture matching.

A text is one ``fullmatch`` of ``(unit)*``: the regex library keeps every
repetition of the group, so ``match.ends(1)`` is the end of each unit, its length
is their number, and both cut offsets are two of its entries.  All repeats are
possessive (no unit could end elsewhere), so the match is linear and keeps no way
back.

The cuts and the form follow from a hash of the doc_id, so a rerun, a retried
task or another partitioning gives the same rows.  Python sees a text once and
returns three numbers; Spark cuts, joins, rebuilds and hashes by code points.
Rows are independent: no shuffle, memory of one text and its unit ends.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A unit: a word with the ASCII white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
FIM_PERCENT = 50            # of documents are cut
SPM_PERCENT = 80            # of these have the suffix first


def hash_groups(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of ``seed:doc_id``, as longs
    (a null id counts as no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut_places(text: str | None, first: int, second: int, whole: regex.Pattern) -> tuple[int, int, int]:
    """(n, start, end): units of the text, and the code points where the middle starts
    and ends, for two draws of a number of units."""
    ends = whole.fullmatch(text or "").ends(1)
    n = len(ends)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, ends[low - 1] if low else 0, ends[high - 1] if high else 0


def fill_in_middle(docs: DataFrame, to: str = "__fim", unit: str = UNIT, seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` and a struct column ``to``: n, form, prefix_chars, middle_chars, output.

    ``form`` is ``plain`` (the output is the text, the lengths are null), ``psm`` or
    ``spm``.  Null and empty texts are plain with n 0 and an empty output; so is any
    text that holds a marker, with its own n.  A null doc_id draws like an id without
    digits.  Rows that repeat a doc_id share their draws; repeated rows stay; an
    empty table gives no rows.
    """
    whole = f"({unit})*+"

    @F.pandas_udf("n long, start long, stop long")
    def cut(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(whole)
        return pd.DataFrame([cut_places(t, a, b, pattern) for t, a, b in zip(text, first, second, strict=True)],
                            columns=["n", "start", "stop"])

    h1, h2, h3, h4 = hash_groups(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    start, stop = F.col("__cut.start"), F.col("__cut.stop")
    prefix = F.substring(text, F.lit(1), start)
    middle = F.substring(text, start + 1, stop - start)
    suffix = F.substring(text, stop + 1, F.length(text))
    form = (F.when((text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX))
                   | F.contains(text, F.lit(MIDDLE)) | (h3 % 100 >= fim_percent), "plain")
            .when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    output = (F.when(F.col("__form") == "plain", text)
              .when(F.col("__form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    cut_only = F.col("__form") != "plain"
    return docs.withColumns({"__cut": cut(F.col("text"), h1, h2), "__form": form}).withColumn(to, F.struct(
        F.col("__cut.n").alias("n"), F.col("__form").alias("form"),
        F.when(cut_only, start).alias("prefix_chars"), F.when(cut_only, stop - start).alias("middle_chars"),
        output.alias("output"))).select(*[F.col(f"`{c}`") for c in docs.columns], to)


def rebuilt(output: Column, form: Column) -> Column:
    """The text, from the output and its form alone: a cut text holds no marker."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each row."""
    out = fill_in_middle(docs.select("doc_id", "text")).select("doc_id", "__fim.*")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output"), 256).alias("output_sha256"),
                      F.sha2(rebuilt(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle_sql() -> str:
    """The same rows in DuckDB SQL."""
    group = [f"CAST('0x' || substr(digest, {8 * i + 1}, 8) AS BIGINT)" for i in range(4)]
    return rf"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, {group[0]} % (len(u) + 1) AS a, {group[1]} % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                   OR {group[2]} % 100 >= {FIM_PERCENT} THEN 'plain'
              WHEN {group[3]} % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM units),
cut AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut"""
