"""Quality rules as a short-circuit cascade, with built-in functions only.

The counts of a text (words, characters in words, symbols, repeated lines, words in repeated eight-word windows) come from array
functions; windows are compared by 64-bit hashes built by doubling (1, 2, 4, 8 words), without exploding a text into rows. Further
rules look at the text again; their cost and their share of rejected texts are estimated on a bounded sample, and a CASE
expression tries them in the order of rejections per cost, so that a text that an early rule rejects isn't read by the
later ones. The verdict is the same in any order.

Defined results: a null or empty text has no words and fails the base rule; every row counts on its own, so repeated rows and null ids
are no special case; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import SPACE_CLASS

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """`rejects` holds for texts that the rule rejects; it may use the columns of `counts` and `text`."""

    name: str
    rejects: Column


def rules() -> list[Rule]:
    """The rules beyond the base rule."""
    text, words = F.col("text"), F.col("n_words")
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return [
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words)),
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.size(lines)),
        Rule("capitals", 2 * without("[A-Z]") > without("[A-Za-z]")),
        Rule("exclamations", 2 * without("!") > words),
        Rule("words_without_letters", 2 * without("(?<![^\\x20\\x09-\\x0D])[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]+(?![^\\x20\\x09-\\x0D])") > F.col("word_chars")),
        Rule("bullets", 10 * F.size(F.filter(lines, lambda x: x.rlike("^[\\x20\\x09]*[-*•]"))) > 9 * F.size(lines)),
    ]


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); text null becomes empty."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", SPACE_CLASS + "+"), ""))
    df = df.select("doc_id", "text", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    for step in (1, 2, 4):
        n = F.size("h") - step
        pair = F.zip_with(F.slice("h", 1, F.greatest(n, F.lit(0))), F.slice("h", step + 1, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn("h", F.when(F.col("n_words") >= WINDOW, pair).otherwise(F.array().cast("array<bigint>")))
    # places of each hash, sorted by hash, only where some hash repeats
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    df = df.withColumn("s", F.when(repeats, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("h")
    size = F.size("s")
    equal = F.zip_with(F.slice("s", 1, size - 1), F.slice("s", 2, size - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(equal))))).drop("s")
    size = F.size("p")
    steps = F.zip_with(F.slice("p", 1, size - 1), F.slice("p", 2, size - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(WINDOW), lambda a, x: a + x)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("lines", lines)
    return df.select(
        "doc_id", "text", "n_words", "word_chars",
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("p").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def order_rules(sample: DataFrame, found: list[Rule], repeats: int = 2) -> list[Rule]:
    """The rules by rejections per cost, estimated on the rows of `sample` (rows of `counts`) that pass the base rule.

    The sample is cached first: a filter over `counts` itself would be pushed below its projections, once per use of a column.
    """
    if not found:
        return []
    sample = sample.persist()
    try:
        reaches = ~base_failed()
        shares = sample.agg(F.count_if(reaches).alias("n"), *(F.count_if(reaches & r.rejects).alias(r.name) for r in found)).first()
        if not shares["n"]:
            return list(found)

        def seconds(column: Column) -> float:
            took = []
            for _ in range(repeats):
                began = time.perf_counter()
                sample.agg(F.count_if(reaches & column)).first()
                took.append(time.perf_counter() - began)
            return min(took)

        idle = seconds(F.lit(True))
        cost = {r.name: max(seconds(r.rejects) - idle, 1e-4) for r in found}
        return sorted(found, key=lambda r: (-(shares[r.name] or 0) / shares["n"] / cost[r.name], r.name))
    finally:
        sample.unpersist()


def apply_rules(docs: DataFrame, found: list[Rule] | None = None, sample_rows: int = 1000, sample_one_in: int = 16) -> DataFrame:
    """`counts` of every row with base_failed and kept."""
    found = rules() if found is None else found
    table = counts(docs)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(sample_one_in)) == 0).limit(sample_rows)
    ordered = order_rules(counts(sample), found)
    table = table.withColumn("base_failed", base_failed())
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for r in ordered:
        verdict = verdict.when(r.rejects, F.lit(False))
    return table.withColumn("kept", verdict.otherwise(F.lit(True)))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit) GROUP BY doc_id),
b AS (
  SELECT d.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, words, lines
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > len(lines)
    OR 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))
    OR 2 * (length(text) - length(replace(text, '!', ''))) > n_words
    OR 2 * length(array_to_string(list_filter(words, lambda w: regexp_full_match(w, '[\x21-\x40\x5B-\x60\x7B-\x7E]+')), '')) > word_chars
    OR 10 * len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09]*[-*•]'))) > 9 * len(lines)) AS kept
FROM f
"""
