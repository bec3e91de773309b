"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with built-in functions only.

A source's target is its weighted share of the mix, at most twice its size; what is above that is shared again by weight
(in closed form: the water level over sources sorted by capacity per weight). Whole epochs of a source come first; the fraction
that is left goes to the documents with the smallest exponential keys -ln(u) / weight, u from the id's hash and
weight from the document's quality, up to the token budget. Keys are cut into buckets, so that sums per bucket
locate the budget and only the one bucket per source that straddles it is sorted.

Documents stay whole: the last one is taken if that brings the source nearer to its target, so a source misses its
target by half a document at most.

Defined results: a null or empty text has size 0 and is never taken; null sources are one source, the last;
a null id counts as the empty text in the hash; rows that repeat have the same key and count each on its own; keys that tie
go by id, size and text, so that reruns agree; an empty table gives no rows. Extra columns pass through, but for those named as a result's column, in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.llm.common import SPACE_CLASS, cut

BUCKETS = 4096
#: The plan (one row per source) is broadcast up to so many sources, some 10 MB; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000
RESULTS = ("size", "source_size", "target", "taken")
WEIGHTS = (5, 2, 1)


def quality_weight(text: Column) -> Column:
    """In (0, 1]: the fewer symbols, the nearer to 1."""
    plain = F.coalesce(text, F.lit(""))
    symbols = F.length(plain) - F.length(F.regexp_replace(plain, "[#*$%&|<>!]", ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * symbols.cast("double") / (F.length(plain) + 1).cast("double"))


def exponential_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1] from 52 bits of the id's md5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((bits + 1).cast("double") / F.lit(float(1 << 52))) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """(source, source_size) with target: one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("w", cycle.cast("long")).withColumn("cap", 2 * F.col("source_size"))
    t = t.withColumn("total", F.sum("source_size").over(everything))
    level = (F.lit(share) * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(behind)
    t = t.withColumn("level", level)
    # the level rises over capped sources and falls behind the first one that isn't: its top is the water level
    t = t.withColumn("top", F.max("level").over(everything))
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("top") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """Columns of `docs` (doc_id, text and source among them) with size, source_size, target and taken, which replace any of these names."""
    given = [c for c in docs.columns if c.lower() not in RESULTS]
    # other names than those of the steps below
    kept = [c if c in ("doc_id", "text", "source") else f"given_{i}" for i, c in enumerate(given)]
    docs = docs.select(*(docs[c].alias(k) for c, k in zip(given, kept, strict=True)))
    size = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE_CLASS + "+"), "")).cast("long")
    rows = docs.select(*kept, size.alias("size"), exponential_key(F.col("doc_id"), quality_weight(F.col("text"))).alias("key"), F.xxhash64("text").alias("tie"))
    rows = rows.withColumn("bucket", F.least(F.floor(BUCKETS * (1 - F.exp(-F.col("key")))), F.lit(BUCKETS - 1)).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    source = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(source, weights, share)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("end", F.sum("size").over(upto))
    p, e = plan.alias("p"), ends.alias("e")
    same = F.col("p.source").eqNullSafe(F.col("e.source"))
    plan = (
        p.join(e, same & (F.col("e.end") > F.col("p.budget")), "left")
        .groupBy("p.source", "p.source_size", "p.target", "p.epochs", "p.budget")
        .agg(F.min(F.struct("e.bucket", (F.col("e.end") - F.col("e.size")).alias("before"))).alias("edge"))
        .select("source", "source_size", "target", "epochs", "budget", F.coalesce("edge.bucket", F.lit(BUCKETS)).alias("edge"), F.col("edge.before").alias("before"))
    )
    plan = cut(plan)
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = rows.alias("r").join(plan.alias("q"), F.col("r.source").eqNullSafe(F.col("q.source")))
    joined = joined.select("r.*", "q.source_size", "q.target", "q.epochs", "q.budget", "q.edge", "q.before")
    inner = Window.partitionBy("source").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    near = joined.where(F.col("bucket") == F.col("edge")).withColumn("sum", F.col("before") + F.sum("size").over(inner))
    near = near.withColumn("more", (F.col("sum") - F.col("size") / 2 <= F.col("budget")).cast("long")).drop("sum")
    far = joined.where(F.col("bucket") != F.col("edge")).withColumn("more", (F.col("bucket") < F.col("edge")).cast("long"))
    both = far.unionByName(near)
    own = (F.col(k).alias(c) for c, k in zip(given, kept, strict=True))
    return both.select(*own, "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("more"))).alias("taken"))


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Every document as often as the mix takes it."""
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    return mixed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(*columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         -ln(CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 1 AS DOUBLE) / 4503599627370496.0::DOUBLE)
           / (1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>!]', '', 'g')) AS DOUBLE)
             / CAST(length(coalesce(text, '')) + 1 AS DOUBLE))) AS key
  FROM documents),
s AS (
  SELECT *, (CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END) AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source)),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / CAST(w AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(w) OVER (ORDER BY 2 * source_size / CAST(w AS DOUBLE), rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM s),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * CAST(w AS DOUBLE)) AS target FROM l),
p AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS epochs FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN upto - size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
