"""Cluster report lines, cohesion scores and review rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.operators.clustering import MISC


def report_lines(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(line_no, line): clusters by falling total, then misc (each name counts 1), then singletons by id.

    Every line has a sort key (section, cluster rank, place); blank lines close each block.
    """
    rows = labels.join(names.select("name_id", "name", "cnt"), "name_id")
    inside = rows.where("label >= 0")
    totals = inside.groupBy("label").agg(F.count("*").alias("u"), F.sum("cnt").alias("t"))
    ranked = totals.withColumn("r", F.row_number().over(Window.orderBy(F.col("t").desc(), "label")) - 1)
    line = lambda s, r, p, text, name="", cnt=0: (F.lit(s).alias("s"), r.cast("long").alias("r"), F.lit(p).alias("p"), F.lit(cnt).cast("long").alias("c") if not hasattr(cnt, "cast") else cnt.cast("long").alias("c"), (F.lit(name) if isinstance(name, str) else name).alias("n"), text.alias("line"))
    member = F.concat(F.lit("  - "), F.col("name"), F.lit("  x"), F.col("cnt").cast("string"))
    zero = F.lit(0)
    spark = labels.sparkSession
    one = spark.range(1)
    head = one.select(*line(0, zero, 0, F.lit("# Clusters"))).unionByName(one.select(*line(0, zero, 1, F.lit("")))).unionByName(ranked.agg(F.count("*").alias("n")).select(*line(0, zero, 2, F.concat(F.lit("Total clusters: "), F.col("n").cast("string"))))).unionByName(one.select(*line(0, zero, 3, F.lit(""))))
    title = F.concat(F.lit("Cluster "), F.col("r").cast("string"), F.lit(" (unique: "), F.col("u").cast("string"), F.lit(", total: "), F.col("t").cast("string"), F.lit(")"))
    order = -F.col("cnt")
    blocks = ranked.select(*line(1, F.col("r"), 0, title)).unionByName(inside.join(ranked.select("label", "r"), "label").select(*line(1, F.col("r"), 1, member, F.lower("name"), order))).unionByName(ranked.select(*line(1, F.col("r"), 2, F.lit(""))))
    misc = rows.where(F.col("label") == MISC).withColumn("cnt", F.lit(1))
    size = misc.agg(F.count("*").alias("u")).where("u > 0")
    misc_title = F.concat(F.lit("Cluster misc (unique: "), F.col("u").cast("string"), F.lit(", total: "), F.col("u").cast("string"), F.lit(")"))
    odd = size.select(*line(2, zero, 0, misc_title)).unionByName(misc.select(*line(2, zero, 1, member, F.lower("name"), order))).unionByName(size.select(*line(2, zero, 2, F.lit(""))))
    single = rows.where((F.col("label") < 0) & (F.col("label") != MISC))
    alone = single.select(*line(3, F.col("name_id"), 0, F.concat(F.lit("Cluster "), F.col("name"), F.lit(" (singleton)")))).unionByName(single.select(*line(3, F.col("name_id"), 1, member))).unionByName(single.select(*line(3, F.col("name_id"), 2, F.lit(""))))
    every = head.unionByName(blocks).unionByName(odd).unionByName(alone)
    return every.select((F.row_number().over(Window.orderBy("s", "r", "p", "c", "n", "line")) - 1).cast("long").alias("line_no"), "line")


def review_scores(labels: DataFrame, scored: DataFrame) -> DataFrame:
    """(label, score) of clusters of two or more: 0.6 (1 - least p) + 0.4 (1 - mean p) over all pairs inside, a pair without a score counting 0."""
    inside = labels.where("label >= 0").select("name_id", "label")
    size = inside.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    a, b = inside.toDF("i", "label"), inside.toDF("j", "other")
    known = scored.select("i", "j", "p").join(a, "i").join(b, "j").where("label = other").groupBy("label").agg(F.count("*").alias("m"), F.min("p").alias("low"), F.sum("p").alias("total"))
    every = F.col("n") * (F.col("n") - 1) / 2
    least = F.when(F.coalesce("m", F.lit(0)) < every, F.least(F.lit(0.0), F.coalesce("low", F.lit(0.0)))).otherwise(F.col("low"))
    mean = F.coalesce("total", F.lit(0.0)) / every
    return size.join(known, "label", "left").select("label", (0.6 * (1 - least) + 0.4 * (1 - mean)).alias("score"))


def review_rows(labels: DataFrame, names: DataFrame, scored: DataFrame, most: int) -> DataFrame:
    """(cluster, label): the worst `most` clusters, names joined by pipes in lower-case order, the label left blank."""
    if most <= 0:
        return labels.sparkSession.createDataFrame([], "cluster string, label string")
    top = review_scores(labels, scored).orderBy(F.col("score").desc(), F.col("label").desc()).limit(most)
    rows = labels.join(top, "label").join(names.select("name_id", "name"), "name_id")
    listed = F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), F.col("name").alias("name"))))
    return rows.groupBy("label").agg(F.array_join(F.transform(listed, lambda x: x["name"]), " | ").alias("cluster")).select("cluster", F.lit("").alias("label"))
