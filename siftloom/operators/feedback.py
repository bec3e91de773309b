"""Reviewed clusters: parsing, pairs, mined rejections and the constraint store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"(?U)^\s+|\s+$"


def parse_feedback(rows: DataFrame, id_column: str | None = None) -> DataFrame:
    """([id,] members, label): JSON lists as they are, else pipe lists trimmed; null cells, blank labels and fewer than two members go."""
    cell = F.regexp_replace("cluster", SPACE, "")
    pipes = F.filter(F.transform(F.split(cell, r"\|"), lambda x: F.regexp_replace(x, SPACE, "")), lambda x: x != "")
    listed = F.when(cell.startswith("["), F.from_json(cell, "array<string>", {"mode": "PERMISSIVE"}))
    label = F.try_to_number(F.trim("label"), F.lit("9999")).cast("int")
    keep = [id_column] if id_column else []
    out = rows.where(F.col("cluster").isNotNull()).select(*keep, F.coalesce(listed, pipes).alias("members"), label.alias("label"))
    return out.where((F.size("members") >= 2) & F.col("label").isNotNull())


def feedback_pairs(parsed: DataFrame, names: DataFrame, id_column: str = "cluster_id") -> DataFrame:
    """(cluster_id, i, j, approved) of names that are present; members are distinct, the smaller id first; label 1 approves, any other rejects."""
    members = parsed.select(id_column, "label", F.explode(F.array_distinct("members")).alias("name"))
    ids = members.join(names.select("name", "name_id"), "name").select(id_column, "label", "name_id")
    a, b = ids.alias("a"), ids.alias("b")
    pairs = a.join(b, (F.col(f"a.{id_column}") == F.col(f"b.{id_column}")) & (F.col("a.name_id") < F.col("b.name_id")))
    return pairs.select(F.col(f"a.{id_column}").alias(id_column), F.col("a.name_id").alias("i"), F.col("b.name_id").alias("j"), (F.col("a.label") == 1).alias("approved"))


def mine_negatives(rejected: DataFrame, share: float = 0.20, id_column: str = "cluster_id") -> DataFrame:
    """The least probable pairs of each rejected cluster: max(1, ceil(share * pairs)), ties by (i, j). rejected: (id, i, j, p)."""
    order, every = Window.partitionBy(id_column).orderBy("p", "i", "j"), Window.partitionBy(id_column)
    ranked = rejected.withColumn("r", F.row_number().over(order)).withColumn("m", F.count("*").over(every))
    return ranked.where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("m")))).drop("r", "m")


def union_constraints(*stores: DataFrame) -> DataFrame:
    """(kind, a, b): all pairs once, whichever name came first."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return out.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def constraints_to_ids(constraints: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, i, j) of pairs whose names are both present and differ."""
    ids = names.select("name", "name_id")
    both = constraints.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").where("x <> y")
    return both.select("kind", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).distinct()
