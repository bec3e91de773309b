"""Pair features, seed pairs and training sets."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = ("s_cos", "s_chr", "jaccard", "overlap", "acr_equal", "acr_initial", "len_ratio", "tok_seq", "raw_seq", "heur", "bridge")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all, by longest matching blocks; the argument order matters."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def lexical(a: str, b: str) -> dict[str, Column]:
    """Columns of two described names under the aliases a and b."""
    at, bt = F.array_distinct(f"{a}.tokens"), F.array_distinct(f"{b}.tokens")
    overlap = F.size(F.array_intersect(at, bt))
    union = F.size(F.array_union(at, bt))
    aa, ba = F.col(f"{a}.acr"), F.col(f"{b}.acr")
    longer = F.greatest(f"{a}.len", f"{b}.len")
    return {
        "jaccard": F.when(union == 0, F.lit(1.0)).otherwise(overlap / union),
        "overlap": overlap.cast("double"),
        "acr_equal": _flag((aa != "") & (aa == ba)),
        "acr_initial": _flag(((aa != "") & (aa == F.col(f"{b}.raw_upper"))) | ((ba != "") & (ba == F.col(f"{a}.raw_upper")))),
        "len_ratio": F.when(longer == 0, F.lit(0.0)).otherwise(F.least(f"{a}.len", f"{b}.len") / longer),
    }


def pair_features(pairs: DataFrame, names: DataFrame, sequences: bool = True, zero_cosine: bool = False) -> DataFrame:
    """(i, j, FEATURES) of pairs (i, j, s_cos, s_chr, bridge); with zero_cosine, cosines and what depends on them are 0, as feedback pairs have them."""
    p = pairs.alias("p").join(names.alias("a"), F.col("p.i") == F.col("a.name_id")).join(names.alias("b"), F.col("p.j") == F.col("b.name_id"))
    cos, char = (F.lit(0.0), F.lit(0.0)) if zero_cosine else (F.col("p.s_cos"), F.col("p.s_chr"))
    lex = lexical("a", "b")
    columns = {"s_cos": cos, "s_chr": char, **lex}
    if sequences:
        columns |= {"tok_seq": sequence_ratio("a.sorted_tokens", "b.sorted_tokens"), "raw_seq": sequence_ratio("a.norm", "b.norm")}
    columns["heur"] = _flag((lex["overlap"] >= 1) & ((cos >= 0.60) | (char >= 0.60)))
    columns["bridge"] = F.lit(0.0) if zero_cosine else F.col("p.bridge")
    return p.select("p.i", "p.j", *(c.alias(n) for n, c in columns.items()))


def positive_seed() -> Column:
    return (F.col("acr_equal") == 1) | (F.col("acr_initial") == 1) | ((F.col("overlap") >= 2) & (F.col("s_chr") >= 0.80)) | (F.col("jaccard") >= 0.85)


def negative_seed() -> Column:
    return (F.col("overlap") == 0) & (F.col("s_cos") <= 0.35) & (F.col("s_chr") <= 0.35)


def seed_pairs(features: DataFrame, most: int = 60) -> DataFrame:
    """(i, j, y): the first positives and negatives by (i, j); a pair that is both is positive."""
    pos = features.where(positive_seed()).select("i", "j").orderBy("i", "j").limit(most)
    neg = features.where(negative_seed()).select("i", "j", positive_seed().cast("int").alias("y")).orderBy("i", "j").limit(most)
    both = pos.withColumn("y", F.lit(1)).unionByName(neg)
    return both.groupBy("i", "j").agg(F.max("y").cast("int").alias("y"))


def training_set(seeds: DataFrame, approved: DataFrame, rejected: DataFrame, features: DataFrame, feedback_features: DataFrame, feedback_weight: float = 4.0) -> DataFrame:
    """Feature rows with y and w: seeds at weight 1, feedback pairs at `feedback_weight`, repeats kept."""
    seeded = seeds.join(features, ["i", "j"]).withColumn("w", F.lit(1.0))
    told = approved.select("i", "j").withColumn("y", F.lit(1)).unionByName(rejected.select("i", "j").withColumn("y", F.lit(0))).join(feedback_features, ["i", "j"]).withColumn("w", F.lit(feedback_weight))
    return seeded.unionByName(told)


def class_weights(training: DataFrame) -> DataFrame:
    """Balanced weights: n / (classes * rows of the class); y is 0 or 1, so the counts are two rows at most."""
    own = training.groupBy("y").agg(F.count("*").alias("own"))
    total = own.agg(F.sum("own").alias("every"), F.count("*").alias("kinds"))
    shares = own.crossJoin(F.broadcast(total)).select("y", (F.col("every") / (F.col("kinds") * F.col("own"))).alias("w"))
    return training.drop("w").join(F.broadcast(shares), "y").select(*(c for c in training.columns if c != "w"), "w")
