"""Name vocabulary with counts, vectors and character TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions import text


def name_counts(df: DataFrame, column: str, position: Column) -> DataFrame:
    """(name, cnt, first_pos): distinct raw names; null counts as the empty name. One partial and final aggregation."""
    return df.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("name"), position.alias("p")).groupBy("name").agg(F.count("*").alias("cnt"), F.min("p").alias("first_pos"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(name_id, name, cnt), ids from 0 in order of first sight. Numbered over distinct names, not rows."""
    order = Window.orderBy("first_pos", "name")
    return counts.select((F.row_number().over(order) - 1).cast("long").alias("name_id"), "name", "cnt")


def described(names: DataFrame) -> DataFrame:
    """Per-name columns, derived once before names meet in pairs."""
    n = F.col("name")
    df = names.withColumn("tokens", text.tokenize(n)).withColumn("folded", text.folded(n))
    return df.select(
        "name_id", "name", "cnt", "tokens",
        text.acronym(F.col("tokens")).alias("acr"), text.normal_form(n).alias("norm"), F.length("folded").cast("long").alias("len"),
        F.regexp_replace(F.upper(n), "[^A-Z0-9]", "").alias("raw_upper"), F.array_join(F.array_sort(F.array_distinct("tokens")), " ").alias("sorted_tokens"),
        text.is_acronym_only(n).alias("acronym_only"), text.acronym_key(n).alias("akey"), "folded",
    )


def letter_vectors(names: DataFrame) -> DataFrame:
    """(name_id, v): counts of the letters a to z in the folded name; the built-in encoder."""
    n = text.folded(F.col("name"))
    counts = [(F.length(n) - F.length(F.replace(n, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"]
    return names.select("name_id", F.array(*counts).alias("v"))


def encode(names: DataFrame, encoder=None) -> DataFrame:
    """(name_id, v array<double>) by a function from a batch of normal forms to vectors, or by letter counts.

    `encoder` is a zero-argument factory, called once per Python worker, whose result maps a list of texts to an array.
    """
    if encoder is None:
        return letter_vectors(names)

    def run(batches):
        model = encoder()
        for pdf in batches:
            yield pdf.assign(v=[list(map(float, v)) for v in model(pdf["norm"].tolist())])[["name_id", "v"]]

    return names.select("name_id", text.normal_form(F.col("name")).alias("norm")).mapInPandas(run, "name_id long, v array<double>")


def gram_idf(names: DataFrame) -> DataFrame:
    """(gram, df, idf): smoothed inverse document frequency, ln((1 + n) / (1 + df)) + 1."""
    n = names.count()
    grams = names.select("name_id", F.explode(F.array_distinct(text.char_grams(F.col("folded")))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("df")).withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1)


def char_tfidf(names: DataFrame) -> DataFrame:
    """(name_id, gram, w): rows of unit length over character grams; names without grams have no rows."""
    tf = names.select("name_id", F.explode(text.char_grams(F.col("folded"))).alias("gram")).groupBy("name_id", "gram").agg(F.count("*").alias("tf"))
    raw = tf.join(gram_idf(names), "gram").select("name_id", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("name_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "name_id").select("name_id", "gram", (F.col("w") / F.col("norm")).alias("w"))
