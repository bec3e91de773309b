"""Whole jobs: entity clustering of a name column with feedback, and both code filters over files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.operators import candidates, clustering, features, feedback, filtering, names, report, verifier
from siftloom.sources import files


@dataclass
class Resolution:
    """What a clustering run gives; all frames are keyed by name_id."""

    names: DataFrame
    labels: DataFrame
    scored: DataFrame
    model: verifier.Verifier | None
    constraints: DataFrame
    extra: dict = field(default_factory=dict)

    def report(self) -> DataFrame:
        return report.report_lines(self.labels, self.names)

    def review(self, most: int) -> DataFrame:
        return report.review_rows(self.labels, self.names, self.scored, most)


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def resolve_names(counts: DataFrame, constraints: DataFrame | None = None, reviewed: DataFrame | None = None, history: DataFrame | None = None, previous: verifier.Verifier | None = None, encoder=None, zero_cosine_feedback: bool = True, warm: verifier.Verifier | None = None) -> Resolution:
    """Cluster the names of (name, cnt, first_pos). reviewed: (cluster, label) rows; history: labelled feature rows of earlier runs; warm: the
    model of seeds and feedback that an earlier run left, from which weak pairs are mined."""
    spark = counts.sparkSession
    clustering.ensure_checkpoint_dir(spark)
    table = names.described(names.vocabulary(counts)).checkpoint()
    n = table.count()
    constraints = constraints if constraints is not None else _empty(spark, "kind string, a string, b string")
    nodes = table.select(F.col("name_id").alias("node"))
    k = candidates.neighbours_asked(n)
    vectors = names.encode(table, encoder)
    if k == 0:
        return Resolution(table, nodes.select(F.col("node").alias("name_id"), F.lit(-1).cast("long").alias("label")), _empty(spark, "i long, j long, p double"), previous, constraints)
    semantic = candidates.smaller_side(candidates.nearest_by_vectors(vectors, k))
    char = candidates.smaller_side(candidates.nearest_by_grams(names.char_tfidf(table), table, k))
    pairs = candidates.candidate_pairs(semantic, char, candidates.acronym_bridges(table))
    feats = features.pair_features(pairs, table).checkpoint()
    seeds = features.seed_pairs(feats)
    none = _empty(spark, "i long, j long")
    approved, rejected, told = none, none, feats.limit(0)
    if reviewed is not None:
        numbered = reviewed.withColumn("cluster_id", F.xxhash64("cluster"))
        pairs_told = feedback.feedback_pairs(feedback.parse_feedback(numbered, "cluster_id"), table).checkpoint()
        plain = pairs_told.select("i", "j").distinct().withColumns({"s_cos": F.lit(0.0), "s_chr": F.lit(0.0), "bridge": F.lit(0.0)})
        told = features.pair_features(plain, table, zero_cosine=zero_cosine_feedback).checkpoint()
        warm = verifier.Verifier.fit(features.training_set(seeds, none, none, feats, told), previous=warm)
        scored = warm.score(told).select("i", "j", "p") if warm else told.select("i", "j", F.lit(0.0).alias("p"))
        known = warm.score(feats).select("i", "j", F.col("p").alias("q")) if warm else none.withColumn("q", F.lit(0.0))
        scored = scored.join(known, ["i", "j"], "left").select("i", "j", F.coalesce("q", "p").alias("p"))
        approved = pairs_told.where("approved").select("i", "j").distinct()
        rejected = feedback.mine_negatives(pairs_told.where("not approved").join(scored, ["i", "j"])).select("i", "j").distinct()
        by_id = table.select("name_id", "name")
        named = lambda df, kind: df.join(by_id.toDF("i", "a"), "i").join(by_id.toDF("j", "b"), "j").select(F.lit(kind).alias("kind"), "a", "b")
        constraints = feedback.union_constraints(constraints, named(approved, "must"), named(rejected, "cannot")).checkpoint()
    fresh = features.training_set(seeds, approved, rejected, feats, told).checkpoint()
    training = fresh if history is None else fresh.unionByName(history)
    model = verifier.Verifier.fit(training, previous=previous)
    scored = (model.score(feats) if model else feats.withColumn("p", F.lit(0.0))).select("i", "j", "p").checkpoint()
    links = feedback.constraints_to_ids(constraints, table)
    must, cannot = links.where("kind = 'must'").select("i", "j"), links.where("kind = 'cannot'").select("i", "j")
    merged = clustering.cluster_no_chaining(nodes, scored, model.threshold if model else 0.5, must, cannot).withColumnRenamed("node", "name_id").checkpoint()
    pure = clustering.purify(merged, vectors, must).checkpoint()
    labels = clustering.assign_acronyms(pure, table, vectors).checkpoint()
    return Resolution(table, labels, scored, model, constraints, {"training": training, "fresh": fresh, "warm": warm, "merged": merged})


def filter_folder(spark: SparkSession, source: str, target: str) -> list[tuple[str, int, int]]:
    """Dialect with comma lists over all CSV files below a folder, mirrored below `target`: (file, kept, total) of each that has a code column.

    A file of which no row is kept gets no output.
    """
    done = []
    for path in files.list_files(spark, source, recursive=True):
        df = files.read_csv(spark, path)
        column = filtering.detect_code_column(df)
        if column is None:
            continue
        counted = filtering.filter_counts(df, column).first()
        if counted["kept"]:
            files.write_csv(filtering.filter_comma(df, column), files.mirrored(path, source, target))
        done.append((path, counted["kept"], counted["total"]))
    return done


def filter_files(spark: SparkSession, paths: list[str], target: str) -> list[str]:
    """Dialect with semicolon lists over given files; writes the full and the selected columns of each."""
    done = []
    for path in paths:
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        try:
            kept = filtering.filter_semicolon(files.read_csv(spark, path))
        except ValueError:
            continue
        files.write_csv(kept, f"{target}/{stem}_filtered_HSCode.csv")
        files.write_csv(filtering.select_kept(kept), f"{target}/{stem}_filtered_HSCode_selected_columns.csv")
        done.append(stem)
    return done


def cluster_folder(spark: SparkSession, source: str, target: str, columns: list[str], reviewed: str | None = None, emit_review: int = 0, review_target: str | None = None, model_path: str | None = None, constraints_path: str | None = None) -> int:
    """Cluster every CSV file of a folder in sorted order; the verifier and the constraints carry over from file to file. The number of files with output."""
    done = 0
    model = verifier.Verifier.load(spark, model_path) if model_path else None
    constraints = files.read_constraints(spark, constraints_path) if constraints_path else None
    told = files.read_feedback(spark, reviewed) if reviewed else None
    history = verifier.Verifier.history(spark, model_path) if model_path else None
    warm = verifier.Verifier.load(spark, f"{model_path}_warm") if model_path else None
    for path in files.list_files(spark, source):
        column = filtering.pick_column(files.header(spark, path) or [], columns)
        if column is None:
            continue
        df = files.read_csv(spark, path).coalesce(1).withColumn("pos", F.monotonically_increasing_id())
        result = resolve_names(names.name_counts(df, column, F.col("pos")), constraints, told, history, model, warm=warm)
        learned = result.model is not None and (model is None or result.model.updates > model.updates)
        model, constraints, history, warm = result.model, result.constraints, result.extra.get("training", history), result.extra.get("warm", warm)
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        files.write_lines(result.report(), f"{target}/{stem}.txt")
        if emit_review > 0:
            files.write_csv(result.review(emit_review), f"{review_target or target}/{stem}_review_clusters.csv")
        if told is not None and constraints_path:
            files.write_constraints(constraints, constraints_path)
        if model is not None and model_path:
            model.save(spark, model_path)
            if learned:
                model.remember(result.extra["fresh"], model_path)
            if warm is not None:
                warm.save(spark, f"{model_path}_warm")
        done += 1
    return done
