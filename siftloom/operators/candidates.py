"""Candidate pairs: exact nearest neighbours by vectors and by character grams, acronym bridges, their union."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.operators.clustering import ensure_checkpoint_dir

BLOCK = 2048
#: Similarities are compared at this many decimals, so that the order of floating sums doesn't decide ties.
DECIMALS = 9
BUFFERED = "spark.sql.cartesianProductExec.buffer.in.memory.threshold"


def neighbours_asked(n: int) -> int:
    """How many neighbours, the name itself among them: max(10, isqrt(n) + 3), within 2 and n."""
    k = min(max(10, math.isqrt(n) + 3), n)
    return max(2, min(k, n)) if n > 1 else 0


def best_of_block(sim: np.ndarray, least: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded similarity) of the entries that can be among a row's `most` best, ties to the earlier column: those of at least `least` per row, the best `most` where there are more."""
    near = sim >= (least - 10.0**-DECIMALS)[:, None]
    near &= sim > -np.inf
    full = np.flatnonzero(near.sum(axis=1) > most)
    if len(full):
        part = np.round(sim[full], DECIMALS)
        edge = np.maximum(np.partition(part, -most, axis=1)[:, -most], least[full])[:, None]
        above, tied = part > edge, part == edge
        near[full] = above | tied & (np.cumsum(tied, axis=1) <= most - above.sum(axis=1, keepdims=True))
    rows, columns = np.nonzero(near)
    return rows, columns, np.round(sim[rows, columns], DECIMALS)


def best_per_row(rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, similarity, rank from 1) of each row's `most` best, ties to the smaller id."""
    order = np.lexsort((ids, -sims, rows))
    rows, ids, sims = rows[order], ids[order], sims[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
    kept = rank <= most
    return rows[kept], ids[kept], sims[kept], rank[kept]


def nearest_by_vectors(vectors: DataFrame, k: int, id_column: str = "name_id") -> DataFrame:
    """(i, j, sim, rank): the k - 1 most similar others of each row by cosine, ties to the smaller id; zero vectors are similar to nothing (0).

    Exact by definition, so every block of 2048 vectors meets every block. The blocks are written once; a task reads all of them past its own
    ones and holds the best k - 1 of one block's rows, so that neither blocks nor similarities are shuffled for it.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    if spark.conf.get(BUFFERED, "4096") == "4096":  # rows of the blocks read past, which are large: beyond these they lie in memory that Spark manages and spills
        spark.conf.set(BUFFERED, "16")
    single = vectors.schema["v"].dataType.elementType.typeName() == "float"
    kind, most = np.float32 if single else np.float64, max(0, k - 1)
    keyed = vectors.select(F.col(id_column).cast("long").alias("id"), F.col("v").cast("array<float>" if single else "array<double>").alias("v")).where("v is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, n = [], [], 0
        made = itertools.count(TaskContext.get().partitionId() << 32)

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([next(made)], pa.int64()), pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(x).tobytes()])], names=["block", "ids", "x"])

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                some = batch.slice(lo, BLOCK - n)
                lo, n = lo + some.num_rows, n + some.num_rows
                ids.append(some.column(0).to_numpy())
                x.append(some.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(some.num_rows, -1))
                if n == BLOCK:
                    yield block()
                    ids, x, n = [], [], 0
        if n:
            yield block()

    def opened(ids: pa.Scalar, x: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        """Ids in their order and unit vectors; rows that hold anything but numbers are similar to nothing, not even by 0."""
        ids = np.frombuffer(ids.as_buffer(), np.int64)
        x = np.frombuffer(x.as_buffer(), kind).reshape(len(ids), -1).astype(float)
        sound = np.isfinite(x).all(axis=1)
        ids, x = ids[sound], x[sound]
        order = np.argsort(ids, kind="stable")
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return ids[order], np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)[order]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a, x, least, held, amount = None, None, None, None, [], 0

        def reduced() -> tuple[np.ndarray, ...]:
            return best_per_row(*(np.concatenate(c) for c in zip(*held, strict=True)), most)

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                rows, j, sims, rank = reduced()
                for at in range(0, len(rows), 1 << 17):
                    part = slice(at, at + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a[rows[part]], j[part], sims[part], rank[part].astype(np.int32))], names=["i", "j", "sim", "rank"])

        for batch in batches:
            for block, ids, own, others, y in zip(*(batch.column(c) for c in range(5)), strict=True):
                if block.as_py() != now:
                    yield from done()
                    now, (a, x) = block.as_py(), opened(ids, own)
                    least, held, amount = np.full(len(a), -np.inf), [], 0
                b, y = opened(others, y)
                if not most or not len(a) or not len(b):
                    continue
                sim = x @ y.T
                if a[0] <= b[-1] and b[0] <= a[-1]:
                    sim[a[:, None] == b[None, :]] = -np.inf
                rows, columns, sims = best_of_block(sim, least, most)
                held.append((rows, b[columns], sims))
                amount += len(rows)
                if amount > 2 * most * len(a):
                    rows, j, sims, rank = reduced()
                    held, amount = [(rows, j, sims)], len(rows)
                    least[rows[rank == most]] = sims[rank == most]
        yield from done()

    n = keyed.count()
    blocks = keyed.repartition(max(1, min(-(-n // (BLOCK - 48)), 2000))).mapInArrow(pack, "block long, ids binary, x binary").checkpoint(eager=True)
    met = blocks.crossJoin(blocks.select(F.col("ids").alias("others"), F.col("x").alias("y")).coalesce(1).hint("shuffle_replicate_nl"))
    return met.mapInArrow(best, "i long, j long, sim double, rank int")


def nearest_by_grams(tfidf: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(i, j, sim, rank) by cosine of gram weights: an inverted index joined on the gram, filled up with the smallest ids at similarity 0."""
    a, b = tfidf.alias("a"), tfidf.alias("b")
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.name_id") != F.col("b.name_id")))
    sims = met.groupBy(F.col("a.name_id").alias("i"), F.col("b.name_id").alias("j")).agg(F.round(F.sum(F.col("a.w") * F.col("b.w")), DECIMALS).alias("sim")).where("sim > 0")
    rank = Window.partitionBy("i").orderBy(F.col("sim").desc(), "j")
    best = sims.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k - 1)
    few = names.select(F.col("name_id").alias("i")).join(best.groupBy("i").agg(F.count("*").alias("n")), "i", "left").where(F.coalesce("n", F.lit(0)) < k - 1).select("i")
    # names short of neighbours take the smallest ids they haven't got: k of them besides those got are enough
    first = names.select(F.col("name_id").alias("j")).orderBy("j").limit(2 * k)
    fill = few.join(F.broadcast(first), F.col("i") != F.col("j")).join(sims.select("i", "j"), ["i", "j"], "left_anti").withColumn("sim", F.lit(0.0))
    some = best.select("i", "j", "sim").join(few, "i")
    filled = some.unionByName(fill.select("i", "j", "sim")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k - 1)
    return best.join(few, "i", "left_anti").select("i", "j", "sim", "rank").unionByName(filled)


def smaller_side(nearest: DataFrame) -> DataFrame:
    """(i, j, sim) where i < j: a pair counts only if the smaller id lists it."""
    return nearest.where("i < j").select("i", "j", "sim")


def acronym_bridges(names: DataFrame, most: int = 12) -> DataFrame:
    """(i, j): acronym-only names with expansions whose initials are their key. names: the columns of `described`."""
    short = names.where("acronym_only").select(F.col("name_id").alias("s"), F.col("akey").alias("key"))
    long = names.where(~F.col("acronym_only") & F.length("acr").between(1, most)).select(F.col("name_id").alias("l"), F.col("acr").alias("key"))
    return short.join(long, "key").select(F.least("s", "l").alias("i"), F.greatest("s", "l").alias("j")).distinct()


def candidate_pairs(semantic: DataFrame, char: DataFrame, bridges: DataFrame) -> DataFrame:
    """(i, j, s_cos, s_chr, bridge): the union of all channels, the best score of each, 0 where a channel has none."""
    zero = F.lit(0.0)
    union = (
        semantic.select("i", "j", F.col("sim").alias("s_cos"), zero.alias("s_chr"), zero.alias("bridge"))
        .unionByName(char.select("i", "j", zero.alias("s_cos"), F.col("sim").alias("s_chr"), zero.alias("bridge")))
        .unionByName(bridges.select("i", "j", zero.alias("s_cos"), zero.alias("s_chr"), F.lit(1.0).alias("bridge")))
    )
    return union.groupBy("i", "j").agg(F.max("s_cos").alias("s_cos"), F.max("s_chr").alias("s_chr"), F.max("bridge").alias("bridge"))
