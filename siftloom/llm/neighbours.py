"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector by `projections` Gaussian projections cut into cells of `width`. A query visits, in every table, its own
bucket and then perturbed ones in the order of their estimated chance to hold neighbours (the sum of squared distances from the query's
projections to the cells' walls). Candidates of all tables are merged and ranked by exact Euclidean distance in double precision.

Equal vectors are indexed once and expanded behind the search, so a vector that many rows share fills no bucket. Queries and
vectors meet by bucket: both are dealt by ranges of buckets, so no task needs all of either, and each task returns only the best few
of each query. A range that holds too many vectors (a dense bucket) is salted: its vectors are dealt over several parts, all of which its
queries visit. A query whose buckets hold too few points is searched exactly, in blocks. The random projections are fixed by a seed; only
the cells' width follows the data, by the root mean square distance of all vectors from their mean.

Defined results: vectors that are null, zero, or of another length than most, or that hold null or non-finite components, take no part, as
query or candidate; rows with null ids take no part; rows that repeat an id and its vector count once; an id with several vectors is as many
queries and candidates, and never its own neighbour; a query with fewer candidates than k gets all there are; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.llm.bytescan import mix
from siftloom.llm.common import batch_of, cut, parts


@dataclass(frozen=True)
class Hashing:
    """Projections of all tables: h = floor((v a + b) / (width * scale)); the scale is the root mean square distance of the vectors from their mean."""

    dimension: int
    tables: int = 4
    projections: int = 6
    width: float = 2.0
    probes: int = 80
    seed: int = 11
    scale: float = 1.0

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, table])
        a = rng.standard_normal((self.dimension, self.projections))
        b = rng.uniform(0, self.width, self.projections)
        return (vectors / self.scale @ a + b) / self.width

    def code(self, cells: np.ndarray, table: int) -> np.ndarray:
        """64-bit bucket codes of cell numbers."""
        h = np.full(cells.shape[:-1], table + 1, np.uint64)
        for j in range(self.projections):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[..., j].astype(np.int64).view(np.uint64))
        return h

    def perturbations(self) -> list[tuple[int, ...]]:
        """Sets of places in the list of walls sorted by distance, best expected score first; the expectation serves all queries alike."""
        m = self.projections
        expected = [i * (i + 1) / (4 * (m + 1) * (m + 2)) if i <= m else 1 - (2 * m + 1 - i) / (m + 1) + (2 * m + 1 - i) * (2 * m + 2 - i) / (4 * (m + 1) * (m + 2)) for i in range(1, 2 * m + 1)]
        out: list[tuple[int, ...]] = [()]
        heap = [(expected[0], (0,))]
        while heap and len(out) < self.probes:
            score, chosen = heapq.heappop(heap)
            # places i and 2m - 1 - i are the two walls of one cell
            if all(2 * m - 1 - i not in chosen for i in chosen):
                out.append(chosen)
            last = chosen[-1]
            if last + 1 < 2 * m:
                heapq.heappush(heap, (score + expected[last + 1], (*chosen, last + 1)))
                heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*chosen[:-1], last + 1)))
        return out

    def probe_codes(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """Bucket codes to visit, one row per vector, in estimated success order."""
        place = self.places(vectors, table)
        cell = np.floor(place)
        low = place - cell
        walls = np.concatenate([low, 1 - low], axis=1)
        order = np.argsort(walls, axis=1, kind="stable")
        m = self.projections
        # the far wall of the cell whose near wall is at i stands at 2m - 1 - i: order the second half by the first
        near = order[:, :m].copy()
        taken = near % m
        out = []
        for chosen in self.perturbations():
            cells = cell.copy()
            rows = np.arange(len(vectors))
            for i in chosen:
                if i < m:
                    which, up = taken[:, i], near[:, i] >= m
                else:
                    which, up = taken[:, 2 * m - 1 - i], near[:, 2 * m - 1 - i] < m
                cells[rows, which] += np.where(up, 1, -1)
            out.append(self.code(cells, table))
        return np.stack(out, axis=1)


def usable(table: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), finite.alias("ok"))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") == dimension) & F.col("ok") & F.exists("v", lambda x: x != 0)).select("vec_id", "v")


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)


INDEX_DDL = "part int, kind int, ids binary, codes binary, vectors binary"
INDEX = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary()), ("vectors", pa.binary())])


def couples(batch: pa.RecordBatch) -> np.ndarray:
    """(name, tie) of each point: its number, and the smallest id that has the vector, which decides ties."""
    return np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)


def from_couples(data: pa.Buffer | bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, 2)


def nearest(points: np.ndarray, score: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """The `best` nearest of (name, tie) points, each once, ties to the smaller id."""
    _, first = np.unique(points[:, 0], return_index=True)
    points, score = points[first], score[first]
    top = np.lexsort((points[:, 1], score))[:best]
    return points[top], score[top]


@dataclass(frozen=True)
class Deal:
    """Ranges of bucket codes; a dense range (sorted numbers) has `extra` parts more, numbered from `first` on."""

    ranges: int
    dense: np.ndarray
    extra: np.ndarray
    first: np.ndarray

    def range_of(self, codes: np.ndarray) -> np.ndarray:
        return (codes % np.uint64(self.ranges)).astype(np.int64)

    def parts(self, ranges: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The part of each vector: its range, or one of a dense range's parts by the vector's salt."""
        if not len(self.dense):
            return ranges
        k = np.minimum(np.searchsorted(self.dense, ranges), len(self.dense) - 1)
        pick = (salt % (self.extra[k] + 1).astype(np.uint64)).astype(np.int64)
        return np.where((self.dense[k] == ranges) & (pick > 0), self.first[k] + pick - 1, ranges)

    def added(self, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into `ranges`, part) of the further parts that visits of these ranges have to go to."""
        if not len(self.dense):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.dense, ranges), len(self.dense) - 1)
        at = np.flatnonzero(self.dense[k] == ranges)
        count = self.extra[k[at]]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at, count), np.repeat(self.first[k[at]], count) + place


#: At most so many ranges are salted.
DENSE_RANGES = 1_000_000


def deal(rows: DataFrame, hashing: Hashing, ranges: int, most: int) -> Deal:
    """Ranges with more than `most` vectors get a part for each `most`; only their numbers reach the driver, DENSE_RANGES at most."""
    schema = pa.schema([("range", pa.int64()), ("n", pa.int64())])
    plain = Deal(ranges, *(np.zeros(0, np.int64),) * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2), hashing.dimension)
            codes = [hashing.code(np.floor(hashing.places(v, t)), t) for t in range(hashing.tables)]
            yield batch_of(schema, list(np.unique(plain.range_of(np.concatenate(codes)), return_counts=True)))

    counts = cut(rows.mapInArrow(run, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(most, -(-total // DENSE_RANGES))
    heavy = counts.where(F.col("n") > most).orderBy("range").toPandas()
    extra = (-(-heavy["n"].to_numpy(np.int64) // most)) - 1
    return Deal(ranges, heavy["range"].to_numpy(np.int64), extra, ranges + np.cumsum(extra) - extra)


def dealt(rows: DataFrame, hashing: Hashing, plan: Deal, query: bool) -> DataFrame:
    """Vectors (or queries, once per part that holds a bucket they visit) packed by part. rows: (name, tie, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                ids, v = couples(part), matrix(part.column(2), hashing.dimension)
                for t in range(hashing.tables):
                    codes = hashing.probe_codes(v, t) if query else hashing.code(np.floor(hashing.places(v, t)), t)[:, None]
                    owner, flat = np.repeat(np.arange(len(ids)), codes.shape[1]), codes.ravel()
                    own = plan.range_of(flat)
                    if query:
                        at, further = plan.added(own)
                        owner, flat, own = np.r_[owner, owner[at]], np.r_[flat, flat[at]], np.r_[own, further]
                    else:
                        own = plan.parts(own, mix(ids[:, 0].view(np.uint64)))
                    order = np.argsort(own, kind="stable")
                    own, owner, flat = own[order], owner[order], flat[order]
                    bounds = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    out = []
                    for i, j in zip(bounds, np.r_[bounds[1:], len(own)], strict=True):
                        r, who = own[i], owner[i:j]
                        out.append((r, int(query), ids[who].tobytes(), flat[i:j].tobytes(), b"" if query else v[who].tobytes()))
                        if query:
                            some = np.unique(who)
                            out.append((r, 2, ids[some].tobytes(), b"", v[some].tobytes()))
                    yield batch_of(INDEX, [list(c) for c in zip(*out, strict=True)])

    return rows.mapInArrow(run, INDEX_DDL)


def search_ranges(index: DataFrame, queries: DataFrame, hashing: Hashing, best: int) -> DataFrame:
    """(query, points, distances): the `best` nearest candidates of each query's point in each range, packed."""
    schema = pa.schema([("query", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary())])
    d = hashing.dimension

    def unpack(table: pa.Table, kind: int):
        part = [(from_couples(r["ids"]), np.frombuffer(r["codes"], np.uint64), np.frombuffer(r["vectors"], np.float64)) for r in table.to_pylist() if r["kind"] == kind]
        return [np.concatenate(x) if x else np.zeros(0) for x in (zip(*part, strict=True) if part else ([], [], []))]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, codes, flat = unpack(left, 0)
        asked, visits, _ = unpack(right, 1)
        known, _, given = unpack(right, 2)
        if not len(ids) or not len(asked):
            return pa.Table.from_batches([], schema=schema)
        vectors = flat.reshape(-1, d)
        asked = asked[:, 0]
        known, at = np.unique(known[:, 0], return_index=True)
        given = given.reshape(-1, d)[at]
        order = np.argsort(codes, kind="stable")
        ids, codes, vectors = ids[order], codes[order], vectors[order]
        begin, end = np.searchsorted(codes, visits, "left"), np.searchsorted(codes, visits, "right")
        hit = end > begin
        asked, begin, end = asked[hit], begin[hit], end[hit]
        by = np.argsort(asked, kind="stable")
        out = []
        bounds = np.flatnonzero(np.r_[True, asked[by][1:] != asked[by][:-1]]) if len(by) else []
        for a, b in zip(bounds, np.r_[bounds[1:], len(by)] if len(by) else [], strict=True):
            q = asked[by[a]]
            rows = np.concatenate([np.arange(begin[i], end[i]) for i in by[a:b]])
            v = given[np.searchsorted(known, q)]
            found, score = nearest(ids[rows], np.sqrt(((vectors[rows] - v) ** 2).sum(axis=1)), best)
            out.append((int(q), found.tobytes(), score.tobytes()))
        return pa.table([list(c) for c in zip(*out, strict=True)], schema=schema) if out else pa.Table.from_batches([], schema=schema)

    return index.groupBy("part").cogroup(queries.groupBy("part")).applyInArrow(run, "query long, ids binary, scores binary")


def spread(rows: DataFrame) -> float:
    """Root mean square distance of all vectors from their mean; 1 if there is none."""
    parts = rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.var_pop("x").alias("s"))
    total = parts.agg(F.sum("s")).first()[0]
    return float(np.sqrt(total)) if total and np.isfinite(total) and total > 0 else 1.0


def exact_ranges(vectors: DataFrame, queries: DataFrame, dimension: int, best: int, block: int = 2048) -> DataFrame:
    """As search_ranges, over all vectors: for queries whose buckets hold too few. Blocks of queries meet blocks of vectors, packed."""
    schema = pa.schema([("query", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary())])
    pack_schema = pa.schema([("ids", pa.binary()), ("vectors", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                yield batch_of(pack_schema, [[couples(part).tobytes()], [matrix(part.column(2), dimension).tobytes()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                asked, ids = from_couples(r["qids"])[:, 0], from_couples(r["ids"])
                q, v = np.frombuffer(r["qvectors"]).reshape(-1, dimension), np.frombuffer(r["vectors"]).reshape(-1, dimension)
                out = []
                for k in range(len(asked)):
                    found, score = nearest(ids, np.sqrt(((v - q[k]) ** 2).sum(axis=1)), best)
                    out.append((int(asked[k]), found.tobytes(), score.tobytes()))
                yield batch_of(schema, [list(c) for c in zip(*out, strict=True)])

    left = queries.mapInArrow(pack, "ids binary, vectors binary").toDF("qids", "qvectors")
    return left.crossJoin(vectors.mapInArrow(pack, "ids binary, vectors binary")).mapInArrow(run, "query long, ids binary, scores binary")


def search(table: DataFrame, is_query, k: int = 10, hashing: Hashing | None = None, range_bytes: int = 24 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found. is_query: a condition on vec_id; ranges of buckets hold about `range_bytes`."""
    spark = table.sparkSession
    common = table.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    hashing = hashing or Hashing(int(common["d"]))
    rows = usable(table, hashing.dimension)
    hashing = replace(hashing, scale=hashing.scale * spread(rows))
    # equal vectors are one point with a number; its members are the k + 1 smallest ids, as no more can be among a query's answers
    keyed = rows.withColumn("key", F.xxhash64("v")).withColumn("key2", F.xxhash64(F.lit(3), "v"))
    each = keyed.select("key", "key2", "vec_id").distinct()
    points = cut(keyed.groupBy("key", "key2").agg(F.min("vec_id").alias("tie"), F.first("v").alias("v")).withColumn("name", F.monotonically_increasing_id()))
    order = Window.partitionBy("key", "key2", "salt").orderBy("vec_id")
    least = each.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    order = Window.partitionBy("key", "key2").orderBy("vec_id")
    members = least.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).join(points.select("key", "key2", "name"), ["key", "key2"]).select("name", F.col("vec_id").alias("found"))
    vectors = points.select("name", "tie", "v")
    points_asked = cut(each.where(is_query).join(points.select("key", "key2", "name"), ["key", "key2"]).select(F.col("name").alias("point"), "vec_id"))
    queries = vectors.join(points_asked.select(F.col("point").alias("name")).distinct(), "name", "left_semi").select("name", "tie", "v")
    each_bytes = 8 * hashing.dimension + 16
    ranges = max(parts(spark), -(-points.count() * hashing.tables * each_bytes // range_bytes))
    plan = deal(vectors, hashing, ranges, max(1, 2 * range_bytes // each_bytes))
    # a point's own other members are neighbours as well, so one more point than k is kept
    found = search_ranges(dealt(vectors, hashing, plan, False), dealt(queries, hashing, plan, True), hashing, k + 1)

    def merge(part: pa.Table) -> pa.Table:
        ids = np.concatenate([from_couples(x.as_buffer()) for x in part.column("ids")])
        score = np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in part.column("scores")])
        ids, score = nearest(ids, score, k + 1)
        return pa.table([np.full(len(ids), part.column("query")[0].as_py()), ids[:, 0], score], names=["point", "name", "score"])

    near = cut(found.groupBy("query").applyInArrow(merge, "point long, name long, score double"))
    # queries whose buckets hold fewer points than asked for are searched exactly
    enough = near.groupBy("point").agg(F.count("*").alias("n")).where(F.col("n") > k).select(F.col("point").alias("name"))
    short = cut(queries.join(enough, "name", "left_anti"))
    if not short.isEmpty():
        again = exact_ranges(vectors, short, hashing.dimension, k + 1).groupBy("query").applyInArrow(merge, "point long, name long, score double")
        near = near.join(short.select(F.col("name").alias("point")), "point", "left_anti").unionByName(again)
    # ties at the cut: equal distances of different points are kept to the k + 1 smallest ids, enough after expansion
    answers = points_asked.join(near, "point").join(members, "name").where(F.col("found") != F.col("vec_id"))
    rank = Window.partitionBy("vec_id", "point").orderBy("score", "found")
    ranked = answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select(F.col("vec_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("found").alias("vec_id"), "score")


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(table, F.col("vec_id") % 100 == 0)
