"""Clusters without chaining: components, constrained merging, purification and the acronym pass."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MISC = -999_999


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Where the cluster names no folder in spark.checkpoint.dir (tests), a temporary one."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp())


def connected(edges: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that is reachable over edges (i, j); nodes without edges are their own.

    Labels fall to the neighbourhood's least and then jump to their label's label, so chains shorten by doubling; each round is
    checkpointed in the folder of spark.checkpoint.dir.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.where("i <> j").select(F.col("i").alias("u"), F.col("j").alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    now = nodes.select("node", F.col("node").alias("label")).checkpoint()
    for _ in range(rounds):
        seen = both.join(now.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        low = now.join(seen, now["node"] == seen["u"], "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        jump = low.select(F.col("node").alias("at"), F.col("label").alias("to"))
        new = low.join(jump, low["label"] == jump["at"], "left").select("node", F.least("label", F.coalesce("to", "label")).alias("label"), "old").checkpoint()
        now = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return now.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not converge")


def must_components(nodes: DataFrame, must: DataFrame) -> DataFrame:
    return connected(must, nodes)


def cluster_ids(components: DataFrame) -> DataFrame:
    """(node, label): clusters numbered from 0 by their smallest node."""
    return components.select("node", (F.dense_rank().over(Window.orderBy("component")) - 1).cast("long").alias("label"))


class _Merge:
    """State of one component: members by root, and who may not be together."""

    def __init__(self, nodes: list[int], p: dict[tuple[int, int], float], cannot: set[tuple[int, int]], threshold: float, density: float, strong: float):
        self.root = {v: v for v in nodes}
        self.members = {v: [v] for v in nodes}
        self.p, self.cannot, self.t, self.density, self.strong = p, cannot, threshold, density, strong

    def tie(self, a: int, b: int) -> float:
        return self.p.get((a, b) if a < b else (b, a), 0.0)

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root[a], self.root[b]
        if ra == rb:
            return
        if len(self.members[ra]) < len(self.members[rb]):
            ra, rb = rb, ra
        for v in self.members[rb]:
            self.root[v] = ra
        self.members[ra] += self.members.pop(rb)

    def allowed(self, a: list[int], b: list[int]) -> bool:
        """Cross ties decide: a singleton needs two supports or a strong one, larger sides need density and an anchor for every member."""
        if any(((x, y) if x < y else (y, x)) in self.cannot for x in a for y in b):
            return False
        ties = [[self.tie(x, y) for y in b] for x in a]
        supports = sum(v >= self.t for row in ties for v in row)
        if len(a) == 1 or len(b) == 1:
            return supports >= 2 or max(v for row in ties for v in row) >= min(0.95, self.t + self.strong)
        anchored = all(max(row) >= self.t for row in ties) and all(max(column) >= self.t for column in zip(*ties, strict=True))
        return anchored and supports / (len(a) * len(b)) >= self.density


def cluster_no_chaining(nodes: DataFrame, scored: DataFrame, threshold: float, must: DataFrame, cannot: DataFrame, density: float = 0.60, strong: float = 0.10) -> DataFrame:
    """(node, label): greedy constrained merging. scored: (i, j, p); must and cannot: (i, j), all with i < j.

    Merges happen only along must links and pairs with p at the threshold or above, so components over those are
    independent: each is merged in one group, in the global order of its own pairs, and the rest never meet.
    """
    live = scored.where(F.col("p") >= threshold).select("i", "j", "p")
    component = connected(live.select("i", "j").unionByName(must.select("i", "j")), nodes)
    ci, cj = component.toDF("i", "component"), component.toDF("j", "other")

    def inside(edges: DataFrame, kind: int) -> DataFrame:
        p = "p" if "p" in edges.columns else F.lit(0.0).alias("p")
        return edges.select("i", "j", p).join(ci, "i").join(cj, "j").where("component = other").select("component", F.lit(kind).alias("kind"), "i", "j", "p")

    own = component.select("component", F.lit(0).alias("kind"), F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.0).alias("p"))
    work = own.unionByName(inside(live, 1)).unionByName(inside(must, 2)).unionByName(inside(cannot, 3))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        of = {k: g for k, g in pdf.groupby("kind")}
        rows = lambda k: list(of[k][["i", "j", "p"]].itertuples(index=False, name=None)) if k in of else []
        nodes_here = sorted(i for i, _, _ in rows(0))
        state = _Merge(nodes_here, {(i, j): p for i, j, p in rows(1)}, {(i, j) for i, j, _ in rows(3)}, threshold, density, strong)
        for i, j, _ in sorted(rows(2)):
            state.join(i, j)
        for _, i, j in sorted(((p, i, j) for i, j, p in rows(1)), reverse=True):
            a, b = state.root[i], state.root[j]
            if a != b and state.allowed(state.members[a], state.members[b]):
                state.join(i, j)
        least = {r: min(m) for r, m in state.members.items()}
        return pd.DataFrame({"node": nodes_here, "component": [least[state.root[v]] for v in nodes_here]})

    merged = work.groupBy("component").applyInPandas(merge, "node long, component long")
    return cluster_ids(merged)


def centroids(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """(label, pos, x): mean vectors of labels from 0, in long form; not normalised."""
    return labels.where("label >= 0").join(vectors, "name_id").select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))


def similarity_to_centroid(rows: DataFrame, vectors: DataFrame, cents: DataFrame) -> DataFrame:
    """rows (name_id, label) with sim, the cosine to the label's centroid; 0 for a zero vector."""
    parts = rows.join(vectors, "name_id").select("name_id", "label", F.posexplode("v").alias("pos", "x"))
    met = parts.join(cents.withColumnRenamed("x", "c"), ["label", "pos"])
    sums = met.groupBy("name_id", "label").agg(F.sum(F.col("x") * F.col("c")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("c") * F.col("c")).alias("b"))
    norm = F.sqrt("a") * F.sqrt("b")
    return sums.select("name_id", "label", F.when(norm > 0, F.col("d") / norm).otherwise(F.lit(0.0)).alias("sim"))


def gate(sims: DataFrame, share: float, floor: float, default: float) -> DataFrame:
    """One row: the exact percentile of sim, `floor` at least, or `default` without rows."""
    return sims.agg(F.coalesce(F.greatest(F.percentile("sim", F.lit(share)), F.lit(floor)), F.lit(default)).alias("gate"))


def purify(labels: DataFrame, vectors: DataFrame, must: DataFrame, share: float = 0.20, floor: float = 0.45) -> DataFrame:
    """(name_id, label): members below the gate leave their cluster (-1), unless a must link holds them."""
    sims = similarity_to_centroid(labels.where("label >= 0"), vectors, centroids(labels, vectors))
    held = must.select(F.col("i").alias("name_id")).union(must.select("j")).distinct().withColumn("held", F.lit(True))
    judged = sims.crossJoin(F.broadcast(gate(sims, share, floor, 0.5))).select("name_id", (F.col("sim") < F.col("gate")).alias("low"))
    out = labels.join(judged, "name_id", "left").join(held, "name_id", "left")
    evict = F.coalesce("low", F.lit(False)) & ~F.coalesce("held", F.lit(False))
    return out.select("name_id", F.when(evict, F.lit(-1)).otherwise(F.col("label")).cast("long").alias("label"))


def acronym_votes(labels: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """(key, votes, clusters, only): per acronym of clustered names, how many names and clusters have it; `only` is the least cluster."""
    rows = labels.where("label >= 0").join(names, "name_id").where(F.length("acr").between(1, most))
    return rows.groupBy(F.col("acr").alias("key")).agg(F.count("*").alias("votes"), F.countDistinct("label").alias("clusters"), F.min("label").alias("only"))


def assign_acronyms(labels: DataFrame, names: DataFrame, vectors: DataFrame, share: float = 0.30, floor: float = 0.50) -> DataFrame:
    """(name_id, label): an acronym-only name joins the one cluster that owns its key if near enough; else it goes to the misc label if any cluster owns the key."""
    cents = centroids(labels, vectors)
    sims = similarity_to_centroid(labels.where("label >= 0"), vectors, cents)
    short = names.where("acronym_only").select("name_id", F.col("akey").alias("key"))
    owned = short.join(acronym_votes(labels, names), "key").select("name_id", "clusters", F.col("only").alias("label"))
    near = similarity_to_centroid(owned.where("clusters = 1").select("name_id", "label"), vectors, cents).select("name_id", "sim")
    judged = owned.join(near, "name_id", "left").crossJoin(F.broadcast(gate(sims, share, floor, 0.55)))
    new = judged.select("name_id", F.when((F.col("clusters") == 1) & (F.coalesce("sim", F.lit(-2.0)) >= F.col("gate")), F.col("label")).otherwise(F.lit(MISC)).alias("new"))
    return labels.join(new, "name_id", "left").select("name_id", F.coalesce("new", "label").cast("long").alias("label"))
