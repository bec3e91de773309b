"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

A lexicon of letter runs and run prefixes is learned from labelled rows (log odds of toxic against clean) and joined with
a short built-in list, so that words of any language count. Features are densities and rates of whole texts: lexicon
densities, hits near second-person words, capitals, punctuation, obfuscated words. The trees are trained on the driver
from at most `max_train` labelled rows (those with the smallest hash); the isotonic map comes from rows that the trees
didn't see. All rows are scored.

Defined results: a null or empty text has zero features and gets the score the model gives them; a null doc_id is scored
like any other; labels that are null or other than 0 and 1 are ignored; without labels of both classes the score is
a fixed function of the built-in lexicon's density. Repeated rows are each scored. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm import bytescan as bs
from siftloom.llm.common import batch_of, crc_fold, lean, text_slices, trimmed
from siftloom.llm.trees import BoostedTrees, isotonic_fit

SEED_WORDS = "bastard clown creep degenerate disgusting dumb filth filthy fool garbage idiot imbecile loser moron pathetic pig scum stupid trash ugly vermin worthless".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi vous votre du dich dir dein deine euch ihr tú ti usted ustedes vosotros vuestro".split()
PREFIXES = (4, 6, 8, 10)
FEATURES = ("log_runs", "seed_hits", "seed_density", "lex_hits", "lex_density", "lex_weight", "lex_weight_density", "lex_strongest", "lex_distinct", "near_you", "you_density", "caps_rate", "caps_words", "punct_rate", "bang_rate", "obfuscated", "digit_rate", "symbol_rate", "mean_run", "non_ascii")


def hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    offsets = np.cumsum([0] + [len(w) for w in raw]).astype(np.int64)
    hasher = bs.Hasher(np.frombuffer(b"".join(raw), np.uint8), fold=True)
    return hasher.of(offsets[:-1], offsets[1:])


def letter_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bs.Hasher]:
    start, end = bs.runs(bs.LETTER[buf], offsets)
    return start, end, bs.owner(offsets, start), bs.Hasher(buf, fold=True)


def keys_of(start: np.ndarray, end: np.ndarray, hasher: bs.Hasher) -> list[tuple[np.ndarray, np.ndarray]]:
    """(run indexes, hashes): whole runs, and prefixes of longer runs under hashes of their own."""
    out = [(np.arange(len(start)), hasher.of(start, end))]
    for n in PREFIXES:
        at = np.flatnonzero(end - start > n)
        out.append((at, hasher.of(start[at], start[at] + n) ^ np.uint64(0x5851F42D4C957F2D * n & (1 << 64) - 1)))
    return out


class Lexicon:
    """Sorted hashes with their log odds."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.odds = keys[order], odds[order]
        self.seed = np.sort(hash_words(SEED_WORDS))
        self.you = np.sort(hash_words(SECOND_PERSON))

    def weigh(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.odds[at], 0.0)


def among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def features(buf: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    start, end, doc, hasher = letter_runs(buf, offsets)
    count = np.bincount(doc, minlength=n).astype(float)
    weight = np.zeros(len(start))
    keys = keys_of(start, end, hasher)
    for at, key in keys:
        weight[at] = np.maximum(weight[at], lexicon.weigh(key))
    whole = keys[0][1]
    seed, you = among(lexicon.seed, whole), among(lexicon.you, whole)
    hit = (weight > 0) | seed
    where = np.flatnonzero(hit)
    second = np.flatnonzero(you)
    near = np.zeros(len(where))
    if len(second) and len(where):
        right = np.searchsorted(second, where)
        for side in (np.clip(right - 1, 0, None), np.clip(right, None, len(second) - 1)):
            gap = np.abs(second[side] - where).astype(float)
            near = np.maximum(near, np.where(doc[second[side]] == doc[where], 1 / (1 + gap), 0))
    size = np.maximum(np.diff(offsets), 1).astype(float)
    per_run = np.maximum(count, 1)
    by = lambda index, w=None: np.bincount(index, weights=w, minlength=n)
    strongest, distinct = np.zeros(n), np.zeros(n)
    if len(where):
        np.maximum.at(strongest, doc[where], weight[where])
        pair = np.unique(np.stack([doc[where].astype(np.uint64), whole[where]]), axis=1)[0].astype(np.int64)
        distinct = by(pair).astype(float)
    upper = bs.UPPER[buf]
    caps = bs.per_text(upper, offsets)
    ups = np.concatenate([[0], np.cumsum(upper)])
    caps_words = by(doc[(ups[end] - ups[start] == end - start) & (end - start > 1)])
    plain = bs.LETTER[buf] | bs.SPACE[buf] | bs.DIGIT[buf]
    punct = bs.per_text(~plain, offsets)
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in "#$%&*@|<>"]] = True
    symbols = symbol[buf]
    # a letter run that ends in a digit or symbol with a letter behind it: sh1t, st*pid
    inside = np.zeros(len(buf), bool)
    if len(buf) > 2:
        letter = bs.LETTER[buf]
        inside[1:-1] = letter[:-2] & letter[2:] & (symbols | bs.DIGIT[buf])[1:-1]
    out = [
        np.log1p(count), np.log1p(by(doc, seed)), by(doc, seed) / per_run, np.log1p(by(doc, hit)), by(doc, hit) / per_run,
        np.log1p(by(doc, weight)), by(doc, weight) / per_run, strongest, distinct, by(doc[where], near),
        by(doc, you) / per_run, caps / size, caps_words / per_run, punct / size, bs.per_text(buf == 0x21, offsets) / size,
        bs.per_text(inside, offsets) / per_run, bs.per_text(bs.DIGIT[buf], offsets) / size, bs.per_text(symbols, offsets) / size,
        by(doc, (end - start).astype(float)) / per_run, bs.per_text(buf >= 0x80, offsets) / size,
    ]
    return np.stack(out, axis=1)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column, max_train: int) -> DataFrame:
    """Labelled rows of the training part, at most `max_train`, those with the smallest hash of the id: (doc_id, text, y)."""
    chosen = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & train)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id")
        .limit(max_train)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def learn_lexicon(rows: DataFrame, least: int = 4, most: int = 4000, min_odds: float = 1.6) -> Lexicon:
    """Log odds of document frequencies among toxic and clean rows, for keys seen in `least` toxic rows or more."""
    schema = pa.schema([("key", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in text_slices(batch, "text"):
                start, end, doc, hasher = letter_runs(buf, offsets)
                pairs = [np.stack([doc[at].astype(np.uint64), key]) for at, key in keys_of(start, end, hasher)]
                both = np.concatenate(pairs, axis=1)
                order = np.lexsort((both[1], both[0]))
                both = both[:, order]
                first = np.ones(both.shape[1], bool)
                first[1:] = (both[:, 1:] != both[:, :-1]).any(axis=0)
                both = both[:, first]
                key, inverse = np.unique(both[1], return_inverse=True)
                toxic = np.bincount(inverse, weights=y[lo:hi][both[0].astype(np.int64)] == 1, minlength=len(key)).astype(np.int64)
                total = np.bincount(inverse, minlength=len(key))
                yield batch_of(schema, [key.view(np.int64), toxic, total - toxic])

    totals = rows.agg(F.sum(F.col("y").cast("long")).alias("t"), F.count("*").alias("n")).first()
    toxic, clean = int(totals["t"] or 0), int(totals["n"]) - int(totals["t"] or 0)
    if not toxic or not clean:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    best = (
        rows.select("text", "y").mapInArrow(trimmed(count), "key long, toxic long, clean long")
        .groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= least).withColumn("odds", odds).where(F.col("odds") >= min_odds)
        .orderBy(F.col("odds").desc(), "key").limit(most).select("key", "odds").toPandas()
    )
    return Lexicon(best["key"].to_numpy(np.int64).view(np.uint64), best["odds"].to_numpy(float))


def feature_rows(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, y, x array<double>) of training rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch, "text"):
                x = features(buf, offsets, lexicon)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield batch_of(schema, [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), flat])

    return rows.select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int")).mapInArrow(trimmed(scan), "doc_id long, y int, x array<double>")


class ToxicityModel:
    """Lexicon, trees and isotonic map; small enough to travel with each task."""

    def __init__(self, lexicon: Lexicon, trees: BoostedTrees | None, knots: tuple[np.ndarray, np.ndarray] | None):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = features(buf, offsets, self.lexicon)
        if self.trees is None:
            return np.clip(x[:, FEATURES.index("seed_density")] * 20, 0, 1)
        raw = self.trees.margin(x)
        smooth = 1 / (1 + np.exp(-raw))
        return np.clip(0.998 * np.interp(raw, *self.knots) + 0.002 * smooth, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", max_train: int = 16_000, seed: int = 7) -> ToxicityModel:
    """Learn from labelled rows where `train` (over the labels' doc_id) holds, at most `max_train` of them."""
    lean(docs.sparkSession)
    rows = training_rows(docs, labels, label, train, max_train)
    lexicon = learn_lexicon(rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(2)) == 0))
    got = feature_rows(rows, lexicon).toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(float)
    if len(got) < 20 or y.min() == y.max():
        return ToxicityModel(lexicon, None, None)
    x = np.stack(got["x"].to_numpy())
    odd = bs.mix(got["doc_id"].to_numpy(np.int64).view(np.uint64))
    # the lexicon comes from half of the rows, so that its hits mean to the trees what they mean on new rows; a quarter is kept for calibration
    part = (odd >> np.uint64(20)) % np.uint64(4)
    trees = BoostedTrees.fit(x[part != 0], y[part != 0], rounds=60, depth=3, rate=0.15, seed=seed)
    held = part == 0
    knots = isotonic_fit(trees.margin(x[held]), y[held]) if 0 < y[held].sum() < held.sum() else (np.array([-8.0, 8.0]), np.array([0.0, 1.0]))
    return ToxicityModel(lexicon, trees, knots)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """All columns of `docs`' doc_id with score and predicted (score >= threshold): (doc_id, score, predicted)."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch, "text"):
                s = model.score(buf, offsets)
                yield batch_of(schema, [batch.column(0).slice(lo, hi - lo), s, (s >= threshold).astype(np.int32)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(trimmed(run), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source, n_chars) whose score is below the threshold, in one pass over the texts."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [model.score(buf, offsets) < threshold for _, _, buf, offsets in text_slices(batch, "text")]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return rows.mapInArrow(trimmed(run), rows.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned where crc32(doc_id) mod 3 is not 1."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, crc_fold(F.col("doc_id"), 3) != 1)
    out = score(docs, model)
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
