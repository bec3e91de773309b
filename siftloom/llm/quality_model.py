"""Quality scores: a generalised additive model with pairwise interactions.

Per-feature lookup tables are learned by cyclic boosting: in each round every feature in turn gets a shallow tree over
its own bins, fitted to the current residual and added at a small rate. The strongest pairs of features, found on the
residual of the main effects, then get two-dimensional tables the same way. A score is a sum of table entries, read by
vectorised additions over binned columns. The model is trained on the driver from at most `max_train` labelled rows
(those with the smallest hash of the id); all rows are scored.

Defined results: null and empty texts have zero features and are scored like others; null doc_ids too; labels other than
0 and 1 are ignored; without labels of both classes the score is 0.5. Repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm import bytescan as bs
from siftloom.llm.common import batch_of, crc_fold, text_slices, trimmed
from siftloom.llm.toxicity import training_rows
from siftloom.llm.trees import bin_edges, to_bins

FEATURES = ("log_words", "log_bytes", "mean_word", "caps_rate", "digit_rate", "symbol_rate", "bang_rate", "pipe_words", "stop_rate", "punct_rate", "same_as_last", "distinct_rate", "dup_lines", "line_words", "symbol_words", "caps_words", "non_ascii", "long_words")


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    start, end = bs.words(buf, offsets)
    doc = bs.owner(offsets, start)
    key = bs.Hasher(buf, fold=True).of(start, end)
    by = lambda index, w=None: np.bincount(index, weights=w, minlength=n).astype(float)
    count = by(doc)
    per_word, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1).astype(float)
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in "#*$%&|<>"]] = True
    symbols = symbol[buf]
    cum_symbols = np.concatenate([[0], np.cumsum(symbols)])
    upper = bs.UPPER[buf]
    cum_upper = np.concatenate([[0], np.cumsum(upper)])
    length = end - start
    same = np.zeros(len(start), bool)
    if len(start) > 1:
        same[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((key, doc))
    first = np.ones(len(order), bool)
    if len(order) > 1:
        first[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    line_start, line_end = bs.runs(buf != 0x0A, offsets)
    line_doc = bs.owner(offsets, line_start)
    line_key = bs.Hasher(buf).of(line_start, line_end)
    line_order = np.lexsort((line_key, line_doc))
    repeated = np.zeros(len(line_order), bool)
    if len(line_order) > 1:
        a, b = line_order[1:], line_order[:-1]
        repeated[1:] = (line_key[a] == line_key[b]) & (line_doc[a] == line_doc[b])
    lines = np.maximum(by(line_doc), 1)
    plain = bs.LETTER[buf] | bs.SPACE[buf] | bs.DIGIT[buf]
    out = [
        np.log1p(count), np.log1p(np.diff(offsets)), by(doc, length.astype(float)) / per_word,
        bs.per_text(upper, offsets) / size, bs.per_text(bs.DIGIT[buf], offsets) / size, bs.per_text(symbols, offsets) / size,
        bs.per_text(buf == 0x21, offsets) / size, by(doc, (length == 1) & (buf[start] == 0x7C)) / per_word,
        by(doc, length <= 3) / per_word, bs.per_text(~plain, offsets) / size, by(doc, same) / per_word,
        by(doc[order], first) / per_word, by(line_doc[line_order], repeated) / lines, count / lines,
        by(doc, cum_symbols[end] > cum_symbols[start]) / per_word, by(doc, (cum_upper[end] - cum_upper[start]) * 2 > length) / per_word,
        bs.per_text(buf >= 0x80, offsets) / size, by(doc, length > 20) / per_word,
    ]
    return np.stack(out, axis=1)


def shallow_tree(g: np.ndarray, h: np.ndarray, splits: int, l2: float) -> np.ndarray:
    """Newton values per bin of a tree that cuts the bins' range up to `splits` times, best gain first."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    spans = [(0, len(g))]
    for _ in range(splits):
        best = None
        for a, b in spans:
            if b - a < 2:
                continue
            c = np.arange(a + 1, b)
            gain = gain_of(a, c) + gain_of(c, b) - gain_of(a, b)
            ok = (ch[c] - ch[a] > 0.5) & (ch[b] - ch[c] > 0.5)
            if ok.any() and (best is None or gain[ok].max() > best[0]):
                best = (gain[ok].max(), a, int(c[ok][gain[ok].argmax()]), b)
        if best is None or best[0] <= 1e-9:
            break
        _, a, c, b = best
        spans.remove((a, b))
        spans += [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


class AdditiveModel:
    """Lookup tables for single features and for pairs."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int]], grids: list[np.ndarray]):
        self.base, self.edges, self.tables, self.coarse, self.pairs, self.grids = base, edges, tables, coarse, pairs, grids

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, rate: float = 0.12, splits: int = 3, n_pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40, l2: float = 4.0) -> AdditiveModel:
        edges = bin_edges(x, bins)
        b = to_bins(x, edges)
        d = x.shape[1]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(p / (1 - p)))
        f = np.full(len(y), base)
        tables = [np.zeros(len(e) + 1) for e in edges]
        for _ in range(rounds):
            for j in range(d):
                q = 1 / (1 + np.exp(-f))
                step = rate * shallow_tree(np.bincount(b[:, j], y - q, len(tables[j])), np.bincount(b[:, j], q * (1 - q), len(tables[j])), splits, l2)
                tables[j] += step
                f += step[b[:, j]]
        coarse = bin_edges(x, pair_bins)
        c = to_bins(x, coarse)
        q = 1 / (1 + np.exp(-f))
        strength = []
        for i in range(d):
            for j in range(i + 1, d):
                cell = c[:, i] * pair_bins + c[:, j]
                g, h = np.bincount(cell, y - q, pair_bins**2), np.bincount(cell, q * (1 - q), pair_bins**2)
                strength.append((float((g**2 / (h + l2)).sum()), i, j))
        pairs = [(i, j) for _, i, j in sorted(strength, key=lambda s: (-s[0], s[1], s[2]))[:n_pairs]]
        grids = [np.zeros(pair_bins**2) for _ in pairs]
        for _ in range(pair_rounds):
            for k, (i, j) in enumerate(pairs):
                q = 1 / (1 + np.exp(-f))
                cell = c[:, i] * pair_bins + c[:, j]
                g = np.bincount(cell, y - q, pair_bins**2).reshape(pair_bins, pair_bins)
                h = np.bincount(cell, q * (1 - q), pair_bins**2).reshape(pair_bins, pair_bins)
                step = rate * cls._four_cells(g, h, l2)
                grids[k] += step
                f += step[cell]
        return cls(base, edges, tables, coarse, pairs, grids)

    @staticmethod
    def _four_cells(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
        """Newton values of the depth-2 tree that cuts each axis once at the best place, as a flat grid."""
        cg, ch = np.zeros((len(g) + 1,) * 2), np.zeros((len(g) + 1,) * 2)
        cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        n, best, out = len(g), -1.0, np.zeros_like(g)
        for a in range(1, n):
            for c in range(1, n):
                value, cells = 0.0, []
                for r in ((0, a), (a, n)):
                    for s in ((0, c), (c, n)):
                        gg = cg[r[1], s[1]] - cg[r[0], s[1]] - cg[r[1], s[0]] + cg[r[0], s[0]]
                        hh = ch[r[1], s[1]] - ch[r[0], s[1]] - ch[r[1], s[0]] + ch[r[0], s[0]]
                        value += gg * gg / (hh + l2)
                        cells.append((r, s, gg / (hh + l2)))
                if value > best:
                    best = value
                    for r, s, v in cells:
                        out[r[0] : r[1], s[0] : s[1]] = v
        return out.ravel()

    def probability(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, b in enumerate(to_bins(x, self.edges).T):
            f += self.tables[j][b]
        c = to_bins(x, self.coarse)
        width = int(np.sqrt(len(self.grids[0]))) if self.grids else 0
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            f += grid[c[:, i] * width + c[:, j]]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", max_train: int = 16_000) -> AdditiveModel | None:
    """Learn from labelled rows where `train` (over the labels' doc_id) holds, at most `max_train` of them."""
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch, "text"):
                x = features(buf, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield batch_of(schema, [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), flat])

    rows = training_rows(docs, labels, label, train, max_train).select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int"))
    got = rows.mapInArrow(trimmed(scan), "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(float)
    if len(got) < 20 or y.min() == y.max():
        return None
    return AdditiveModel.fit(np.stack(got["x"].to_numpy()), y)


def score(docs: DataFrame, model: AdditiveModel | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch, "text"):
                s = np.full(hi - lo, 0.5) if model is None else model.probability(features(buf, offsets))
                yield batch_of(schema, [batch.column(0).slice(lo, hi - lo), s, (s >= threshold).astype(np.int32)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(trimmed(run), "doc_id long, score double, predicted int")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned where crc32(doc_id) mod 5 is not 0."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, crc_fold(F.col("doc_id"), 5) != 0)
    return score(docs, model).select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
