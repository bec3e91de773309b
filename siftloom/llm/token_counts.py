"""Token counts under a unigram model, by dynamic programming over a trie of distinct words.

The pre-tokens of a text are its words `[^\\x20\\x09-\\x0D]+`, each with a space before it. A word's segmentation is the one with the greatest
sum of piece scores (with equal sums, the one of fewer pieces). The distinct words of a task's texts are put into a trie, level by level; every
node, that is every shared prefix, gets its forward score once, from its ancestors at each piece's length; nodes where a word ends
store its count, which all texts of the task then look up. The store is bounded (`most` words) and starts anew beyond that.

The pieces are those of a byte-level vocabulary file, which covers every byte, so each word has a segmentation. The file holds ranks and
no probabilities; a piece's score is -ln(rank + 2), as Zipf's law has it.

Defined results: null, empty and wordless texts have no tokens; every row is counted on its own, with its id, null or not; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm import bytescan as bs
from siftloom.llm.common import batch_of, text_slices, trimmed
from siftloom.llm.packing import byte_alphabet, default_tokenizer


SHORT, TAIL = 12, 8
#: Words of more bytes share no prefix worth a trie level; each gets one forward pass over an automaton of the pieces.
LONG = 64


class Pieces:
    """Vocabulary by hash: sorted hashes with scores, and the lengths that occur."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.pieces, self.piece_scores, self.machine = pieces, np.asarray(scores, float).tolist(), None
        offsets = np.cumsum([0] + [len(p) for p in pieces]).astype(np.int64)
        keys = bs.Hasher(np.frombuffer(b"".join(pieces), np.uint8)).of(offsets[:-1], offsets[1:])
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], np.asarray(scores, float)[order]
        self.longest = int(np.diff(offsets).max())
        # few pieces are long: where a node's last bytes end none of them, their lengths need no look-up
        tails = offsets[1:][np.diff(offsets) > SHORT]
        self.tails = np.unique(bs.Hasher(np.frombuffer(b"".join(pieces), np.uint8)).of(tails - TAIL, tails)) if len(tails) else np.zeros(0, np.uint64)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Scores of keys; -inf where there is no such piece."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.scores[at], -np.inf)


    def automaton(self):
        """Finds all pieces of a byte string, read as Latin-1, in one pass; built when the first long word comes."""
        if self.machine is None:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for piece, score in zip(self.pieces, self.piece_scores, strict=True):
                if piece:
                    self.machine.add_word(piece.decode("latin-1"), (len(piece), score))
            self.machine.make_automaton()
        return self.machine

    def forward(self, word: bytes) -> tuple[int, float]:
        """(pieces, score) of the best segmentation, in time linear in the word's length."""
        best, count = [-math.inf] * (len(word) + 1), [0] * (len(word) + 1)
        best[0] = 0.0
        for end, (size, own) in self.automaton().iter(word.decode("latin-1")):
            score, fewer = own + best[end + 1 - size], count[end + 1 - size] + 1
            if score > best[end + 1] or (score == best[end + 1] and fewer < count[end + 1]):
                best[end + 1], count[end + 1] = score, fewer
        return count[-1], best[-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"] for t in spec.get("added_tokens", [])}
    alphabet = byte_alphabet()
    items = [(bytes(alphabet[c] for c in token), i) for token, i in spec["model"]["vocab"].items() if token not in added]
    return Pieces([p for p, _ in items], -np.log(np.array([i for _, i in items]) + 2.0))


def trie_counts(buf: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, score) of the best segmentation of each distinct byte string buf[start:end]."""
    hasher = bs.Hasher(buf)
    size = end - start
    tokens, total = np.zeros(len(start), np.int64), np.zeros(len(start))
    for i in np.flatnonzero(size > LONG).tolist():
        tokens[i], total[i] = pieces.forward(buf[start[i] : end[i]].tobytes())
    order = np.argsort(size, kind="stable")
    order = order[size[order] <= LONG]
    longest = pieces.longest
    # per level: forward scores, counts, and each node's parent on the level before; the last `longest` levels are enough
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    node = np.zeros(len(start), np.int64)  # of each word on the last level
    depth = 0
    active = order
    while len(active):
        depth += 1
        prefix = hasher.of(start[active], start[active] + depth)
        _, first, inverse = np.unique(prefix, return_index=True, return_inverse=True)
        parent, head = node[active[first]], start[active[first]] + depth
        best, count = np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
        above, at = np.arange(len(first)), np.arange(len(first))
        for back in range(1, min(depth, longest) + 1):
            if back == SHORT + 1:
                long = np.isin(hasher.of(head - TAIL, head), pieces.tails)
                at, above = at[long], above[long]
                if not len(at):
                    break
            above = parent[above] if back == 1 else levels[-back + 1][2][above]
            score = pieces.score(hasher.of(head[at] - back, head[at])) + levels[-back][0][above]
            fewer = levels[-back][1][above] + 1
            better = (score > best[at]) | ((score == best[at]) & (fewer < count[at]))
            best[at], count[at] = np.where(better, score, best[at]), np.where(better, fewer, count[at])
        node[active] = inverse.ravel()
        done = size[active] == depth
        ended = active[done]
        tokens[ended], total[ended] = count[node[ended]], best[node[ended]]
        active = active[~done]
        levels.append((best, count, parent))
        if len(levels) > longest + 1:
            levels[-longest - 2] = None
    return tokens, total


class WordStore:
    """Counts of the words seen so far, by hash; at most `most` words."""

    def __init__(self, pieces: Pieces, most: int = 1_000_000):
        self.pieces, self.most = pieces, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.tokens, self.total = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)

    def count(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, tokens, score) of each text."""
        n = len(offsets) - 1
        start, end = bs.words(buf, offsets)
        doc = bs.owner(offsets, start)
        key, first, inverse = np.unique(bs.Hasher(buf).of(start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == key[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            a, b = start[first[fresh]], end[first[fresh]]
            # the fresh words one behind the other, a space before each
            size = b - a + 1
            begin = np.cumsum(size) - size
            source = np.repeat(a - 1 - begin, size) + np.arange(size.sum())
            text = buf[np.maximum(source, 0)]
            text[begin] = 0x20
            tokens, total = trie_counts(text, begin, begin + size, self.pieces)
            if len(self.keys) + len(fresh) > self.most and known.any():
                self.clear()
                return self.count(buf, offsets)  # with an empty store, all words of these texts are fresh
            order = np.argsort(np.concatenate([self.keys, key[fresh]]), kind="stable")
            self.keys, self.tokens, self.total = (np.concatenate(x)[order] for x in ((self.keys, key[fresh]), (self.tokens, tokens), (self.total, total)))
        at = np.searchsorted(self.keys, key)
        by = lambda v: np.bincount(doc, weights=v[at][inverse.ravel()], minlength=n)
        return np.bincount(doc, minlength=n), by(self.tokens).astype(np.int64), by(self.total)


def token_counts(docs: DataFrame, path: str, most: int = 1_000_000) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score) of every row; score is the sum of the words' log scores."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = WordStore(vocabulary(path), most)
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch, "text", 1 << 20):
                yield batch_of(schema, [batch.column(0).slice(lo, hi - lo), *store.count(buf, offsets)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, n_pretokens long, n_tokens long, score double")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()).select("doc_id", "n_pretokens", "n_tokens", F.round("score", 3).alias("score"))
