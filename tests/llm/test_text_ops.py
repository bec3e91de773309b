"""Toxicity, quality rules, quality model, token counts."""

import json
import math
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftloom.llm import bytescan, packing, quality_model, quality_rules, token_counts, toxicity
from siftloom.llm.common import crc_fold
from tests.llm.docs import frame, prose, sample


def labelled(spark, make, n=600):
    import random

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.3)
        rows.append((i, make(rng, y)))
        labels.append((i, y))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, y int")


def check_scores(docs, labels, scored, fold):
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(got[r["doc_id"]]["predicted"], r["y"]) for r in labels.where(fold).collect()]
    assert len(held) > 50
    return np.mean([p == y for p, y in held])


def test_toxicity_learns_words(spark):
    docs, labels = labelled(spark, lambda rng, y: prose(rng, 60) + (" you zorgish bozoling, zorgish " + prose(rng, 3) + " bozoling" if y else ""))
    train = crc_fold(F.col("doc_id"), 3) != 1
    model = toxicity.fit(docs, labels, train, label="y")
    assert check_scores(docs, labels, toxicity.score(docs, model), ~train) > 0.97
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert left.count() < docs.count()


def test_quality_learns_junk(spark):
    docs, labels = labelled(spark, lambda rng, y: prose(rng, 60) if y else " ".join(w + "###" for w in prose(rng, 40).split()))
    train = crc_fold(F.col("doc_id"), 5) != 0
    model = quality_model.fit(docs, labels, train, label="y")
    assert check_scores(docs, labels, quality_model.score(docs, model, 0.5), ~train) > 0.97


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_scores_of_odd_rows(spark, module):
    docs, none = frame(spark), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = module.fit(docs, none, F.lit(True))
    got = module.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert module.score(docs.limit(0), model).count() == 0


def rule_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark):
    extra = "one two three four five six seven eight nine ten "
    rows = sample() + [(900, extra * 3), (901, "a b c d e f g h " * 4), (902, "line\nline\n \nline x\n#*$ %&|<>"), (903, extra + "x " + extra)]
    docs = frame(spark, rows)
    got = quality_rules.apply_rules(docs, sample_one_in=1).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        want = rule_counts(r["text"])
        assert tuple(r)[2:7] == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_rule_order_does_not_change_verdicts(spark):
    docs = frame(spark)
    found = quality_rules.rules()
    a = quality_rules.apply_rules(docs, found).select("doc_id", "kept").collect()
    b = quality_rules.apply_rules(docs, found[::-1]).select("doc_id", "kept").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def segment(word, scores, longest):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        options = []
        for n in range(1, min(i, longest) + 1):
            s = scores.get(word[i - n : i])
            if s is not None:
                options.append((best[i - n][0] + s, best[i - n][1] - 1))
        best.append(max(options))
    return best[-1][0], -best[-1][1]


def test_token_counts(spark):
    path = packing.default_tokenizer()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"] for t in spec["added_tokens"]}
    alphabet = packing.byte_alphabet()
    scores = {bytes(alphabet[c] for c in t): -math.log(i + 2) for t, i in spec["model"]["vocab"].items() if t not in added}
    longest = max(map(len, scores))
    rows = [r for r in sample() if r[0] is None or r[0] < 60]
    for most in (1_000_000, 10):
        got = token_counts.token_counts(frame(spark, rows), path, most).collect()
        assert len(got) == len(rows)
        texts = dict(rows)
        for r in got:
            words = re.findall(rb"[^\x20\x09-\x0D]+", (texts[r["doc_id"]] or "").encode())
            want = [segment(b" " + w, scores, longest) for w in words]
            assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(n for _, n in want))
            assert abs(r["score"] - sum(s for s, _ in want)) < 1e-6


def test_long_words_take_linear_time():
    pieces = token_counts.vocabulary(packing.default_tokenizer())
    for word in (b" " + b"ab" * 60, b" " + "漢字かな".encode() * 12, b" x" + b"-=" * 50):
        buf = np.frombuffer(word, np.uint8)
        by_trie = token_counts.trie_counts(buf, np.array([0]), np.array([64]), pieces)
        assert tuple(x[0] for x in by_trie) == pieces.forward(word[:64])
    began = time.time()
    tokens, score = pieces.forward(b" " + b"QmFzZTY0IGlzIG5vdCBwcm9zZQ" * 40_000)
    assert tokens > 100_000 and score < 0 and time.time() - began < 20


def test_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"some words here, some words there", np.uint8)
    h = bytescan.Hasher(data)
    assert h.of(np.array([0]), np.array([10])) == h.of(np.array([17]), np.array([27]))
    assert zlib.crc32(b"5") % 3 in (0, 1, 2)
