"""Near duplicates and repeated passages against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from siftloom.llm import bytescan, jaccard, suffixes
from siftloom.llm.components import components
from tests.llm.docs import frame, prose, sample


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def family(n, seed=9):
    """Texts that differ from one another in a few of many places."""
    import random

    rng = random.Random(seed)
    base = prose(rng, 120).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(4)}"
        out.append((1000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("small", [32, 3])
def test_near_duplicates(spark, small):
    rows = sample() + family(30)
    got = jaccard.near_duplicates(frame(spark, rows), small=small).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, linked(rows)))


def test_only_sets_of_pairs_that_pass_travel_whole(spark, monkeypatch):
    """Texts that share two of three paragraphs are candidates in plenty; few of them, the near copies, need their whole sets compared."""
    import random

    rng = random.Random(4)
    paragraphs = [" ".join(f"p{k}w{rng.randrange(10**6)}" for _ in range(60)) for k in range(12)]
    rows = [(k, " ".join(rng.sample(paragraphs, 3))) for k in range(100)]
    rows += [(1000 + k, rows[k][1].replace(" ", " changed ", 1)) for k in range(4)]
    asked, sets_of = [], jaccard.sets_of

    def seen(docs, wanted, *rest):
        asked.append((jaccard.signatures in rest, wanted.count()))
        return sets_of(docs, wanted, *rest)

    monkeypatch.setattr(jaccard, "sets_of", seen)
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, linked(rows)))
    signed, whole = (sum(n for s, n in asked if s is kind) for kind in (True, False))
    assert 0 < whole < signed / 2


def test_long_near_copies(spark):
    """Two texts that share more than 65,536 prefix tokens are still linked."""
    words = [f"w{i}" for i in range(300_100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:150_000], "changed", *words[150_001:]])), (3, "another text of a few words")]
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(linked(rows))


def test_keep_one(spark):
    rows = sample()
    docs = frame(spark, rows)
    left = jaccard.keep_one(docs)
    want = {d for d, _, c in linked(rows) if d is not None and d == c}
    assert {r["doc_id"] for r in left.collect()} == want and left.columns == docs.columns


def test_keep_one_of_repeated_rows_and_null_ids(spark):
    """One row of each component passes stage 2 and keeps its text in stage 3, whatever its id and however often the row occurs."""
    import random

    rng = random.Random(5)
    text = [prose(rng, 120) for _ in range(6)]
    rows = [(1, text[0]), (1, text[0]), (2, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (None, text[2] + " end"), (None, text[3]), (3, text[3]), (4, text[4]), (4, text[5]), (0, text[5]), (None, " "), (None, None), (9, ""), (9, "")]
    docs = frame(spark, rows)
    left = jaccard.keep_one(docs)
    assert left.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    either = [k for k in ((None, text[2]), (None, text[2] + " end")) if got[k]]
    assert len(either) == 1
    want = Counter([(1, text[0]), (None, text[1]), either[0], (3, text[3]), (4, text[4]), (0, text[5]), (None, " "), (None, None), (9, ""), (9, "")])
    assert got == want
    after = suffixes.cleaned(left.select("doc_id", "text", "lang", "source", "n_chars"))
    assert Counter((r["doc_id"], r["text"]) for r in after.collect()) == want


def test_no_rows(spark):
    assert jaccard.near_duplicates(frame(spark).limit(0)).count() == 0
    assert suffixes.digest(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("local_edges", [0, 1000])
def test_components(spark, local_edges):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (40, 40), (30, 32)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), local_edges=local_edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30}


def covered(size, spans):
    mark = np.zeros(size + 1, int)
    for a, b in spans:
        mark[a] += 1
        mark[b] -= 1
    return np.cumsum(mark)[:-1] > 0


def repeats(rows, length, words):
    """For each row: bytes, those of strings of `length` that start elsewhere too, and those of passages of `words` words that other texts have."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    found = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    passages = [[(w[k][0], w[k + words - 1][1], tuple(b[x:y] for x, y in w[k : k + words])) for k in range(len(w) - words + 1)] for b, w in zip(data, found, strict=True)]
    owners = Counter(x for own in passages for x in {x for _, _, x in own})
    for b, own in zip(data, passages, strict=True):
        strings = covered(len(b), [(p, p + length) for p in range(len(b) - length + 1) if seen[b[p : p + length]] > 1])
        yield b, strings, strings | covered(len(b), [(x, y) for x, y, key in own if owners[key] > 1])


def stripped(rows, length, words=51):
    out = []
    for (d, _), (b, gone, either) in zip(rows, repeats(rows, length, words), strict=True):
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), int(either.sum())))
    return out


@pytest.mark.parametrize(("range_bytes", "sampled"), [(1 << 20, 200_000), (3000, 200_000), (1000, 40)])
def test_repeats(spark, range_bytes, sampled):
    words = "ab cde f ghij kl mno pqr stuv w xyz".split()
    short = " ".join(words[(k * 7) % 10] + str(k) for k in range(55))
    assert len(short) < 400
    rows = sample() + [(500, "ab" * 900), (501, "q" * 401), (502, "é" * 300 + " " + "z" * 100)]
    rows += [(510, "one " + short + " two"), (511, short.replace(" ", "\n")), (512, short), (513, short), (514, " ".join(short.split()[:50])), (515, "so so " * 60)]
    got = suffixes.digest(frame(spark, rows), range_bytes=range_bytes, sampled=sampled).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, stripped(rows, 400)))


def test_cleaned_texts(spark):
    rows = sample()
    docs = frame(spark, rows)
    got = suffixes.cleaned(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"] and got.count() == len(rows)
    want = Counter((d, bytes(np.frombuffer(b, np.uint8)[~either]).decode("utf-8", "ignore")) for (d, _), (b, _, either) in zip(rows, repeats(rows, 400, 51), strict=True))
    assert Counter((r["doc_id"], r["text"] or "") for r in got.collect()) == want


@given(st.lists(st.integers(0, 400), min_size=1, max_size=300), st.lists(st.integers(0, 400), max_size=60), st.integers(0, 60))
def test_filters_pass_all_similar_sets(first, more, gone):
    sets = [np.unique(bytescan.mix(np.array(x, np.uint64))) for x in (first, (first + more)[gone % len(first) :])]
    sets = [x for x in sets if len(x)]
    if len(sets) < 2:
        return
    size = np.array([len(x) for x in sets])
    signs = jaccard.signatures(np.repeat([0, 1], size), np.concatenate(sets), size, 75)
    common = len(np.intersect1d(*sets))
    similar = 100 * common >= 75 * (size.sum() - common)
    assert jaccard.reaches(sets[0].tobytes(), sets[1].tobytes(), *size.tolist(), 75) == similar
    if similar:
        assert jaccard.passes_filters(*signs, *size.tolist(), 75)


def test_filters_drop_strangers():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(2)]
    size = np.array([len(x) for x in sets])
    signs = jaccard.signatures(np.repeat([0, 1], size), np.concatenate(sets), size, 75)
    assert not jaccard.passes_filters(*signs, *size.tolist(), 75)
    # near the threshold: 60 % of the union in common
    sets[1] = np.unique(np.concatenate([sets[0][:375], sets[1][:125]]))
    size = np.array([len(x) for x in sets])
    signs = jaccard.signatures(np.repeat([0, 1], size), np.concatenate(sets), size, 75)
    assert not jaccard.passes_filters(*signs, *size.tolist(), 75)
