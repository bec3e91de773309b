"""Mixing, packing, archives, nearest neighbours and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftloom.llm import mixing, neighbours, packing, warc
from tests.llm.docs import frame, prose, sample


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing(spark):
    rows = sample(n=80)
    docs = frame(spark, rows)
    got = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    again = mixing.mix(docs.repartition(5).select("doc_id", "text", "source")).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)
    assert len(got) == len(rows)
    per = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        assert r["size"] == size(r["text"]) and 0 <= r["taken"] <= 2 * r["size"]
        p = per[r["source"]]
        p[0] += r["size"]
        p[1] += r["taken"]
        p[2], p[3] = r["target"], max(p[3], r["size"])
        assert r["source_size"] is not None
    order = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, free = 1.5 * sum(p[0] for p in per.values()), set(order)
    while free:  # share by weight, cap, share the rest again
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 2 * per[s][0]}
        for s in over or free:
            target[s] = 2.0 * per[s][0] if over else weight[s] * unit
            left -= target[s] if over else 0
        if not over:
            break
        free -= over
    for s, (total, taken, t, most) in per.items():
        assert abs(t - target[s]) < 1e-6 and abs(taken - t) <= most / 2 + 1e-6
    assert mixing.mix(docs.limit(0).select("doc_id", "text", "source")).count() == 0
    copies = mixing.expand(mixing.mix(docs.select("doc_id", "text", "source")), ["doc_id", "text"])
    assert sum(size(r["text"]) for r in copies.collect()) == sum(r["taken"] for r in got)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_mixing_with_ties_and_clashes(spark, monkeypatch, broadcast):
    """Rows of one id tie by key; extra columns with names of the steps pass through; the plan broadcast or not."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = [(7, "a b c", "s"), (7, "d e f", "s"), (7, "g h", "s"), (8, "i", "t")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("key", "bucket", "epochs", "more", "sum", "edge", "tie", "Size"):
        docs = docs.withColumn(name, F.lit(name))
    runs = [mixing.mix(docs.repartition(n)) for n in (1, 5, 3)]
    assert runs[0].columns == ["doc_id", "text", "source", "key", "bucket", "epochs", "more", "sum", "edge", "tie", "size", "source_size", "target", "taken"]
    results = [Counter(tuple(r) for r in run.collect()) for run in runs]
    assert results[0] == results[1] == results[2] and len({r[3:10] for r in results[0]}) == 1


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    rows = sample() + [(700, "two  spaces\n\n and <|endoftext|> inside   "), (701, "it's we'll  x\n y"), (702, " lead"), (703, "trail \n")]
    got = packing.pack(frame(spark, rows), path, block_items=20).collect()
    full = Tokenizer.from_file(path)
    want = Counter()
    for d, t in rows:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 2048
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 2048) + 2
    assert packing.pack(frame(spark).limit(0), path).count() == 0


def test_ids_of_mixed_white_space():
    """A space inside a run of other white space is not a place to split at."""
    import random

    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    ours, full = packing.Tokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = ["a \u00a0 \u00a0 b", "price: \u00a0 \u00a0 \u00a0 5", "\u00a0 \u00a0", "end \u00a0 "]
    texts += ["".join(rng.choice([" ", " ", "\u00a0", "\n", "\t", "\u2003", "\u0085", "a", "7", "it's", "-", "é"]) for _ in range(rng.randrange(1, 14))) for _ in range(5000)]
    for t in texts:
        assert np.frombuffer(ours.ids(t), "<u4").tolist() == full.encode(t, add_special_tokens=False).ids, ascii(t)


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 700, 300)
    people = packing.evolve(lengths, 1000, [], rng, 6, 0)
    child = packing.crossover(people[0], people[-1], rng)
    assert sorted(i for b in child.bins for i in b) == list(range(300))
    assert all(sum(lengths[b]) + r == 1000 for b, r in zip(child.bins, child.room))
    best = packing.evolve(lengths, 1000, [p.labels() for p in people], rng, 6, 6)[0]
    assert best.fitness() >= people[0].fitness()


def test_evolution_betters_best_fit():
    rng = np.random.default_rng(4)
    won = 0
    for seed in range(6):
        lengths = np.random.default_rng(seed).integers(500, 1100, 120)
        best_fit = packing.evolve(lengths, 2048, [], rng, 1, 0)[0]
        best = packing.evolve(lengths, 2048, [], rng, 4, 6)[0]
        assert best.fitness() >= best_fit.fitness()
        won += len(best.bins) < len(best_fit.bins)
    assert won >= 2


def test_archives(spark, tmp_path):
    rows = [(i, f"http://h/{i}", None if i % 7 == 0 else "x" * (i % 5) + "<html>é") for i in range(120)] + [(None, None, "zz"), (None, "u", "zz"), (3, "again", "xxx<html>é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = f"file://{tmp_path}/archive"
    got = defaultdict(list)
    for r in warc.archive(pages, path).collect():
        got[r["page_id"], r["url"]].append(r)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, u, h in rows:
        r = got[i, u or "about:blank"].pop()
        again = i is not None and first[h or ""] < i
        data = (h or "").encode()
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[h or ""]) if again else ("response", None))
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.digest(data))
    assert not any(got.values())
    for f in (tmp_path / "archive").glob("part-*"):
        content = f.read_bytes()
        if content:
            assert int.from_bytes(content[:4], "little") == warc.DICTIONARY_FRAME
    assert warc.archive(pages.limit(0), path + "2").count() == 0


@pytest.mark.parametrize("share", [2, 10**9])
def test_revisits_go_by_payload(spark, tmp_path, monkeypatch, share):
    """A page with several payloads is a revisit by those that smaller pages have only; payloads hot and not."""
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    rows = [(i, "u", "hot") for i in range(1, 80)] + [(i, "u", f"own{i // 2}") for i in range(100, 140)] + [(5, "v", "other"), (7, "v", "own50"), (120, "v", "hot"), (120, "w", "own50")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(tuple(r) for r in warc.archive(pages, f"file://{tmp_path}/a").select("page_id", "payload_digest", "refers_to").collect())
    first = {}
    for i, _, h in rows:
        first[h] = min(i, first.get(h, i))
    assert got == Counter((i, warc.digest(h.encode()), first[h] if first[h] < i else None) for i, _, h in rows)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16))
    x[100:160] = x[100]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0] * 15 + [None]), (2400, [1.0] * 3), (None, x[0].tolist())]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.search(table, F.col("vec_id") % 100 == 0, hashing=neighbours.Hashing(16)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i, _ in rows if i % 100 == 0}
    exact = x.astype(np.float32).astype(float)
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        order = np.lexsort((np.arange(len(d)), d))[:10]
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(order.tolist()))
    assert hits >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in got[100]] == list(range(101, 111))
    assert neighbours.search(table.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(0, x[0].tolist()), (7, x[7].tolist()), (9, rng.standard_normal(8).astype(np.float32).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.search(table, F.col("vec_id") % 100 == 0).collect()))
    each = sorted({(i, tuple(v)) for i, v in rows})
    far = sorted((float(np.sqrt(((np.array(v, float) - x[0].astype(float)) ** 2).sum())), i) for i, v in each if i)[:10]
    assert [(r, v) for _, r, v, _ in got] == [(k + 1, i) for k, (_, i) in enumerate(far)]
    assert all(abs(s - d) < 1e-12 for (_, _, _, s), (d, _) in zip(got, far, strict=True))


def test_dense_buckets_are_salted(spark):
    """One bucket with most of the vectors, dealt over parts or not: the same neighbours, and no part above its bound."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((300, 8)), 3 + 0.01 * rng.standard_normal((700, 8))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole, salted = (sorted(map(tuple, neighbours.search(table, F.col("vec_id") % 50 == 0, range_bytes=b).collect())) for b in (24 << 20, 8 << 10))
    assert whole == salted and len(whole) == 200
    hashing = neighbours.Hashing(8, scale=neighbours.spread(neighbours.usable(table, 8).select("vec_id", "v")))
    rows = table.select(F.col("vec_id").alias("name"), F.col("vec_id").alias("tie"), F.col("embedding").alias("v"))
    plan = neighbours.deal(rows, hashing, 16, 200)
    assert len(plan.dense)
    sizes = [sum(len(r["codes"]) // 8 for r in g) for g in _by_part(neighbours.dealt(rows, hashing, plan, False).collect())]
    assert sum(sizes) == 4 * len(x) and max(sizes) < 300


def _by_part(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["part"]].append(r)
    return out.values()


def plain_pipeline(spark, rows, labels, folder):
    """The five stages in plain Python, but for the model's scores: (kept ids and texts by stage)."""
    from siftloom.llm import toxicity
    from tests.llm.test_dedup import linked, repeats

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), F.lit(True))
    one = lambda t: float(model.score(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0])
    clean = [(d, t) for d, t in rows if one(t) < 0.7]
    groups = [(n, c if d is not None else None) for (d, _), (_, n, c) in zip(clean, linked(clean), strict=True)]
    left, seen = [], set()
    for (d, t), (n, c) in sorted(zip(clean, groups, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1] or "")):
        if n == 0 or c not in seen:
            left.append((d, t))
            seen |= {c} if n else set()
    kept = [(d, bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")) for (d, _), (b, _, gone) in zip(left, repeats(left, 400, 51), strict=True)]
    return clean, left, kept


def test_pipeline(spark, tmp_path):
    """Every stage's rows against plain Python, with labels to learn from."""
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(8)
    rows = [(d, t) for d, t in sample() if d is not None and d != 3]
    rows += [(1000 + k, prose(rng, 40)) for k in range(60)]
    rows += [(2000 + k, " ".join(rng.choice([prose(rng, 3), "you vile grubnik!!", "stupid zorfle YOU"]) for _ in range(12))) for k in range(40)]
    labels = [(d, 1, int(d >= 2000)) for d, _ in rows if d % 3 and d >= 1000]
    folder = str(tmp_path / "sf")
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    want = plain_pipeline(spark, rows, labels, folder)
    assert 20 < len(rows) - len(want[0]) <= 40 and len(want[1]) < len(want[0]) and sum(len(t) for _, t in want[2]) < sum(len(t or "") for _, t in want[1])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS, name
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        if k < 3:
            assert Counter((r["doc_id"], r["text"] or "") for r in out.collect()) == Counter((d, t or "") for d, t in want[k]), name
        if k == 3:
            taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mix(docs).collect()}
            assert Counter(r["doc_id"] for r in out.collect()) == Counter({d: n for d, n in taken.items() if n})
        docs, before = out, docs
    full = Tokenizer.from_file(packing.default_tokenizer())
    tokens = Counter()
    for r in before.collect():
        tokens[r["doc_id"]] += len(full.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in docs.collect():
        got[r["doc_id"]] += r["length"]
    assert got == tokens and docs.agg(F.max("length")).first()[0] <= 2048
    again = corpus_pipeline.run(spark, folder)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[c] for c in key) for r in again.collect()) == Counter(tuple(r[c] for c in key) for r in docs.collect())
