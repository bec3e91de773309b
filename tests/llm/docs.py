"""Small documents with the odd cases that every operator must take."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, key string, bucket int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "."]) for _ in range(n))


def sample(seed=3, n=40):
    """(doc_id, text) with copies, near copies, shared passages, repeated rows, empty and null texts, a null id and a long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 160)) for _ in range(n)]
    passage = prose(rng, 90)
    rows = list(enumerate(base))
    rows += [(n, base[0]), (n + 1, base[0]), (n + 2, None), (n + 3, ""), (n + 4, " \n\t "), (n + 5, "ünï çode — 漢字 " * 30), (n + 6, prose(rng, 4)), (n + 7, "x" * 5000)]
    rows += [(n + 8, base[1] + " " + passage), (n + 9, passage + " " + base[2]), (n + 10, passage * 2)]
    for k in range(6):
        w = base[5].split()
        if len(w) > 3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((n + 11 + k, " ".join(w)))
    long_text = prose(rng, 6000)
    rows += [(n + 20, long_text), (n + 21, long_text + " end"), (3, base[3]), (None, base[4]), (n + 22, base[6].upper())]
    return rows


def frame(spark, rows=None, partitions=3):
    """With columns whose names clash with those of the operators."""
    rows = sample() if rows is None else rows
    full = [(i, t, "en", None if i is not None and i % 5 == 0 else f"src{(i or 0) % 4}", len(t or ""), 1.0, 2, "k", 3) for i, t in rows]
    return spark.createDataFrame(full, DDL).repartition(partitions)
