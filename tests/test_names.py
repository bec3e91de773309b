import numpy as np
from pyspark.sql import functions as F

from siftloom.functions import text
from siftloom.operators import candidates, features, names

NAMES = [
    ("MIT", "mit", "M", True, "MIT"),
    ("Massachusetts Institute of Technology", "massachusetts institute of technology", "MIOT", False, "MASSACHUSETTSINSTITUTEOFTECHNOLOGY"),
    ("VPI&SU", "vpi and su", "VAS", False, "VPISU"),
    ("A & B Co.", "a and b co", "AABC", False, "ABCO"),
    ("Maryland", "maryland", "M", True, "MARYL"),
    ("Alpha Nu Delta", "alpha nu delta", "", False, "ALPHANUDELTA"),
    ("UC-Davis", "uc davis", "UD", True, "UCDAVIS"),
    ("Princeton", "princeton", "P", True, "PRINCETON"),
    ("  MIT", "mit", "M", False, "MIT"),
    ("", "", "", False, ""),
    ("!!!", "", "", False, ""),
    ("AT+T", "at and t", "AAT", False, "ATT"),
    ("Ünïversité ﬁne", "universite fine", "UF", False, "UNIVERSITEFINE"),
]


def test_scalars(spark):
    df = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NAMES)], "i int, n string")
    toks = text.tokenize(F.col("n"))
    rows = df.select("i", F.array_join(toks, " ").alias("t"), text.acronym(toks).alias("a"), text.is_acronym_only(F.col("n")).alias("o"), text.acronym_key(F.col("n")).alias("k")).orderBy("i").collect()
    for r, n in zip(rows, NAMES, strict=True):
        assert (r["t"], r["a"], r["o"], r["k"]) == n[1:], n[0]


def test_grams(spark):
    df = spark.createDataFrame([("ab",), ("abcd",), ("",)], "c string")
    got = [r["g"] for r in df.select(text.char_grams(F.col("c")).alias("g")).collect()]
    assert got == [[], ["abc", "bcd", "abcd"], []]


def test_counts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), (None, 0), ("b", 5), ("B", 7)], "n string, p long")
    want = [(0, "", 1), (1, "a", 1), (2, "b", 2), (3, "B", 1)]
    for n in (1, 3):
        got = names.vocabulary(names.name_counts(df.repartition(n), "n", F.col("p"))).orderBy("name_id").collect()
        assert [tuple(r) for r in got] == want


def test_neighbours(spark):
    assert [candidates.neighbours_asked(n) for n in (0, 1, 2, 9, 57, 400)] == [0, 0, 2, 9, 10, 23]
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "name_id long, v array<double>")
    got = {(r["i"], r["rank"]): (r["j"], r["sim"]) for r in candidates.nearest_by_vectors(v, 3).collect()}
    assert got[0, 1] == (1, 1.0) and got[0, 2] == (2, 0.0) and got[3, 1] == (0, 0.0)


def test_neighbours_over_several_blocks(spark):
    """Copies, ties, zero vectors, values that aren't numbers and repeated ids against brute force, and no shuffle of blocks or similarities."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (4500, 4)).astype(float)
    x[7, 2] = np.nan
    ids = np.r_[0:4499, 17]
    rows = list(zip(ids.tolist(), x.tolist(), strict=True))
    near = candidates.nearest_by_vectors(spark.createDataFrame([rows[i] for i in rng.permutation(4500)], "name_id long, v array<float>"), 12)
    assert "Exchange" not in near._jdf.queryExecution().toString()
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    unit[7] = np.nan
    got = {}
    for r in near.collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"], r["sim"]))
    assert 7 not in got and len(got) == 4498
    for i in [0, 1, 2, 6, 8, 2047, 2048, 4498, *rng.integers(18, 4498, 300).tolist()]:
        sim = np.round(unit @ unit[i], 9)
        sim[(ids == i) | np.isnan(sim)] = -np.inf
        order = np.lexsort((ids, -sim))[:11]
        assert sorted(got[i]) == [(n + 1, int(ids[j]), sim[j]) for n, j in enumerate(order)]


def test_sequence_ratio_order(spark):
    r = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "")], "a string, b string").select(features.sequence_ratio("a", "b").alias("r")).collect()
    assert [x["r"] for x in r] == [0.25, 0.5, 1.0]


def test_bridges(spark):
    table = names.described(spark.createDataFrame([(0, "VT", 1), (1, "Virginia Tech", 1), (2, "Virginia Tank", 1), (3, "Princeton", 1)], "name_id long, name string, cnt long"))
    assert sorted(map(tuple, candidates.acronym_bridges(table).collect())) == [(0, 1), (0, 2)]
