import itertools
import random

import pytest

from siftloom.operators import clustering, feedback, report, verifier

CASES = [
    ([(0, 1, 0.65)], [], [], 2, [0, 1]),
    ([(0, 1, 0.75)], [], [], 2, [0, 0]),
    ([(0, 1, 0.75), (0, 2, 0.65), (1, 2, 0.65)], [], [], 3, [0, 0, 0]),
    ([(0, 1, 0.75), (1, 2, 0.75)], [], [], 3, [0, 0, 0]),
    ([(0, 1, 0.9), (2, 3, 0.9), (1, 2, 0.8)], [], [], 4, [0, 0, 1, 1]),
    ([(0, 1, 0.9)], [], [(0, 1)], 2, [0, 1]),
    ([], [(0, 1)], [(0, 1)], 2, [0, 0]),
    ([(0, 1, 0.59)], [], [], 2, [0, 1]),
]


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


@pytest.mark.parametrize("edges,must,cannot,n,want", CASES)
def test_merge_rule(spark, edges, must, cannot, n, want):
    got = clustering.cluster_no_chaining(spark.range(n).toDF("node"), frame(spark, edges, "i long, j long, p double"), 0.60, frame(spark, must, "i long, j long"), frame(spark, cannot, "i long, j long"))
    assert [r["label"] for r in got.orderBy("node").collect()] == want


def whole_graph(n, edges, must, cannot, t):
    """The merge rule over the whole graph at once."""
    p = {(i, j): v for i, j, v in edges}
    parts = {v: {v} for v in range(n)}
    of = list(range(n))

    def unite(a, b):
        a, b = of[a], of[b]
        if a != b:
            for v in parts[b]:
                of[v] = a
            parts[a] |= parts.pop(b)

    for i, j in sorted(must):
        unite(i, j)
    for v, i, j in sorted(((v, i, j) for i, j, v in edges if v >= t), reverse=True):
        a, b = of[i], of[j]
        if a == b:
            continue
        cross = [(min(x, y), max(x, y)) for x in parts[a] for y in parts[b]]
        if any(c in cannot for c in cross):
            continue
        ties = [p.get(c, 0) for c in cross]
        support = sum(x >= t for x in ties)
        if min(len(parts[a]), len(parts[b])) == 1:
            ok = support >= 2 or max(ties) >= min(0.95, t + 0.10)
        else:
            ok = support / len(ties) >= 0.60 and all(any(p.get((min(x, y), max(x, y)), 0) >= t for y in parts[o]) for s, o in ((a, b), (b, a)) for x in parts[s])
        if ok:
            unite(i, j)
    least = {r: min(m) for r, m in parts.items()}
    order = sorted(set(least.values()))
    return [order.index(least[of[v]]) for v in range(n)]


def test_merge_by_components_equals_whole_graph(spark):
    rng = random.Random(5)
    n = 40
    pairs = rng.sample(list(itertools.combinations(range(n), 2)), 90)
    edges = [(i, j, round(rng.random(), 2)) for i, j in pairs]
    must, cannot = rng.sample(pairs, 4), set(rng.sample(pairs, 12))
    got = clustering.cluster_no_chaining(spark.range(n).toDF("node"), frame(spark, edges, "i long, j long, p double"), 0.5, frame(spark, must, "i long, j long"), frame(spark, sorted(cannot), "i long, j long"))
    assert [r["label"] for r in got.orderBy("node").collect()] == whole_graph(n, edges, must, cannot, 0.5)


def test_components(spark):
    edges = frame(spark, [(i, i + 1) for i in range(30)] + [(40, 41)], "i long, j long")
    got = {r["node"]: r["component"] for r in clustering.connected(edges, spark.range(43).toDF("node")).collect()}
    assert got == {v: 0 if v <= 30 else 40 if v in (40, 41) else v for v in range(43)}


def test_feedback(spark):
    rows = [("a", "A | B | C", "1"), ("b", '["A","B"]', "0"), ("c", '["A", "B', "1"), ("d", "A", "1"), ("e", None, "1"), ("f", "A | B", ""), ("g", "A | B", "2"), ("h", ' ["A ","B"]', "1")]
    got = {r["id"]: (r["members"], r["label"]) for r in feedback.parse_feedback(frame(spark, rows, "id string, cluster string, label string"), "id").collect()}
    assert got == {"a": (["A", "B", "C"], 1), "b": (["A", "B"], 0), "g": (["A", "B"], 2), "h": (["A ", "B"], 1)}


def test_constraints_have_no_order(spark):
    a, b = frame(spark, [("must", "x", "y")], "kind string, a string, b string"), frame(spark, [("must", "y", "x"), ("cannot", "x", "z")], "kind string, a string, b string")
    assert sorted(map(tuple, feedback.union_constraints(a, b).collect())) == [("cannot", "x", "z"), ("must", "x", "y")]


def test_threshold(spark):
    t = lambda rows: verifier.youden_threshold(frame(spark, rows, "score double, y int")).first()["threshold"]
    assert t([(0.9, 1), (0.8, 1), (0.3, 0)]) == 0.8
    assert t([(0.9, 1), (0.2, 1)]) == 0.5
    assert t([(0.4, 1), (0.3, 0)]) == 0.5
    assert t([(0.9, 0), (0.3, 1)]) == 1.0


def test_report(spark):
    names = frame(spark, [(0, "b", 2), (1, "A", 2), (2, "c", 9), (3, "Z", 1), (4, "M", 5)], "name_id long, name string, cnt long")
    labels = frame(spark, [(0, 0), (1, 0), (2, 1), (3, -1), (4, clustering.MISC)], "name_id long, label long")
    lines = [r["line"] for r in report.report_lines(labels, names).orderBy("line_no").collect()]
    assert lines == ["# Clusters", "", "Total clusters: 2", "", "Cluster 0 (unique: 1, total: 9)", "  - c  x9", "", "Cluster 1 (unique: 2, total: 4)", "  - A  x2", "  - b  x2", "", "Cluster misc (unique: 1, total: 1)", "  - M  x1", "", "Cluster Z (singleton)", "  - Z  x1", ""]
