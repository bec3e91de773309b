import pytest
from pyspark.sql import functions as F

from siftloom.plans import resolve
from siftloom.sources import files
from siftloom.streaming import jobs

CSV = 'HSCode,ShipperName,Other\n030289,"A ""quoted"", name",1\n8471.30,B,2\n"847130, 1604.14","two\nlines",NA\n'


def test_read_write(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.CSV").write_text(CSV)
    (tmp_path / "in" / "deep" / "b.csv").write_text(CSV)
    root = str(tmp_path / "in")
    assert [p.rsplit("/", 1)[-1] for p in files.list_files(spark, root)] == ["a.CSV"]
    assert [p.rsplit("/", 1)[-1] for p in files.list_files(spark, root, recursive=True)] == ["b.csv"]
    df = files.read_csv(spark, f"{root}/deep/b.csv")
    assert [tuple(r) for r in df.collect()] == [("030289", 'A "quoted", name', "1"), ("8471.30", "B", "2"), ("847130, 1604.14", "two\nlines", None)]
    for _ in range(2):
        done = resolve.filter_folder(spark, root, str(tmp_path / "out"))
        assert [(k, t) for _, k, t in done] == [(2, 3)]
        back = files.read_csv(spark, str(tmp_path / "out/deep/b_filtered.csv"))
        assert back.columns == ["HSCode", "ShipperName"] and back.count() == 2
    assert resolve.filter_files(spark, [f"{root}/deep/b.csv"], str(tmp_path / "sel")) == ["b"]
    assert files.read_csv(spark, str(tmp_path / "sel/b_filtered_HSCode_selected_columns.csv")).columns == ["HSCode", "ShipperName"]


def test_constraints(spark, tmp_path):
    path = str(tmp_path / "c.json")
    assert files.read_constraints(spark, path).count() == 0
    c = spark.createDataFrame([("must", "a", "b"), ("cannot", "c", "d")], "kind string, a string, b string")
    files.write_constraints(c, path)
    assert sorted(map(tuple, files.read_constraints(spark, path).collect())) == sorted(map(tuple, c.collect()))
    (tmp_path / "bad.json").write_text("{")
    assert files.read_constraints(spark, str(tmp_path / "bad.json")).count() == 0


def test_cluster_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    names = ["Virginia Tech", "VT", "Virginia Tech University", "Georgia Tech", "GT", "Ohio State", "Ohio State University", "Princeton", "Yale"]
    (tmp_path / "in" / "x.csv").write_text("names\n" + "\n".join(names * 2) + "\n")
    (tmp_path / "f.csv").write_text("Cluster,Label\nOhio State | Ohio State University,1\nPrinceton | Yale,0\n")
    done = resolve.cluster_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["names"], reviewed=str(tmp_path / "f.csv"), emit_review=5, model_path=str(tmp_path / "model"), constraints_path=str(tmp_path / "c.json"))
    assert done == 1
    kinds = {(r["kind"], r["a"], r["b"]) for r in files.read_constraints(spark, str(tmp_path / "c.json")).collect()}
    assert kinds == {("must", "Ohio State", "Ohio State University"), ("cannot", "Princeton", "Yale")}
    text = [r["value"] for r in spark.read.text(str(tmp_path / "out/x.txt")).collect()]
    assert text[0] == "# Clusters" and sum(line.startswith("  - ") for line in text) == len(names)
    block = next(b for b in "\n".join(text).split("\n\n") if "- Ohio State  " in b)
    assert "- Ohio State University  " in block
    assert resolve.verifier.Verifier.load(spark, str(tmp_path / "model")).updates == 1


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "030289"), (2, "847130"), (3, "030289")], "k long, c string").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    for p in (tmp_path / "t.parquet").glob("part-*"):
        (tmp_path / "in").mkdir(exist_ok=True)
        p.rename(tmp_path / "in" / "t.parquet")
    source = lambda: jobs.read_stream(spark, str(tmp_path / "in"), "t")
    for _ in range(2):
        jobs.stream_filter(source(), F.col("c"), str(tmp_path / "kept"), str(tmp_path / "s1"))
        assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [1, 3]
    jobs.stream_counts(source(), "c", str(tmp_path / "counts"), str(tmp_path / "s2"))
    assert {r["name"]: r["count"] for r in spark.read.parquet(str(tmp_path / "counts")).collect()} == {"030289": 2, "847130": 1}


def test_missing_columns_are_skipped(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n1,2\n")
    assert files.read_feedback(spark, str(tmp_path / "f.csv")).count() == 0
    assert files.header(spark, str(tmp_path / "none.csv")) is None
    with pytest.raises(ValueError):
        resolve.filtering.filter_semicolon(files.read_csv(spark, str(tmp_path / "f.csv")))
