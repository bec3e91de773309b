"""Command lines, and what carries over from run to run."""

import re

import pytest

from siftloom import cli
from siftloom.functions import codes
from siftloom.operators.verifier import Verifier
from siftloom.sources import files
from siftloom.streaming import jobs

DDL = "kind string, a string, b string"


def constraint_stream(spark, folder):
    return spark.readStream.schema(DDL).parquet(str(folder))


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(folder))


def test_constraints_survive_failed_batches(spark, tmp_path, monkeypatch):
    store, state, inbox = str(tmp_path / "store"), str(tmp_path / "state"), tmp_path / "in"
    assert jobs.stored_constraints(spark, store).count() == 0
    arrive(spark, inbox, [("must", "a", "b"), ("must", "b", "a")])
    jobs.stream_constraints(constraint_stream(spark, inbox), store, state)
    first = {("must", "a", "b")}
    assert {tuple(r) for r in jobs.stored_constraints(spark, store).collect()} == first
    arrive(spark, inbox, [("cannot", "c", "d")])
    # a batch that dies half-way leaves the store as it was, and its replay adds it once
    from pyspark.sql import DataFrameWriter

    write = DataFrameWriter.parquet

    def dies(self, path, *rest, **named):
        if "batch=" in path:
            raise OSError("store not reached")
        return write(self, path, *rest, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(Exception, match="store not reached"):
        jobs.stream_constraints(constraint_stream(spark, inbox), store, state)
    monkeypatch.undo()
    assert {tuple(r) for r in jobs.stored_constraints(spark, store).collect()} == first
    for _ in range(2):
        jobs.stream_constraints(constraint_stream(spark, inbox), store, state)
        assert {tuple(r) for r in jobs.stored_constraints(spark, store).collect()} == first | {("cannot", "c", "d")}
        assert jobs.stored_constraints(spark, store).count() == 2


def test_unreachable_stores_raise(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)scheme"):
        Verifier.load(spark, "nosuchscheme://x/model")
    with pytest.raises(Exception, match="(?i)scheme"):
        files.read_constraints(spark, "nosuchscheme://x/c.json")
    assert Verifier.load(spark, str(tmp_path / "none")) is None and Verifier.history(spark, str(tmp_path / "none")) is None


def test_runs_learn_from_earlier_runs(spark, tmp_path):
    names = ["Virginia Tech", "VT", "Virginia Tech University", "Georgia Tech", "GT", "Ohio State", "Ohio State University", "Princeton", "Yale"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text("Names\n" + "\n".join(names) + "\n")
    (tmp_path / "f.csv").write_text("cluster,label\nOhio State | Ohio State University,1\nPrinceton | Yale,0\n")
    model = tmp_path / "model"
    call = ["cluster", "--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--columns", "names", "--feedback", str(tmp_path / "f.csv"), "--emit-review", "3", "--model-dir", str(model)]
    seen = []
    for _ in range(2):
        assert cli.main(call, spark) == 0
        saved = Verifier.load(spark, f"{model}/model")
        seen.append((saved.updates, saved.pairs, Verifier.history(spark, f"{model}/model").count(), Verifier.load(spark, f"{model}/model_warm").updates))
    (_, pairs, rows, _) = seen[0]
    assert rows == pairs and seen == [(1, pairs, pairs, 1), (2, 2 * pairs, 2 * pairs, 2)]
    assert files.read_constraints(spark, f"{model}/constraints.json").count() == 2
    assert files.read_csv(spark, str(tmp_path / "out" / "x_review_clusters.csv")).columns == ["cluster", "label"]


def test_filter_command_lines(spark, tmp_path, capsys):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_text("HSCode,ShipperName\n030289,A\n847130,B\n")
    (tmp_path / "in" / "deep" / "none.csv").write_text("HSCode,ShipperName\n847130,B\n")
    assert cli.main(["filter", "--input", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out")], spark) == 0
    said = capsys.readouterr().out
    assert "a.csv: 1 of 2 rows kept" in said and "none.csv: 0 of 1 rows kept" in said
    # no file where nothing is kept
    assert [p.name for p in (tmp_path / "out").rglob("*_filtered.csv")] == ["a_filtered.csv"]
    assert cli.main(["clean", str(tmp_path / "in" / "a.csv"), "--output", str(tmp_path / "clean")], spark) == 0
    assert (tmp_path / "clean" / "a_filtered_HSCode.csv").exists()
    assert cli.main(["filter", "--input", str(tmp_path / "clean"), "--output", str(tmp_path / "o2")], spark) == 0


def test_token_pattern():
    def plain(token):
        digits = re.sub(r"\D+", "", token)
        code = "0" + digits if len(digits) in (5, 7, 9) else digits
        return len(code) in (6, 8, 10) and code.startswith(codes.PREFIXES)

    pattern = re.compile(codes.stripped_pattern(codes.PREFIXES))
    for token in "030289 30289 0302 302.89.50 1604140000 16041 8471300000 123456789 160414 1605 16051 03 3 300490 0302890 031604 99 1.6.0.4.1.4".split():
        assert bool(pattern.match(re.sub(r"\D+", "", token))) == plain(token), token
