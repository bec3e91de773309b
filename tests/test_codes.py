import pytest
from pyspark.sql import functions as F

from siftloom.functions import codes
from siftloom.operators import filtering

CELLS = [
    # cell, normalised tokens, comma dialect keeps, semicolon dialect keeps
    ("030289", ["030289"], True, True),
    ("30289", ["030289"], True, True),
    ("0302", [None], False, True),
    ("302.89.50", ["03028950"], True, True),
    ("1604140000", ["1604140000"], True, True),
    ("16041", ["016041"], False, True),
    ("8471300000", ["8471300000"], False, False),
    ("123456789", ["0123456789"], False, False),
    ("1604.14, 8471.30", ["160414", "847130"], True, True),
    ("847130,030289", ["847130", "030289"], True, False),
    ("030289;160414", [None], False, True),
    ("30289;16041", ["3028916041"], False, True),
    ("", [None], False, False),
    ("abc", [None], False, False),
    ("300490", ["300490"], False, True),
    ("847130;30289", [None], False, False),
    (None, None, False, False),
]


def test_cells(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CELLS)], "i int, c string")
    cleaned = codes.clean_semicolon_cell(F.col("c"))
    rows = df.select("i", F.transform(F.split("c", ","), codes.normalize_code).alias("t"), codes.comma_cell_matches(F.col("c")).alias("a"), codes.semicolon_cell_matches(cleaned).alias("b")).orderBy("i").collect()
    for r, (cell, tokens, comma, semicolon) in zip(rows, CELLS, strict=True):
        assert (r["t"], r["a"], r["b"]) == (tokens, comma, semicolon), cell


def test_repair_is_optional(spark):
    df = spark.createDataFrame([("300490",)], "c string")
    assert not df.select(codes.semicolon_cell_matches(codes.clean_semicolon_cell(F.col("c"), repair=False)).alias("m")).first()["m"]


def test_columns():
    assert filtering.pick_column(["Name", "name"], ["NAME"]) == "Name"
    assert filtering.pick_column(["a", "b"], ["x", "b", "a"]) == "b"
    assert filtering.pick_column(["a"], ["x"]) is None
    assert filtering.output_columns(["ShipperName", "HS", "NetWeightKg"], "HS") == ["HS", "ShipperName", "NetWeightKg"]
    assert filtering.output_columns(["NetWeightKg", "ShipperName"], "NetWeightKg") == ["ShipperName", "NetWeightKg"]
    assert filtering.code_header(["x", " ﻿HsCode "]) == " ﻿HsCode "
    with pytest.raises(ValueError):
        filtering.code_header(["x"])


def test_detection(spark):
    df = spark.createDataFrame([("a", "030289", None), ("b", "x", None), ("c", "1604.14", "030289")], "n string, a string, b string")
    assert {r["column"]: round(r["score"], 3) for r in filtering.detection_scores(df).collect()} == {"n": 0.0, "a": 0.667, "b": 1.0}
    assert filtering.detect_code_column(df) == "b"
    assert filtering.detect_code_column(df.withColumn("HTS", F.lit("x"))) == "HTS"
    assert filtering.detect_code_column(df.select("n")) is None


def test_strict_selection_fails(spark):
    df = spark.createDataFrame([("x",)], "HSCode string")
    assert filtering.select_kept(df).columns == ["HSCode"]
    with pytest.raises(Exception):
        filtering.select_kept(df, strict=True).collect()
