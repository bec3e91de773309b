"""Row filters on trade codes: column detection, both dialects, column selection, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions import codes

#: Columns that the two dialects keep, in order.
KEEP_COMMA = ("ShipperName", "ShipperFullAddress", "ShipperLocalDUNS", "ShipperPanjivaID", "ShipperCleanedStockTickers", "ShipperOriginalFormat", "NetWeightKg", "ValueOfGoodsFOBUSD")
KEEP_SEMICOLON = ("HSCode", "ConsigneeName", "ConsigneeLocalDUNS", "ConsigneePanjivaID", "ShipperName", "ShipperPanjivaID")


def pick_column(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate found exactly; else the first found without regard to case, the earlier header winning."""
    for c in candidates:
        if c in columns:
            return c
    lower: dict[str, str] = {}
    for c in columns:
        lower.setdefault(c.lower(), c)
    return next((lower[c.lower()] for c in candidates if c.lower() in lower), None)


def detection_scores(df: DataFrame, rows: int = 50_000, values: int = 10_000) -> DataFrame:
    """(position, column, score): per column the share of its first `values` non-null values, among the first `rows` rows, that hold a code.

    One scan of the head; counting stops per column by its running number of non-null values.
    """
    head = df.limit(rows)
    shares = []
    for i, c in enumerate(df.columns):
        # a limit per column keeps the head's order within one file, as the sample is a prefix
        first = head.where(F.col(f"`{c}`").isNotNull()).limit(values)
        shares.append(first.agg(F.lit(i).cast("int").alias("position"), F.lit(c).alias("column"), F.coalesce(F.avg(F.coalesce(codes.has_code(F.col(f"`{c}`").cast("string")), F.lit(False)).cast("double")), F.lit(0.0)).alias("score")))
    out = shares[0]
    for s in shares[1:]:
        out = out.unionByName(s)
    return out


def detect_code_column(df: DataFrame, least: float = 0.30) -> str | None:
    """By name preference, else the best score, the first column on ties, if it reaches `least`."""
    for name in codes.CODE_HEADERS:
        if name in df.columns:
            return name
    best = detection_scores(df).orderBy(F.col("score").desc(), "position").first()
    return best["column"] if best and best["score"] >= least else None


def output_columns(columns: list[str], code_column: str, keep: tuple[str, ...] = KEEP_COMMA) -> list[str]:
    """Keepers that exist, in their order; the code column first unless it is one of them."""
    found = [c for c in keep if c in columns]
    return found if code_column in found else [code_column, *found]


def filter_comma(df: DataFrame, code_column: str, keep: tuple[str, ...] = KEEP_COMMA, prefixes: tuple[str, ...] = codes.PREFIXES) -> DataFrame:
    return df.where(codes.comma_cell_matches(F.col(f"`{code_column}`"), prefixes)).select(*(f"`{c}`" for c in output_columns(df.columns, code_column, keep)))


def filter_counts(df: DataFrame, code_column: str, prefixes: tuple[str, ...] = codes.PREFIXES) -> DataFrame:
    """(kept, total) in one aggregation."""
    return df.agg(F.count_if(codes.comma_cell_matches(F.col(f"`{code_column}`"), prefixes)).alias("kept"), F.count("*").alias("total"))


def code_header(columns: list[str]) -> str:
    """The header that reads hscode after trimming, dropping byte-order marks and lower-casing."""
    for c in columns:
        if c.strip().replace("﻿", "").lower() == "hscode":
            return c
    raise ValueError("no HSCode column after normalisation")


def filter_semicolon(df: DataFrame, repair: bool = True, prefixes: tuple[str, ...] = codes.PREFIXES) -> DataFrame:
    """All columns under their own headers, the code column cleaned, matching rows only."""
    name = code_header(df.columns)
    cleaned = df.withColumn(name, codes.clean_semicolon_cell(F.col(f"`{name}`"), repair))
    return cleaned.where(codes.semicolon_cell_matches(F.col(f"`{name}`"), prefixes))


def select_kept(df: DataFrame, keep: tuple[str, ...] = KEEP_SEMICOLON, strict: bool = False) -> DataFrame:
    """The kept columns in order; missing ones are skipped, or fail if `strict`."""
    return df.select(*(f"`{c}`" for c in keep if strict or c in df.columns))
