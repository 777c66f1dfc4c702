"""Fingerprints, comparison of snapshots, and evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    x = F.format_number(F.col(c), 9) if kind in ("double", "float") else F.col(c).cast("string")
    return F.coalesce(x, F.lit(""))


def row_number_of(df: DataFrame) -> Column:
    """A row's hash as a number below 2**60, over the columns in the order of their names."""
    joined = F.concat_ws("|", *[_text(df, c) for c in sorted(df.columns)])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and the sum of the rows' hashes, whatever the order of rows and columns."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(row_number_of(df)).cast("string"), F.lit("0")).alias("fingerprint"))


def compare_tables(a: DataFrame, b: DataFrame, keys, values, tol: float = 1e-12) -> DataFrame:
    """Per value column: rows on one side only, cells that differ by more than ``tol``, largest difference."""
    x, y = a.select(*keys, *[F.col(v).alias(f"x_{v}") for v in values], F.lit(1).alias("in_x")), b.select(*keys, *[F.col(v).alias(f"y_{v}") for v in values], F.lit(1).alias("in_y"))
    both = x.join(y, list(keys), "full")
    only = F.col("in_x").isNull() | F.col("in_y").isNull()
    each = F.array(*[F.struct(F.lit(v).alias("column"), only.alias("only"), F.abs(F.col(f"x_{v}") - F.col(f"y_{v}")).alias("gap"), (F.col(f"x_{v}").isNull() != F.col(f"y_{v}").isNull()).alias("null_differs")) for v in values])
    rows = both.select(F.explode(each).alias("c")).select("c.*")
    return rows.groupBy("column").agg(F.sum(F.col("only").cast("int")).alias("one_side_only"), F.sum(((F.coalesce("gap", F.lit(0.0)) > tol) | (F.col("null_differs") & ~F.col("only"))).cast("int")).alias("different"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("largest"))


def sensitivity_master(tables: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """One schema ``source, scenario, item, value`` for tables given as (frame, scenario, item, value) columns."""
    out = None
    for name, (df, scenario, item, value) in tables.items():
        one = df.select(F.lit(name).alias("source"), F.col(scenario).cast("string").alias("scenario"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def claim_evidence(claims: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """``claim, evidence``: a sentence made from each result table's rows."""
    out = None
    for name, (df, text) in claims.items():
        one = df.select(F.lit(name).alias("claim"), text.alias("evidence"))
        out = one if out is None else out.unionByName(one)
    return out
