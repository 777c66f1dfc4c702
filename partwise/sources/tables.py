"""Reading and writing of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSpec:
    """Name, required columns in order, and format of a table."""

    name: str
    columns: tuple[str, ...]
    fmt: str = "parquet"


def read_table(spark: SparkSession, folder: str, spec: TableSpec) -> DataFrame:
    """The required columns of a table; header names are trimmed, other columns dropped, missing ones an error."""
    reader = spark.read.option("header", True) if spec.fmt == "csv" else spark.read
    df = reader.format(spec.fmt).load(f"{folder}/{spec.name}.{spec.fmt}")
    trimmed = {c.strip().lstrip("﻿"): c for c in df.columns}
    missing = [c for c in spec.columns if c not in trimmed]
    if missing:
        raise ValueError(f"table {spec.name} lacks {missing}")
    return df.select(*[F.col(f"`{trimmed[c]}`").alias(c) for c in spec.columns])


def read_tables(spark: SparkSession, folder: str, specs) -> dict[str, DataFrame]:
    return {s.name: read_table(spark, folder, s) for s in specs}


def coerce_parts(df: DataFrame, parts) -> DataFrame:
    """Parts as doubles; what is no number becomes null."""
    return df.withColumns({p: F.trim(F.col(p).cast("string")).try_cast("double") for p in parts})


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
