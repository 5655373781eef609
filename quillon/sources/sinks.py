"""Deliveries: layouts, delimited and columnar files, and their data dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def render_layout(df: DataFrame, layout: list[tuple[str, str]]) -> DataFrame:
    """``layout``: (output name, source column); missing sources and nulls become empty text."""
    return df.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(name) for name, c in layout))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV in UTF-8 with a byte order mark at the head of every file (as part of its header), as spreadsheets expect."""
    df = df.toDF("\ufeff" + df.columns[0], *df.columns[1:])
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def data_dictionary(df: DataFrame, name: str) -> DataFrame:
    rows = [(name, i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def write_delivery(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Every table as Parquet below ``folder``, with a dictionary of all their columns; the dictionary."""
    out = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        one = data_dictionary(df, name)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    out.write.mode("overwrite").json(f"{folder}/_dictionary")
    return out
