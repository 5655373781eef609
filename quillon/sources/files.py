"""Delimited files of unknown encoding and separator, and the newest Parquet of a folder."""

from __future__ import annotations

import codecs
import csv

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructType

# Encodings by byte order mark, those tried in this order after UTF-8, separators, and endings of files.
MARKS = {codecs.BOM_UTF8: "utf-8", codecs.BOM_UTF16_LE: "utf-16", codecs.BOM_UTF16_BE: "utf-16"}
ENCODINGS = ("cp949", "euc-kr", "latin-1")
SEPARATORS = (",", ";", "\t", "|")
ENDINGS = (".csv", ".txt", ".tsv")
SPREADSHEETS = (".xlsx", ".xls", ".xlsm")


def _decodes(data: bytes, encoding: str) -> bool:
    try:
        codecs.decode(data, encoding)
    except UnicodeDecodeError:
        return False
    return True


def detect_encoding(head: bytes) -> str:
    """By the byte order mark, else the first encoding in which all of ``head`` is valid."""
    for mark, name in MARKS.items():
        if head.startswith(mark):
            return name
    return next((name for name in ("utf-8", *ENCODINGS) if _decodes(head, name)), "latin-1")


def sniff_separator(line: str) -> str:
    """The candidate that occurs most often in the first line; a comma if none does."""
    return max(SEPARATORS, key=lambda s: (line.count(s), s == ","))


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The delimited files at ``path`` by their endings; without any, all files that aren't spreadsheets. Only names are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()
    names = sorted(r[0] for r in rows)
    return [n for n in names if n.lower().endswith(ENDINGS)] or [n for n in names if not n.lower().endswith(SPREADSHEETS)]


@F.pandas_udf(ArrayType(BooleanType()))
def _valid(lines: pd.Series) -> pd.Series:
    """Whether a line is valid in each of ``ENCODINGS``; lines that are null aren't looked at."""
    return pd.Series([None if x is None else [_decodes(bytes(x), name) for name in ENCODINGS] for x in lines])


def file_forms(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, encoding, head``: the first encoding in which every line of the file is valid, and the bytes of its first line.
    All lines are looked at, in tasks; only lines that aren't UTF-8 reach Python."""
    meta = lambda c: F.col(f"_metadata.{c}")
    file = F.url_decode(F.replace(meta("file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(files).select(file.alias("file"), F.struct(meta("file_block_start").alias("at"), F.monotonically_increasing_id().alias("id")).alias("place"), F.col("value").cast("binary").alias("raw"), F.is_valid_utf8("value").alias("utf8"))
    lines = lines.withColumn("others", _valid(F.when(~F.col("utf8"), F.col("raw"))))
    fits = [F.bool_and(F.col("utf8") | F.col("others")[i]) for i in range(len(ENCODINGS))]
    first = F.min_by("raw", "place")
    marks = [F.when(F.startswith(first, F.lit(mark)), name) for mark, name in MARKS.items()]
    named = [F.when(fit, name) for fit, name in zip([F.bool_and("utf8"), *fits], ["utf-8", *ENCODINGS], strict=True)]
    return lines.groupBy("file").agg(F.coalesce(*marks, *named, F.lit("latin-1")).alias("encoding"), first.alias("head"))


def read_text_table(spark: SparkSession, path: str, schema: StructType | str | None = None, keep_bad: bool = False) -> DataFrame:
    """All delimited files at ``path``, each in its own encoding and with its own separator, put together by column names;
    columns are text unless a schema is given. Ragged rows are dropped (with a schema) or padded, as Spark's reader does. Files
    in Korean encodings turn on ``spark.sql.legacy.javaCharsets`` in the session, without which Spark refuses them."""
    forms: dict[tuple[str, str, str], list[str]] = {}
    for file, encoding, head in file_forms(spark, list_files(spark, path)).collect():  # a row a file
        line = bytes(head).decode(encoding, "replace").lstrip("\ufeff").rstrip("\r")
        forms.setdefault((encoding, sniff_separator(line), line), []).append(file)
    if not forms:
        raise ValueError(f"no lines at {path}")
    out = None
    for (encoding, separator, _), files in sorted(forms.items()):
        if encoding in ("cp949", "euc-kr"):
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        reader = spark.read.option("header", True).option("sep", separator).option("encoding", {"latin-1": "ISO-8859-1", "cp949": "MS949"}.get(encoding, encoding))
        reader = reader.option("mode", "PERMISSIVE" if keep_bad else "DROPMALFORMED")
        one = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(sorted(files))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def peek_columns(spark: SparkSession, path: str) -> list[str]:
    """The column names of the first file, from its first line alone."""
    row = spark.read.text(list_files(spark, path)[:1]).limit(1).select(F.col("value").cast("binary")).first()
    head = bytes(row[0]) if row else b""
    line = head.decode(detect_encoding(head), "replace").lstrip("\ufeff").rstrip("\r")
    return next(csv.reader([line], delimiter=sniff_separator(line)), [])


def latest_parquet(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """The newest file of the folder by its modification time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    if row is None:
        raise FileNotFoundError(folder)
    return spark.read.parquet(row[0])
