"""Types of text columns: a lattice of what every value of a column can be read as, counted in one pass.

A value may be a boolean, a date in one of several forms, a whole number or a number; any value is text. A column has the first
type in that order that all its values can be read as (or all but a tolerated share, which become null), so that one pass that
counts, for each type, the values that it can read decides. A column of dates has one form; numbers with a leading zero are
codes and make a column text; empty and blank values are null, and a column of nulls is text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.files import read_text_table

#: Forms of dates: what a value looks like, and what is put behind it first. Years outside 1900 to 2100 aren't dates.
FORMS = {
    "yyyyMMdd": (r"^(19\d\d|20\d\d|2100)\d{4}$", ""),
    "yyyyMM": (r"^(19\d\d|20\d\d|2100)\d{2}$", "01"),
    "yyyy-MM-dd": (r"^(19\d\d|20\d\d|2100)-\d{2}-\d{2}$", ""),
    "yyyy/MM/dd": (r"^(19\d\d|20\d\d|2100)/\d{2}/\d{2}$", ""),
    "yyyy.MM.dd": (r"^(19\d\d|20\d\d|2100)\.\d{2}\.\d{2}$", ""),
    "yyyy-MM": (r"^(19\d\d|20\d\d|2100)-\d{2}$", "-01"),
}
TRUE, FALSE = ("true", "yes", "y", "t"), ("false", "no", "n", "f")


@dataclass(frozen=True)
class ColumnType:
    """``kind``: boolean, date, long, double or string; ``form`` of dates."""

    column: str
    kind: str
    form: str | None
    rows: int
    nulls: int
    unread: int


def plain(x: Column) -> Column:
    """A value without spaces around it, null if nothing is left; whole numbers that went through a float lose their ``.0``."""
    x = F.nullif(F.trim(x.cast("string")), F.lit(""))
    return F.when(F.contains(x, F.lit(".0")), F.regexp_replace(x, r"^(\d+)\.0$", "$1")).otherwise(x)


def read_as(x: Column, kind: str, form: str | None = None) -> Column:
    """A plain value as a type, null if it can't be read."""
    if kind == "boolean":
        return F.when(F.octet_length(x) <= 5, F.when(F.lower(x).isin(*TRUE), True).when(F.lower(x).isin(*FALSE), False))
    if kind == "date":
        looks, behind = FORMS[form]
        mark = form.replace("y", "").replace("M", "").replace("d", "")[:1]
        day = F.concat(x, F.lit(behind))  # its digits are known to be in place, so that a cast reads it
        day = F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)) if not mark else day if mark == "-" else F.replace(day, F.lit(mark), F.lit("-"))
        same = F.octet_length(x) == len(form)
        same = same & (F.substring(x, 5, 1) == mark) if mark else same
        return F.when(same & x.rlike(looks), day.try_cast("date"))
    if kind == "long":
        return F.when(x.rlike(r"^[+-]?(0|[1-9]\d{0,2}(,\d{3})+|[1-9]\d*)$"), F.replace(x, F.lit(","), F.lit("")).try_cast("long"))
    if kind == "double":
        return F.when(x.rlike(r"^[+-]?(0|[1-9]\d{0,2}(,\d{3})+|[1-9]\d*)?(\.\d+)?([eE][+-]?\d+)?$") & x.rlike(r"\d"), F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return x


def _apart(x: Column, read: Callable[[Column], Column]) -> Column:
    """``read(x)`` in a lambda. Spark joins the expressions of a projection to one method of generated code, which the JVM does not compile
    for wide rows; a projection with a lambda is left out of that, and its expressions become methods of their own."""
    return F.transform(F.array(x), lambda v: read(v))[0]


#: What a column may be, the most special first.
LATTICE = [("boolean", None), *(("date", f) for f in FORMS), ("long", None), ("double", None)]


def infer_types(df: DataFrame, sample_rows: int | None = None, tolerance: float = 0.0) -> list[ColumnType]:
    """The types of all columns of ``df`` (text), from all rows or from ``sample_rows`` of them (whichever Spark reads first). Every value
    becomes a mark, a bit for each entry of the lattice that it can be read as; marks are counted by column, so a few rows a column come
    back. At most ``tolerance`` of a column's values may be unreadable as its type."""
    rows = df if sample_rows is None else df.limit(sample_rows)
    names = [str(i) for i in range(len(df.columns))]
    values = rows.select(*(F.col(f"`{c}`").cast("string").alias(i) for i, c in zip(names, df.columns, strict=True))).unpivot([], names, "i", "x")
    x = F.col("x")
    reads = lambda *at: sum((F.when(read_as(x, kind, form).isNotNull(), 1 << k).otherwise(0) for k, (kind, form) in enumerate(LATTICE) if kind in at), F.lit(0))
    long, double = (1 << LATTICE.index((kind, None)) for kind in ("long", "double"))
    numbers = F.when(reads("long") > 0, long + double).otherwise(reads("double"))  # every whole number is a number
    mark = F.when(F.substring(x, 1, 1).isin(*"0123456789+-."), reads("date") + numbers).otherwise(reads("boolean"))  # by the first letter: nothing else can be read
    marks = values.withColumn("x", plain(x)).groupBy("i", F.when(x.isNotNull(), mark).alias("mark")).agg(F.count("*").alias("n")).collect() if names else []
    out = []
    for i, c in zip(names, df.columns, strict=True):
        own = [(m.mark, m.n) for m in marks if m.i == i]
        total, n = sum(n for _, n in own), sum(n for mark, n in own if mark is not None)
        read = [sum(n for mark, n in own if mark is not None and mark >> k & 1) for k in range(len(LATTICE))]
        fits = [k for k in range(len(LATTICE)) if n and read[k] >= (1 - tolerance) * n]
        kind, form = LATTICE[fits[0]] if fits else ("string", None)
        out.append(ColumnType(c, kind, form, total, total - n, n - read[fits[0]] if fits else 0))
    return out


def typed(df: DataFrame, types: list[ColumnType]) -> DataFrame:
    """``df`` with each column read as its type; blank values and those that can't be read are null. Columns without a type stay."""
    known, name = {t.column: t for t in types}, lambda c: F.col(f"`{c}`")
    first = next((c for c in df.columns if c in known), None)
    put = lambda c, read: (name(c) if c not in known else _apart(name(c), read) if c == first else read(name(c))).alias(c)
    clean = df.select(*(put(c, plain) for c in df.columns))  # once, however often a reading looks at it
    return clean.select(*(put(c, lambda x, c=c: read_as(x, known[c].kind, known[c].form)) for c in df.columns))


def read_typed_table(spark: SparkSession, path: str, sample_rows: int | None = 200_000, tolerance: float = 0.0) -> DataFrame:
    """All delimited files at ``path`` (see ``read_text_table``), with types inferred from a sample of rows."""
    rows = read_text_table(spark, path)
    return typed(rows, infer_types(rows, sample_rows, tolerance))


def type_table(spark: SparkSession, types: list[ColumnType]) -> DataFrame:
    return spark.createDataFrame([(t.column, t.kind, t.form, t.rows, t.nulls, t.unread) for t in types], "column string, kind string, form string, rows long, nulls long, unread long")
