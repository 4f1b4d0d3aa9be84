"""Lossless CSV: everything is read as text, and a column becomes a type only if every value is one. Repair of ragged rows."""

from __future__ import annotations

import csv as csv_lib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.detect import delimiter_of, head_of

#: What stands for a missing value in text files.
NULLS = ("", "NULL", "\\N")
_INT = r"^[+-]?(?:0|[1-9][0-9]{0,17})$"
_FLOAT = r"^[+-]?(?:0|[1-9][0-9]*)?(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)?$"


def nulled(c: Column) -> Column:
    return F.when(~c.isin(*NULLS), c)


def type_checks(c: Column) -> dict[str, Column]:
    """By type, in order of trial: whether a value is one. A leading zero is no number, since it would be lost."""
    return {"bigint": c.rlike(_INT) & c.try_cast("bigint").isNotNull(), "double": c.rlike(_FLOAT) & c.rlike("[0-9]") & c.try_cast("double").isNotNull(),
            "boolean": F.lower(c).isin("true", "false"), "timestamp_ntz": c.rlike(_ISO) & c.try_cast("timestamp_ntz").isNotNull()}


def promoted(df: DataFrame) -> DataFrame:
    """Text columns as the first type that every non-null value is; one aggregate decides for all columns."""
    names = df.columns
    made = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        made.append(F.count(c).alias(f"n{i}"))
        made += [F.bool_and(F.when(c.isNotNull(), ok)).alias(f"{t}{i}") for t, ok in type_checks(c).items()]
    got = df.agg(*made).first()
    out = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        kind = next((t for t in type_checks(c) if got[f"n{i}"] and got[f"{t}{i}"]), None)
        out.append((c.cast(kind) if kind else c).alias(n))
    return df.select(*out)


@dataclass(frozen=True)
class RowProfile:
    header: tuple[str, ...]
    delimiter: str
    classes: tuple[str | None, ...]  # the class that nine in ten values of a column have


def value_class(v: str) -> str:
    v = v.strip()
    if v in NULLS:
        return "empty"
    for kind, table in (("int", "+-0123456789"), ("number", "+-.0123456789eE")):
        if all(ch in table for ch in v) and any(ch.isdigit() for ch in v):
            return kind
    if len(v) >= 8 and v[:4].isdigit() and v[4] in "-/":
        return "date"
    if v.lower() in ("true", "false", "yes", "no"):
        return "boolean"
    return "text"


def row_profile(lines: list[str], delimiter: str | None = None) -> RowProfile:
    delimiter = delimiter or delimiter_of("\n".join(lines))
    rows = list(csv_lib.reader(lines, delimiter=delimiter))
    header = tuple(h.strip() for h in rows[0])
    classes: list[str | None] = []
    whole = [r for r in rows[1:20_001] if len(r) == len(header)]
    for i in range(len(header)):
        counts: dict[str, int] = {}
        for r in whole:
            k = value_class(r[i])
            if k != "empty":
                counts[k] = counts.get(k, 0) + 1
        total = sum(counts.values())
        best = max(counts, key=lambda k: (counts[k], k)) if counts else None
        classes.append(best if best and counts[best] >= 0.9 * total else None)
    return RowProfile(header, delimiter, tuple(classes))


def repaired_row(row: list[str], p: RowProfile) -> tuple[list[str | None], str]:
    """(fields, what was done): short rows are padded; of extra fields those neighbours are merged that fit the column
    classes best (two points a fitting field, one where the merge lands in text, half for a space after a delimiter)."""
    width = len(p.header)
    if len(row) == width:
        return list(row), "ok"
    if len(row) < width:
        return [*row, *[None] * (width - len(row))], "padded"
    extra = len(row) - width
    best: tuple[float, list[str]] | None = None
    ties = 0
    for at in range(width):
        joined = p.delimiter.join(row[at:at + extra + 1])
        fields = [*row[:at], joined, *row[at + extra + 1:]]
        fits = sum(2.0 for v, k in zip(fields, p.classes) if k is None or value_class(v) in (k, "empty") or (k == "number" and value_class(v) == "int"))
        score = fits + (1.0 if p.classes[at] in ("text", None) else 0.0) + 0.5 * any(x.startswith(" ") for x in row[at + 1:at + extra + 1])
        if best is None or score > best[0]:
            best, ties = (score, fields), 0
        elif score == best[0]:
            ties += 1
    return best[1], "merged" if not ties else "merged_tie"


def repaired(lines: DataFrame, p: RowProfile) -> DataFrame:
    """Rows from a DataFrame of text lines (``value``): the header's columns and ``__repair``; all as text.

    Each line is one row; quoted line breaks need ``read_csv`` with its multi-line reader instead.
    """
    width = len(p.header)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [repaired_row(r, p) for r in csv_lib.reader(b["value"].tolist(), delimiter=p.delimiter) if r]
            yield pd.DataFrame([[*f, how] for f, how in rows], columns=[*(f"c{i}" for i in range(width)), "__repair"])
    schema = ", ".join([*(f"c{i} string" for i in range(width)), "__repair string"])
    out = lines.mapInPandas(run, schema)
    return out.select(*[nulled(F.col(f"c{i}")).alias(h) for i, h in enumerate(p.header)], "__repair")


def without_headers(spark: SparkSession, path: str) -> DataFrame:
    """The text lines (``value``) of a file or folder less the first line of each file: by place, not by what it says."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__s"), F.monotonically_increasing_id().alias("__i"))
    first = lines.where("__s = 0").groupBy("__f").agg(F.min("__i").alias("__i"))
    return lines.join(F.broadcast(first), ["__f", "__i"], "left_anti").select("value")  # one row a file


def shape_of(lines: DataFrame, width: int, delimiter: str) -> tuple[bool, bool]:
    """(whether any line has another number of fields, whether any quotation runs over a line's end), from all lines."""
    bare = F.regexp_replace("value", '"(?:[^"]|"")*"', "")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
    r = lines.where(F.trim("value") != "").agg(F.coalesce(F.bool_or((fields != width) & (quotes % 2 == 0)), F.lit(False)).alias("ragged"), F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)).alias("open")).first()
    return r["ragged"], r["open"]


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, repair: bool = True) -> DataFrame:
    """A CSV file with promoted types; ragged files are repaired row by row.

    The whole file decides whether it is ragged and whether quoted fields hold line breaks; its head gives the delimiter
    and the classes of its columns. Files whose quotations run over line ends are read as they are: their rows cannot be
    told apart line by line.
    """
    text = head_of(path).decode("utf-8-sig", "replace")
    lines = text.splitlines()
    whole = lines[:-1] if len(text) >= 65_536 and len(lines) > 1 else lines
    sep = delimiter or delimiter_of(text)
    body = without_headers(spark, path)
    ragged, open_ = shape_of(body, len(next(csv_lib.reader(whole[:1], delimiter=sep), [])), sep) if whole else (False, False)
    if repair and ragged and not open_:
        return promoted(repaired(body, row_profile(whole, sep)).drop("__repair"))
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep, multiLine=open_, escape='"', ignoreLeadingWhiteSpace=False)
    return promoted(df.select(*[nulled(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns]))
