"""Readers of the other formats: JSON documents and lines, Parquet, workbooks, SQLite, REST, JDBC; and ingestion."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import sqlite3
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.operators.joins import ROW
from weft.sources.csv import read_csv
from weft.sources.detect import dataset_id, detect_format

# -- JSON -------------------------------------------------------------------------------------------------------------------

LARGE_JSON = 256 << 20


def extract_records(payload) -> list[dict]:
    """Records in a JSON document: a list of objects; rows under a header row; the longest list inside an object; one object."""
    if isinstance(payload, list):
        if not payload:
            return []
        if all(isinstance(x, dict) for x in payload):
            return payload
        if all(isinstance(x, list) for x in payload) and all(isinstance(h, str) for h in payload[0]):
            return [dict(zip(payload[0], r)) for r in payload[1:]]
        raise ValueError("a list of scalars holds no records")
    if isinstance(payload, dict):
        lists = []

        def walk(x) -> None:
            for v in x.values():
                if isinstance(v, list) and v and all(isinstance(i, (dict, list)) for i in v):
                    lists.append(v)
                elif isinstance(v, dict):
                    walk(v)
        walk(payload)
        return extract_records(max(lists, key=len)) if lists else [payload]
    raise ValueError("a scalar holds no records")


def flatten_record(record: dict, prefix: str = "") -> dict:
    """Dotted names for nested objects; lists as JSON text."""
    out = {}
    for k, v in record.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= flatten_record(v, name + ".")
        else:
            out[name] = json.dumps(v, ensure_ascii=False) if isinstance(v, list) else v
    return out


def records_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """A DataFrame over the union of all keys; columns of mixed types become text."""
    rows = [flatten_record(r) for r in records]
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds: dict[str, T.DataType] = {}
    for n in names:
        seen = {type(r[n]) for r in rows if r.get(n) is not None}
        kinds[n] = T.BooleanType() if seen == {bool} else T.LongType() if seen == {int} else T.DoubleType() if seen and seen <= {int, float} else T.StringType()

    def cell(v, t: T.DataType):
        if v is None or isinstance(t, T.BooleanType) or isinstance(t, T.LongType):
            return v
        return float(v) if isinstance(t, T.DoubleType) else v if isinstance(v, str) else json.dumps(v)
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    return spark.createDataFrame([tuple(cell(r.get(n), kinds[n]) for n in names) for r in rows], schema)


def flattened(df: DataFrame) -> DataFrame:
    """Struct columns as dotted columns, recursively; arrays stay as they are."""
    cols: list[Column] = []

    def walk(schema: T.StructType, path: tuple[str, ...]) -> None:
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            else:
                cols.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))
    walk(df.schema, ())
    return df.select(*cols)


def longest_records(df: DataFrame) -> DataFrame:
    """Of a document read as one row, the longest list of objects in it as rows, or the row itself: what
    ``extract_records`` does, told by the schema."""
    found: list[tuple[str, ...]] = []

    def walk(schema: T.StructType, path: tuple[str, ...]) -> None:
        for f in schema.fields:
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                found.append((*path, f.name))
            elif isinstance(f.dataType, T.StructType):
                walk(f.dataType, (*path, f.name))
    walk(df.schema, ())
    if not found:
        return df
    columns = [F.col(".".join(f"`{p}`" for p in x)) for x in found]
    if df.limit(2).count() > 1:  # a list of objects already
        return df
    sizes = df.select(*[F.coalesce(F.size(c), F.lit(0)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    best = max(range(len(found)), key=lambda i: (sizes[i], -i))
    return df.select(F.explode(columns[best]).alias("r")).select("r.*") if sizes[best] > 0 else df


def listed_as_text(df: DataFrame) -> DataFrame:
    """Lists and maps as JSON text, as ``flatten_record`` gives them."""
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON lines and large documents through the distributed reader; smaller documents by their records.

    Both ways find the same records: a list of objects, or the longest such list inside an object.
    """
    if lines:
        return flattened(spark.read.json(path))
    if os.path.exists(path) and os.path.getsize(path) <= LARGE_JSON:
        with open(path, encoding="utf-8-sig") as f:
            return records_frame(spark, extract_records(json.load(f)))
    return listed_as_text(flattened(longest_records(spark.read.option("multiLine", True).json(path))))


# -- workbooks, SQLite, REST as Python data sources -------------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def workbook_sheets(path: str) -> dict[str, str]:
    """Sheet names and their parts in a workbook, in order."""
    with zipfile.ZipFile(path) as z:
        rels = {e.get("Id"): e.get("Target") for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        return {s.get("name"): "xl/" + rels[s.get(f"{{{_NS['r']}}}id")].lstrip("/").removeprefix("xl/") for s in book.iterfind("m:sheets/m:sheet", _NS)}


def workbook_rows(path: str, sheet: str | None = None) -> list[list]:
    """Cells of the named sheet, or of the first that is not empty."""
    sheets = workbook_sheets(path)
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        for name, part in sheets.items():
            if sheet is not None and name != sheet:
                continue
            rows = []
            for r in ET.fromstring(z.read(part)).iter(f"{{{_NS['m']}}}row"):
                cells: dict[int, object] = {}
                for i, c in enumerate(r.iterfind("m:c", _NS)):
                    letters = re.match(r"[A-Z]*", c.get("r") or "").group()
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else i
                    v, kind = c.find("m:v", _NS), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif v is not None and v.text is not None:
                        cells[at] = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "e") else v.text == "1" if kind == "b" else float(v.text)
                if cells:
                    rows.append([cells.get(i) for i in range(max(cells) + 1)])
            if rows:
                return rows
    return []


class WorkbookSource(DataSource):
    """``spark.read.format("weft_xlsx").option("path", …)``; option ``sheet``."""

    @classmethod
    def name(cls) -> str:
        return "weft_xlsx"

    def _table(self) -> tuple[list[str], list[list]]:
        rows = workbook_rows(self.options["path"], self.options.get("sheet"))
        if not rows:
            return [], []
        header = [str(h).strip() if h is not None else f"column_{i + 1}" for i, h in enumerate(rows[0])]
        return header, [[*r, *[None] * (len(header) - len(r))][:len(header)] for r in rows[1:]]

    def schema(self) -> T.StructType:
        header, rows = self._table()
        fields = []
        for i, h in enumerate(header):
            seen = {type(r[i]) for r in rows if r[i] is not None}
            whole = seen == {float} and all(r[i] == int(r[i]) for r in rows if r[i] is not None)
            fields.append(T.StructField(h, T.LongType() if whole else T.DoubleType() if seen == {float} else T.BooleanType() if seen == {bool} else T.StringType()))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        source = self

        class Reader(DataSourceReader):
            def read(self, partition) -> Iterator[tuple]:
                for r in source._table()[1]:
                    yield tuple(None if v is None else int(v) if isinstance(f.dataType, T.LongType) else str(v) if isinstance(f.dataType, T.StringType) else v for v, f in zip(r, schema.fields))
        return Reader()


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


@dataclass
class RowRange(InputPartition):
    low: int
    high: int


class SqliteSource(DataSource):
    """``spark.read.format("weft_sqlite").option("path", …)``; option ``table`` (default: the first). Read by row-id ranges."""

    @classmethod
    def name(cls) -> str:
        return "weft_sqlite"

    def _target(self) -> str:
        return self.options.get("table") or sqlite_tables(self.options["path"])[0]

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            table = self._target().replace('"', '""')
            names = [r[1] for r in db.execute(f'PRAGMA table_info("{table}")')]
            kinds = []
            for n in names:
                q = n.replace('"', '""')
                seen = {r[0] for r in db.execute(f'SELECT DISTINCT typeof("{q}") FROM "{table}"')} - {"null"}
                kinds.append(T.LongType() if seen == {"integer"} else T.DoubleType() if seen and seen <= {"integer", "real"} else T.StringType())
        return T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        path, table, step = self.options["path"], self._target().replace('"', '""'), int(self.options.get("rows_per_partition", "50000"))

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    n = db.execute(f'SELECT count(*) FROM "{table}"').fetchone()[0]
                return [RowRange(i, min(i + step, n)) for i in range(0, n, step)] or [RowRange(0, 0)]

            def read(self, partition: RowRange) -> Iterator[tuple]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    for r in db.execute(f'SELECT * FROM "{table}" LIMIT ? OFFSET ?', (partition.high - partition.low, partition.low)):
                        yield tuple(None if v is None else float(v) if isinstance(f.dataType, T.DoubleType) else v if isinstance(f.dataType, T.LongType) or isinstance(v, str) else str(v) for v, f in zip(r, schema.fields))
        return Reader()


def fetch_pages(url: str, params: dict[str, str] | None = None, page_size: int = 1000, max_pages: int = 100, get: Callable[[str], bytes] | None = None) -> list[dict]:
    """Records of a paged REST endpoint: ``$limit`` and ``$offset`` until a short page; more than ``max_pages`` is an error."""
    get = get or (lambda u: urllib.request.urlopen(u, timeout=60).read())
    out: list[dict] = []
    for page in range(max_pages):
        query = urllib.parse.urlencode({**(params or {}), "$limit": page_size, "$offset": page * page_size})
        got = extract_records(json.loads(get(f"{url}{'&' if '?' in url else '?'}{query}")) or [])
        out += got
        if len(got) < page_size:
            return out
    raise ValueError(f"{url} has more than {max_pages} pages of {page_size}; raise max_pages")


def read_rest(spark: SparkSession, url: str, params: dict[str, str] | None = None, page_size: int = 1000, max_pages: int = 100, get: Callable[[str], bytes] | None = None) -> DataFrame:
    return records_frame(spark, fetch_pages(url, params, page_size, max_pages, get))


def read_postgres(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A read-only query over JDBC; the session is set read-only before it runs."""
    if not re.match(r"(?is)^\s*(select|with)\b", query):
        raise ValueError("only SELECT queries are read")
    return spark.read.format("jdbc").options(url=url, query=query.rstrip("; \n"), sessionInitStatement="SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY", **options).load()


# -- ingestion ----------------------------------------------------------------------------------------------------------------


@dataclass
class Dataset:
    """A named immutable table: its Parquet copy with dense ``__row``, where it came from and its checksum."""

    id: str
    source: str
    format: str
    path: str
    rows: int = 0
    sha256: str = ""
    columns: list[str] = field(default_factory=list)
    copy: str = ""  # the kept copy of the original, where that is a file

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def sha256_file(path: str, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            digest.update(block)
    return digest.hexdigest()


@dataclass
class Workspace:
    """Folders raw, processed, merges and exports under one root; without a root nothing can be kept."""

    root: str | None

    def base(self) -> str:
        if self.root is None:
            raise ValueError("a session on a cluster needs a root folder that all executors share to keep files in")
        return self.root

    def folder(self, kind: str, *parts: str) -> str:
        path = os.path.join(self.base(), kind, *parts)
        os.makedirs(os.path.dirname(path) if parts else path, exist_ok=True)
        return path

    def preserve(self, path: str, name: str) -> tuple[str, str]:
        """A read-only copy of an original and its checksum."""
        copy = self.folder("raw", f"{name}{os.path.splitext(path)[1]}")
        shutil.copyfile(path, copy)
        os.chmod(copy, 0o444)
        return copy, sha256_file(copy)

    def remove(self) -> None:
        if self.root is not None:
            shutil.rmtree(self.root, ignore_errors=True)


def read_any(spark: SparkSession, path: str, kind: str | None = None, **options: str) -> DataFrame:
    kind = kind or detect_format(path)
    if kind == "csv":
        return read_csv(spark, path, options.get("delimiter"))
    if kind in ("json", "jsonl"):
        return read_json(spark, path, kind == "jsonl")
    if kind == "parquet":
        return spark.read.parquet(path)
    source = {"xlsx": WorkbookSource, "sqlite": SqliteSource}[kind]
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(path=path, **options).load()


def numbered(df: DataFrame) -> DataFrame:
    """Dense 0-based ``__row`` in file order: each partition's rows start after those of the partitions before it."""
    placed = df.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    counts = placed.groupBy("__part").agg(F.count("*").alias("__c"), F.min("__at").alias("__first"))
    from pyspark.sql import Window
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    skips = counts.select("__part", "__first", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__skip"))
    out = placed.join(F.broadcast(skips), "__part")  # one row a partition
    return out.withColumn(ROW, (F.col("__at") - F.col("__first") + F.col("__skip")).cast("long")).drop("__part", "__at", "__first", "__skip")


def ingest(spark: SparkSession, workspace: Workspace, path: str, name: str | None = None, existing: set[str] = frozenset(), kind: str | None = None, **options: str) -> Dataset:
    """Reads a file of any format, keeps the original, and writes the normalised table with row numbers."""
    kind = kind or detect_format(path)
    id_ = dataset_id(name or path, set(existing))
    copy = digest = ""
    if os.path.isfile(path):
        copy, digest = workspace.preserve(path, id_)
    df = read_any(spark, path, kind, **options)
    target = workspace.folder("processed", id_)
    numbered(df).write.mode("overwrite").option("compression", "zstd").parquet(target)
    done = spark.read.parquet(target)
    return Dataset(id_, path, kind, target, done.count(), digest, [c for c in done.columns if c != ROW], copy)
