"""Format detection by content, then by extension."""

from __future__ import annotations

import csv
import json
import os
import re
import zipfile

FORMATS = ("csv", "json", "jsonl", "parquet", "xlsx", "sqlite", "postgres", "rest")
EXTENSIONS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".pq": "parquet", ".xlsx": "xlsx",
              ".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite"}
DELIMITERS = (",", "\t", ";", "|")


class UnsupportedFormat(ValueError):
    """The content fits no known format."""


def head_of(path: str, n: int = 65_536) -> bytes:
    with open(path, "rb") as f:
        return f.read(n)


def is_binary(head: bytes) -> bool:
    if b"\0" in head:
        return True
    control = sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in head)
    return bool(head) and control / len(head) > 0.05


def looks_delimited(text: str) -> bool:
    lines = [x for x in text.splitlines()[:20] if x.strip()]
    return len(lines) > 1 and any(lines[0].count(d) and lines[1].count(d) for d in DELIMITERS)


def probe_json(text: str) -> str | None:
    """jsonl for a JSON object on each line, json for one document (perhaps cut off), None for neither."""
    stripped = text.lstrip("﻿ \t\r\n")
    if not stripped or stripped[0] not in "[{":
        return None
    lines = [x for x in stripped.splitlines() if x.strip()]
    if stripped[0] == "{" and len(lines) > 1:
        try:
            return "jsonl" if all(isinstance(json.loads(x), dict) for x in lines[:2]) else "json"
        except ValueError:
            pass
    if re.match(r'^\{\s*("|\})|^\[\s*[\[\]{"0-9tfn-]', stripped):
        return "json"
    return None


def detect_format(path: str, probe: int = 65_536) -> str:
    """Magic bytes, then a veto of unknown binary content, then JSON, then delimiters, then the extension."""
    head = head_of(path, probe)
    if head.startswith(b"PAR1"):
        return "parquet"
    if head.startswith(b"SQLite format 3\0"):
        return "sqlite"
    extension = os.path.splitext(path)[1].lower()
    if head.startswith(b"PK\3\4"):
        if extension == ".xlsx" or (zipfile.is_zipfile(path) and "xl/workbook.xml" in zipfile.ZipFile(path).namelist()):
            return "xlsx"
        raise UnsupportedFormat(f"{path}: a zip archive that is no workbook")
    if is_binary(head):
        raise UnsupportedFormat(f"{path}: unknown binary content")
    text = head.decode("utf-8", "replace")
    found = probe_json(text)
    if found == "json" and extension in (".jsonl", ".ndjson") and len(text.splitlines()) <= 1:
        return "jsonl"
    if found:
        return found
    if looks_delimited(text):
        return "csv"
    if extension in EXTENSIONS:
        return EXTENSIONS[extension]
    raise UnsupportedFormat(f"{path}: no known format")


def delimiter_of(text: str) -> str:
    """The delimiter on which most lines agree with the header about the number of fields."""
    lines = [x for x in text.splitlines()[:200] if x.strip()]
    if not lines:
        return ","
    def score(d: str) -> tuple[int, int]:
        rows = list(csv.reader(lines, delimiter=d))
        width = len(rows[0])
        return (sum(len(r) == width for r in rows) if width > 1 else 0, width)
    return max(DELIMITERS, key=score)


def dataset_id(name: str, existing: set[str] = frozenset()) -> str:
    """A slug of the file's stem; ``_2``, ``_3`` on a clash."""
    stem = os.path.splitext(os.path.basename(name.rstrip("/")))[0]
    slug = re.sub(r"[^a-z0-9]+", "_", stem.lower()).strip("_") or "dataset"
    if slug[0].isdigit():
        slug = f"d_{slug}"
    out, i = slug, 2
    while out in existing:
        out, i = f"{slug}_{i}", i + 1
    return out
