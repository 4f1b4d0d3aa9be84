"""What a merge leaves behind: unified table, entities, history, provenance, conflicts and reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_unified(df: DataFrame, folder: str, csv: bool = False) -> DataFrame:
    """``unified_dataset.parquet`` (and ``.csv``); returns the table read back, so that later uses start from the file."""
    path = os.path.join(folder, "unified_dataset.parquet")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if csv:
        flat = back.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in back.dtypes])
        flat.write.mode("overwrite").csv(os.path.join(folder, "unified_dataset.csv"), header=True)
    return back


def json_ready(df: DataFrame) -> DataFrame:
    """Cells that JSON can hold: dates and moments as ISO text, numbers that are none as null, nested values as JSON text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("float", "double"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        out.append(c.alias(name))
    return df.select(*out)


def write_entities(df: DataFrame, folder: str, group: str) -> None:
    df.write.mode("overwrite").parquet(os.path.join(folder, f"entities_{group}.parquet"))


def write_history(df: DataFrame, folder: str, group: str, recorded_at) -> None:
    df.withColumn("recorded_at", F.lit(recorded_at)).write.mode("overwrite").parquet(os.path.join(folder, f"entity_history_{group}.parquet"))


def write_cell_provenance(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").parquet(os.path.join(folder, "cell_provenance.parquet"))


def write_conflicts(df: DataFrame, folder: str) -> None:
    """One CSV row for each candidate of each conflict."""
    rows = df.select("entity_id", "attribute", "resolved", "strategy", "status", "n_values", F.explode("candidates").alias("c"))
    rows.select("entity_id", "attribute", "c.value", "c.norm", "c.dataset", "c.row", "c.ts", "c.confidence", "c.priority", "resolved", "strategy", "status").write.mode("overwrite").csv(os.path.join(folder, "conflicts.csv"), header=True)


def write_reports(folder: str, **documents: object) -> None:
    """JSON documents by name, and text as it is."""
    os.makedirs(folder, exist_ok=True)
    for name, doc in documents.items():
        text = isinstance(doc, str)
        with open(os.path.join(folder, f"{name}.{'txt' if text else 'json'}"), "w", encoding="utf-8") as f:
            f.write(doc if text else json.dumps(doc, indent=2, default=str))
