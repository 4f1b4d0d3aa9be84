"""Checks of a merge: grain, fan-out, matches, values and history."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.fusion import history_violations
from weft.sources.readers import sha256_file


@dataclass
class Check:
    name: str
    passed: bool
    detail: str
    severity: str = "error"  # what a failure is: an error, or a warning


def null_counts(source: DataFrame, output: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(column, source_nulls, output_nulls) for source columns and their output names, a single pass over each side."""
    def counted(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"__{i}") for i, c in enumerate(cols)])
        return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(f"__{i}").alias(name)) for i, k in enumerate(columns)])).alias("x")).select("x.*")
    return counted(source, list(columns), "source_nulls").join(counted(output, list(columns.values()), "output_nulls"), "column")


def validate(source: DataFrame, output: DataFrame, aliases: list[str], columns: dict[str, str] | None = None, entities: DataFrame | None = None, history: DataFrame | None = None) -> list[Check]:
    """The checks that apply; every count comes from one aggregate over a side."""
    rows = source.count()
    made = [F.count("*").alias("n"), F.count_distinct("_record_id").alias("ids")] + [F.count_if(~F.col(f"_match_{a}")).alias(f"u_{a}") for a in aliases] + [F.count_if(F.col(f"_match_{a}").isNull()).alias(f"z_{a}") for a in aliases]
    got = output.agg(*made).first()
    checks = [Check("row_conservation", got["n"] == rows, f"{rows} rows in, {got['n']} out"), Check("no_fan_out", got["ids"] == got["n"], f"{got['ids']} distinct record ids in {got['n']} rows")]
    for a in aliases:
        checks.append(Check(f"unmatched_rows_retained:{a}", got[f"z_{a}"] == 0, f"{got[f'u_{a}']} rows without a match"))
    if columns:
        bad = [r["column"] for r in null_counts(source, output, columns).where("source_nulls != output_nulls").collect()]
        checks.append(Check("root_values_preserved", not bad, ", ".join(bad) or "all columns"))
    if entities is not None:
        e = entities.agg(F.count("*").alias("n"), F.count_distinct("node").alias("d"), F.count_if(F.col("entity_id").isNull()).alias("z")).first()
        checks.append(Check("entity_assignment", e["n"] == e["d"] and e["z"] == 0, f"{e['n']} records, {e['d']} distinct, {e['z']} unassigned"))
    if history is not None:
        n = history_violations(history).count()
        checks.append(Check("temporal_consistency", n == 0, f"{n} violations"))
    return checks


def join_checks(attachments: list[tuple[str, str, str, str]], parent_rows: dict[str, int], statistics: list[dict]) -> list[Check]:
    """Row invariance of each join whose flag the output has: (alias, kind, parent, child) against its counts."""
    by = {r["alias"]: r for r in statistics}
    out = []
    for alias, kind, parent, child in attachments:
        if alias in by:
            r = by[alias]
            before = parent_rows.get(parent, r["rows"])
            out.append(Check(f"join_row_invariance:{alias}", r["rows"] == before, f"{kind} {parent} <- {child}: {before} rows before, {r['rows']} after, {r['matched']} matched"))
    return out


def group_checks(group: str, assignment: DataFrame, entities: DataFrame, conflicts: int) -> list[Check]:
    """Every record of a group is in exactly one entity, every entity is in its table, and conflicts are on record."""
    e = assignment.agg(F.count("*").alias("n"), F.count_distinct("node").alias("d"), F.count_if(F.col("entity_id").isNull()).alias("z"), F.count_distinct("entity_id").alias("e")).first()
    rows = entities.count()
    return [Check(f"entity_assignment:{group}", e["n"] == e["d"] and e["z"] == 0 and rows == e["e"], f"{e['n']} records in {e['e']} entities, {e['z']} unassigned, {rows} entity rows"),
            Check(f"conflicts_recorded:{group}", True, f"{conflicts} conflicting values recorded with all candidates")]


def source_checks(sources: list[tuple[str, str, str, str]]) -> list[Check]:
    """The kept copy and, where it can still be read, the original of each (dataset, copy, original, SHA-256)."""
    out = []
    for name, copy, original, sha in sources:
        if sha and copy and os.path.isfile(copy):
            ok = sha256_file(copy) == sha
            out.append(Check(f"source_immutable:{name}", ok, "the kept copy is unchanged" if ok else "the kept copy was changed"))
        if sha and original and os.path.isfile(original):
            ok = sha256_file(original) == sha
            out.append(Check(f"original_untouched:{name}", ok, "the original is as it was read" if ok else "the original changed since it was read", "warning"))
    return out


def date_checks(parsed: dict[str, DataFrame], columns: dict[str, list[str]]) -> list[Check]:
    """Texts that should be dates and could not be read, one pass a dataset; the text stays in ``<column>_raw``."""
    out = []
    for d, cols in columns.items():
        if cols:
            bad = [F.count_if((F.trim(F.col(f"{c}_raw").cast("string")) != "") & F.col(c).isNull()).alias(c) for c in cols]
            got = parsed[d].agg(*bad).first()
            out += [Check(f"date_parse:{d}.{c}", got[c] == 0, f"{got[c]} values could not be read", "warning") for c in cols]
    return out


def quality_report(checks: list[Check], match_rates: dict[str, float], expected_rows: float, rows: int) -> dict:
    """Figures of a merge as a dictionary: integration coverage is the mean match rate."""
    return {"passed": all(c.passed or c.severity == "warning" for c in checks), "checks": [c.__dict__ for c in checks], "match_rates": match_rates,
            "integration_coverage": sum(match_rates.values()) / len(match_rates) if match_rates else 1.0, "rows": rows, "expected_rows": expected_rows}


def report_text(report: dict) -> str:
    lines = [f"Rows: {report['rows']} (expected {report['expected_rows']:.1f})", f"Integration coverage: {report['integration_coverage']:.1%}"]
    lines += [f"{'ok  ' if c['passed'] else 'FAIL'} {c['name']}: {c['detail']}" for c in report["checks"]]
    return "\n".join(lines) + "\n"
