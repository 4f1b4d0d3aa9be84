"""Lineage of a plan's columns and steps, as rows, as PROV-JSON and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weft.operators.joins import ROW
from weft.plans.names import snake
from weft.plans.planner import MergePlan
from weft.plans.relationships import LOOKUP


def column_lineage(plan: MergePlan, frames: dict[str, DataFrame]) -> list[dict]:
    """Where each output column comes from: dataset, column, by which attachment, under which transform."""
    out = []
    transforms = {(d, t.column): t.kind for d, ts in plan.transforms.items() for t in ts}

    def walk(d: str, prefix: str, via: list[str]) -> None:
        for c in frames[d].columns:
            if c != ROW:
                name = f"{prefix}_{snake(c)}" if prefix else c
                out.append({"output": name, "dataset": d, "column": c, "via": " -> ".join(via) or "root", "transform": transforms.get((d, c), "")})
        for a in plan.attachments:
            if a.parent == d and a.kind == LOOKUP:
                walk(a.child, f"{prefix}_{a.alias}" if prefix else a.alias, [*via, f"{a.parent_key} = {a.child_key}"])
            elif a.parent == d:
                out.append({"output": f"{a.alias}_record_count", "dataset": a.child, "column": "*", "via": " -> ".join([*via, f"{a.parent_key} = {a.child_key}"]), "transform": "count"})
    walk(plan.root, "", [])
    return out


def prov_document(plan: MergePlan, merge_id: str, rows: int) -> dict:
    """A W3C PROV-JSON document: datasets and the output are entities, the merge and its steps activities."""
    used = sorted({plan.root, *[a.child for a in plan.attachments]})
    return {"prefix": {"weft": "urn:weft:"},
            "entity": {**{f"weft:{d}": {"prov:type": "dataset"} for d in used}, f"weft:{merge_id}": {"prov:type": "unified", "rows": rows}},
            "activity": {f"weft:{merge_id}/merge": {"steps": plan.steps()}},
            "used": {f"_:u{i}": {"prov:activity": f"weft:{merge_id}/merge", "prov:entity": f"weft:{d}"} for i, d in enumerate(used)},
            "wasGeneratedBy": {"_:g0": {"prov:entity": f"weft:{merge_id}", "prov:activity": f"weft:{merge_id}/merge"}},
            "wasDerivedFrom": {f"_:d{i}": {"prov:generatedEntity": f"weft:{merge_id}", "prov:usedEntity": f"weft:{d}"} for i, d in enumerate(used)}}


def report(plan: MergePlan, frames: dict[str, DataFrame]) -> str:
    lines = [*plan.steps(), ""]
    lines += [f"{r['output']} <- {r['dataset']}.{r['column']} ({r['via']}{', ' + r['transform'] if r['transform'] else ''})" for r in column_lineage(plan, frames)]
    return "\n".join(lines) + "\n"
