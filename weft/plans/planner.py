"""Merge plans: effective thresholds, root, tree, transforms, steps; and their execution as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft import config
from weft.functions.values import currency_amount, currency_code, parse_date, parse_timestamp, to_base
from weft.operators.joins import ROW, Aggregate, aggregate_lookup, final_columns, lookup
from weft.operators.profile import ColumnProfile, DatasetProfile
from weft.plans.entity_groups import EntityGroup, Fused, attached, fuse, group_fields
from weft.plans.graph import components, spanning_forest
from weft.plans.names import NameAllocator, name_tokens, role_of, snake
from weft.plans.relationships import AGGREGATE, KEY_MERGE, LOOKUP, RESOLUTION, Relationship


def effective_thresholds(mode: str = "balanced", **overrides: float) -> dict[str, float]:
    return {**config.DEFAULTS["modes"][mode], **{k: v for k, v in overrides.items() if v is not None}}


@dataclass(frozen=True)
class Transform:
    column: str
    kind: str  # parse_date, parse_timestamp, parse_currency, convert_currency
    dayfirst: bool = False
    code_column: str | None = None


def plan_transforms(p: DatasetProfile) -> list[Transform]:
    """Dates and amounts stored as text are parsed; numeric amounts beside a currency column are converted."""
    code = next((c.name for c in p.columns.values() if c.semantic == "CURRENCY_CODE"), None)
    out = []
    for c in p.columns.values():
        if c.logical == "string" and c.semantic in ("DATE", "DATETIME"):
            out.append(Transform(c.name, "parse_timestamp" if any(":" in v for v in c.top) else "parse_date", c.dayfirst))
        elif c.logical == "string" and c.semantic == "CURRENCY":
            out.append(Transform(c.name, "parse_currency", code_column=code))
        elif c.semantic == "CURRENCY" and c.logical in ("integer", "float") and code:
            out.append(Transform(c.name, "convert_currency", code_column=code))
    return out


def apply_transforms(df: DataFrame, transforms: list[Transform], base: str = "USD") -> DataFrame:
    """The transformed columns in place, with the original as ``<column>_raw``."""
    made = {}
    for t in transforms:
        c = F.col(t.column)
        made[f"{t.column}_raw"] = c
        code = F.col(t.code_column) if t.code_column else None
        if t.kind == "parse_date":
            made[t.column] = parse_date(c, t.dayfirst)
        elif t.kind == "parse_timestamp":
            made[t.column] = parse_timestamp(c, t.dayfirst)
        elif t.kind == "parse_currency":
            made[t.column] = to_base(currency_amount(c), currency_code(c, code if code is not None else F.lit(base)), base)
            made[f"{t.column}_currency"] = currency_code(c, code)
        elif t.kind == "convert_currency":
            made[t.column] = to_base(c.cast("double"), code, base)
    return df.withColumns(made) if made else df


#: Words in column names that say how numbers add up; a name with words of both kinds averages.
AVG_WORDS = ("median", "mean", "average", "rate", "percent", "ratio", "income", "per", "share", "index", "age")
SUM_WORDS = ("count", "total", "population", "number", "sum", "amount", "spent", "quantity", "fare", "tip", "revenue", "units", "trips")


def aggregate_function(name: str, logical: str, semantic: str) -> str | None:
    """How a column is aggregated to a key: by its type, meaning and name; None for text that cannot be."""
    words = set(name_tokens(name))
    if logical in ("integer", "float"):
        if semantic == "ID":
            return "count_distinct"
        if words & set(AVG_WORDS):
            return "avg"
        return "sum" if words & set(SUM_WORDS) or semantic == "CURRENCY" else "avg"
    if logical in ("date", "datetime"):
        return "max"
    return "mode" if semantic in ("CATEGORY", "CITY", "COUNTRY", "CURRENCY_CODE") else None


@dataclass
class Attachment:
    parent: str
    child: str
    kind: str
    parent_key: str
    child_key: str
    alias: str
    confidence: float
    norm: str


@dataclass
class MergePlan:
    root: str
    attachments: list[Attachment]
    transforms: dict[str, list[Transform]]
    entity_groups: list[EntityGroup] = field(default_factory=list)
    excluded: list[tuple[str, str]] = field(default_factory=list)
    unreached: list[str] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def datasets(self) -> set[str]:
        return {self.root, *[a.child for a in self.attachments], *[d for g in self.entity_groups for d in g.datasets]}

    def steps(self) -> list[str]:
        out = [f"Start from {self.root}, whose rows are all kept"]
        out += [f"{d}: {t.kind} of {t.column}" for d, ts in self.transforms.items() for t in ts]
        out += [f"{'Look up' if a.kind == LOOKUP else 'Aggregate and look up'} {a.child} as {a.alias} by {a.parent_key} = {a.child_key}" for a in self.attachments]
        out += [f"Resolve entities of {', '.join(x.datasets)} by {', '.join(f.name for f in x.fields)}, and attach them to {x.anchor}" for x in self.entity_groups]
        out += [f"Left out {a} - {b}: closes a cycle" for a, b in self.excluded]
        return out


def choose_root(component: list[str], tree: list[Relationship], profiles: dict[str, DatasetProfile], primary: str | None = None) -> str:
    """The dataset that keeps most others without aggregation, is no mere dimension, and has most rows."""
    if primary in component:
        return primary
    def kept(root: str) -> int:
        seen, stack = {root}, [root]
        while stack:
            d = stack.pop()
            for r in tree:
                if r.kind in (LOOKUP, KEY_MERGE) and r.left == d and r.right not in seen:
                    seen.add(r.right)
                    stack.append(r.right)
        return len(seen)
    dimensions = {r.right for r in tree if r.kind == LOOKUP} - {r.left for r in tree if r.kind == LOOKUP}
    return max(component, key=lambda d: (kept(d), d not in dimensions, profiles[d].rows, d))


def build_plan(profiles: list[DatasetProfile], relations: list[Relationship], mode: str = "balanced", primary: str | None = None, **overrides: float) -> MergePlan:
    """A plan for the largest connected group of datasets: a maximum spanning tree, oriented away from the root."""
    limits = effective_thresholds(mode, **overrides)
    by_name = {p.dataset: p for p in profiles}
    usable = [r for r in relations if r.confidence >= limits["min_edge"]]
    strength = {}
    for r in usable:
        k = tuple(sorted((r.left, r.right)))
        if k not in strength or r.confidence > strength[k].confidence:
            strength[k] = r
    kept, dropped = spanning_forest([(a, b, r.confidence) for (a, b), r in strength.items()])
    groups = components([p.dataset for p in profiles], kept)
    group = max(groups, key=lambda g: (primary in g if primary else False, len(g), sum(by_name[d].rows for d in g), g))
    tree = [strength[tuple(sorted((a, b)))] for a, b, _ in kept if a in group]
    root = choose_root(group, tree, by_name, primary)
    attachments, entities, done, queue, names = [], [], {root}, [root], NameAllocator()
    while queue:
        d = queue.pop(0)
        for r in tree:
            if d not in (r.left, r.right):
                continue
            other = r.right if r.left == d else r.left
            if other in done:
                continue
            done.add(other)
            queue.append(other)
            if r.kind == RESOLUTION:
                group = next((x for x in entities if d in x.datasets), None)
                if group is None:
                    group = EntityGroup(f"G{len(entities) + 1}", [d])
                    entities.append(group)
                group.datasets.append(other)
                continue
            forward = r.left == d
            for ref, key in r.keys if r.kind == LOOKUP and forward else r.keys[:1]:
                role = role_of(ref, key) if len(r.keys) > 1 else None
                alias = names.allocate(role or snake(other), snake(d))
                kind = LOOKUP if (r.kind == LOOKUP and forward) or r.kind == KEY_MERGE else AGGREGATE
                pk, ck = (ref, key) if forward else (key, ref)
                attachments.append(Attachment(d, other, kind, pk, ck, alias, r.confidence, r.norm))
    matches = [m for r in relations for m in r.matches]
    for x in entities:
        x.fields = group_fields(x.datasets, matches, by_name)
    return MergePlan(root, attachments, {p.dataset: t for p in profiles if (t := plan_transforms(p))}, entities, [(a, b) for a, b, _ in dropped],
                     [p.dataset for p in profiles if p.dataset not in done], limits)


def aggregates_for(columns: list[ColumnProfile], key: str, alias: str) -> list[Aggregate]:
    out = []
    for c in columns:
        f = aggregate_function(c.name, c.logical, c.semantic)
        if c.name != key and f:
            out.append(Aggregate(c.name, f, f"{alias}_{snake(c.name)}_{f}", through=True))
    return out


@dataclass
class Executed:
    unified: DataFrame
    groups: dict[str, Fused]
    ready: dict[str, DataFrame]  # the datasets after their transforms


def execute(plan: MergePlan, tables: dict[str, DataFrame], profiles: dict[str, DatasetProfile]) -> DataFrame:
    """The unified table of a plan; see ``executed``."""
    return executed(plan, tables, profiles).unified


def executed(plan: MergePlan, tables: dict[str, DataFrame], profiles: dict[str, DatasetProfile], strategy: str = "majority_vote", labels: DataFrame | None = None,
             priority: list[str] | None = None, calibration: DataFrame | None = None) -> Executed:
    """A plan carried out: the unified table as one DataFrame, whose nested lookups are built once, from the leaves to the
    root, and the entity groups, each resolved and fused where its anchor is built."""
    ready = {d: apply_transforms(t, plan.transforms.get(d, [])) for d, t in tables.items()}
    raw = {d: {t.column for t in plan.transforms.get(d, [])} for d in tables}
    groups: dict[str, Fused] = {}

    def key_of(d: str, c: str) -> str:
        return f"{c}_raw" if c in raw.get(d, set()) else c

    def built(d: str) -> DataFrame:
        df = ready[d]
        for a in (a for a in plan.attachments if a.parent == d):
            norm = None if a.norm in ("basic", "identity") and dict(df.dtypes).get(a.parent_key, "") == dict(tables[a.child].dtypes).get(a.child_key, "") != "string" else a.norm
            if a.kind == LOOKUP:
                child = built(a.child)
                nested = {c: f"{a.alias}_{snake(c)}" if not c.startswith("_") else (f"{c}" if c.startswith(("_match_", "_src_")) else f"{a.alias}{c}") for c in child.columns if c != ROW}
                df = lookup(df, child, key_of(d, a.parent_key), key_of(a.child, a.child_key), a.alias, nested, norm)
            else:
                p = profiles[a.child]
                df = aggregate_lookup(df, ready[a.child], key_of(d, a.parent_key), key_of(a.child, a.child_key), a.alias, aggregates_for(list(p.columns.values()), a.child_key, a.alias), norm)
        for x in (x for x in plan.entity_groups if x.anchor == d and x.fields):
            frames = {d: df} | {m: built(m) for m in x.datasets[1:]}
            groups[x.id] = fuse(x, frames, profiles, {m: totals_of(plan, m, profiles) for m in x.datasets}, strategy, plan.thresholds.get("entity_merge", 0.5),
                                plan.thresholds.get("entity_review", 0.2), labels, priority, calibration)
            df = attached(df, groups[x.id])
        return df
    out = built(plan.root)
    confidences = {a.alias: a.confidence for a in plan.attachments if f"_match_{a.alias}" in out.columns}
    linked = [c for c in out.columns if c.endswith("_entity_confidence")]
    return Executed(final_columns(out, plan.root, confidences, linked), groups, ready)


def totals_of(plan: MergePlan, dataset: str, profiles: dict[str, DatasetProfile]) -> dict[str, str]:
    """Columns that aggregate lookups add to a dataset, and the function that adds them up over an entity."""
    out = {}
    for a in plan.attachments:
        if a.parent == dataset and a.kind != LOOKUP:
            out[f"{a.alias}_record_count"] = "count"
            for g in aggregates_for(list(profiles[a.child].columns.values()), a.child_key, a.alias):
                if g.function in ("sum", "avg", "count", "count_distinct"):
                    out[g.name] = g.function
    return out


def relationship_flags(plan: MergePlan, columns: list[str]) -> dict[str, str]:
    """By alias the match flag that marks rows which depend on the relationship: a scenario leaves those out."""
    return {a.alias: f"_match_{a.alias}" for a in plan.attachments if f"_match_{a.alias}" in columns}
