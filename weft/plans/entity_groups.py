"""Entity groups of a merge: datasets that describe the same things are resolved, fused, and attached to the anchor's rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.similarity import name_level
from weft.functions.values import person_name, register_normalizer
from weft.operators import fusion
from weft.operators.clustering import stored
from weft.operators.joins import ROW
from weft.operators.profile import DatasetProfile
from weft.operators.resolution import MatchField, Resolution, resolve
from weft.plans.graph import components
from weft.plans.matching import Match
from weft.plans.names import NameAllocator, canonical_name, name_tokens, snake

#: Words in the names of columns that tell when a record changed, or when it came to be.
CHANGE_WORDS = ("updated", "modified", "last", "timestamp", "changed")
CREATION_WORDS = ("created", "signup", "joined", "registered", "since", "opened", "creation")
#: Meanings that are never fused as one attribute, and those that are no facts that change.
NOT_FUSED, NO_HISTORY = ("CURRENCY",), ("ID", "DATE", "DATETIME")


@dataclass
class GroupField:
    name: str
    semantic: str
    norm: str
    columns: dict[str, str]  # by dataset


@dataclass
class EntityGroup:
    id: str
    datasets: list[str]  # the anchor first
    fields: list[GroupField] = field(default_factory=list)

    @property
    def anchor(self) -> str:
        return self.datasets[0]


@dataclass
class Fused:
    """What became of a group: entities, who is in which, and what was decided about their values."""

    group: EntityGroup
    resolution: Resolution
    entities: DataFrame  # entity_id, _entity_*, the fused attributes
    assignment: DataFrame  # node, dataset, row, entity_id, confidence
    conflicts: DataFrame
    provenance: DataFrame
    history: DataFrame | None
    attributes: list[str]


def _person(c: Column) -> Column:
    """A person name's words of more than one letter in order, so that initials and order do not differ."""
    words = F.array_sort(F.filter(F.split(person_name(c), " "), lambda w: F.length(w) > 1))
    return F.nullif(F.array_join(words, " "), F.lit(""))


register_normalizer("person", _person)


def group_fields(datasets: list[str], matches: list[Match], profiles: dict[str, DatasetProfile]) -> list[GroupField]:
    """Canonical attributes of a group: columns that accepted matches connect, one of each dataset; amounts are not fused."""
    found = [m for m in matches if m.accepted and {x.split(".", 1)[0] for x in m.pair} <= set(datasets)]
    columns = sorted({x for m in found for x in m.pair})
    out = []
    for part in components(columns, [(m.left, m.right, m.score) for m in found]):
        by: dict[str, str] = {}
        for d, c in sorted((tuple(x.split(".", 1)) for x in part), key=lambda x: (datasets.index(x[0]), x[1])):
            by.setdefault(d, c)
        kinds = [profiles[d].columns[c].semantic for d, c in by.items()]
        kind = max(sorted(set(kinds)), key=kinds.count)
        if len(by) < 2 or kind in NOT_FUSED:
            continue
        best = max((m for m in found if m.left in part and m.right in part), key=lambda m: m.score)
        out.append(GroupField(canonical_name(list(by.items()), datasets), kind, best.norm, by))
    return sorted(out, key=lambda f: f.name)


def timestamp_column(p: DatasetProfile, words: tuple[str, ...]) -> str | None:
    return next((c.name for c in p.columns.values() if c.semantic in ("DATE", "DATETIME") and set(name_tokens(c.name)) & set(words)), None)


def _unified_variants(candidates: DataFrame, attributes: list[str]) -> DataFrame:
    """Candidates whose names are mutually compatible in an entity get the normal form of the most informative one."""
    names = candidates.where(F.col("attribute").isin(*attributes)) if attributes else candidates.where("false")
    distinct = names.groupBy("entity_id", "attribute", "norm").agg(F.min("value").alias("value"), F.min("priority").alias("priority"))
    several = distinct.groupBy("entity_id", "attribute").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    distinct = distinct.join(several, ["entity_id", "attribute"]).withColumn("person", person_name(F.col("value")))

    def unify(rows: pd.DataFrame) -> pd.DataFrame:
        values = list(rows["person"])
        same = all(name_level(a, b) in ("exact", "high", "medium") for i, a in enumerate(values) for b in values[i + 1:])
        best = max(zip(rows["norm"], rows["priority"]), key=lambda x: (len(x[0]), -x[1], x[0]))[0]
        return pd.DataFrame({"entity_id": rows["entity_id"], "attribute": rows["attribute"], "norm": rows["norm"], "__norm": best if same else rows["norm"]})
    told = distinct.groupBy("entity_id", "attribute").applyInPandas(unify, "entity_id string, attribute string, norm string, __norm string")
    return candidates.join(told, ["entity_id", "attribute", "norm"], "left").withColumn("norm", F.coalesce("__norm", "norm")).drop("__norm")


def fuse(group: EntityGroup, frames: dict[str, DataFrame], profiles: dict[str, DatasetProfile], totals: dict[str, dict[str, str]] | None = None, strategy: str = "majority_vote",
         merge_at: float = 0.5, review_at: float = 0.2, labels: DataFrame | None = None, priority: list[str] | None = None,
         calibration: DataFrame | None = None) -> Fused:
    """Resolve the records of a group's ``frames`` and fuse each entity's attributes.

    Shared attributes are candidates from all datasets; other columns of members but the anchor come along by themselves.
    ``totals`` names, by dataset, columns that are numbers at a coarser grain and the function they were made with:
    those add up (or average) over the members. Ties of a strategy go by ``priority`` (default: the group's order), then row.
    """
    order = group.datasets
    rid = lambda d: F.concat(F.lit(d + ":"), F.lpad(F.col(ROW).cast("string"), 12, "0"))
    records = None
    for d in order:
        one = frames[d].select(rid(d).alias("rid"), F.lit(d).alias("dataset"), F.col(ROW).alias("row"), *[F.col(f.columns[d]).cast("string").alias(f"f_{f.name}") for f in group.fields if d in f.columns])
        records = one if records is None else records.unionByName(one, allowMissingColumns=True)
    records = stored(records)
    fields = [MatchField(f"f_{f.name}", f.semantic, f.norm) for f in group.fields]  # names that clash with none of resolution's own
    found = resolve(records, fields, tuple(order), merge_at, review_at, labels=labels, prefix=f"{group.id}-", calibration=calibration)
    clusters = stored(found.entities)
    a, b = clusters.select(F.col("node").alias("a"), F.col("entity_id").alias("ea")), clusters.select(F.col("node").alias("b"), F.col("entity_id").alias("eb"))
    linked = found.pairs.where(F.col("p") >= merge_at).join(a, "a").join(b, "b").where("ea = eb")
    sure = linked.select(F.explode(F.array("a", "b")).alias("node"), "p").groupBy("node").agg(F.max("p").alias("link"))
    assignment = stored(clusters.join(records.select(F.col("rid").alias("node"), "dataset", "row"), "node").join(sure, "node", "left")
                        .select("node", "dataset", "row", "entity_id", "confidence", F.coalesce("link", F.lit(1.0)).alias("link")))

    names = NameAllocator()
    for c in frames[group.anchor].columns:
        names.allocate(c, "anchor")
    attributes = {names.allocate(f.name, "entity"): (f.semantic, f.norm, f.columns) for f in group.fields}
    sums: dict[str, tuple[str, str, str]] = {}
    for d in order[1:]:
        used = {f.columns[d] for f in group.fields if d in f.columns}
        for c in frames[d].columns:
            if c in used or c.startswith("_") or c.endswith("_raw"):
                continue
            if c in (totals or {}).get(d, {}):
                sums[names.allocate(snake(c), d)] = (d, c, totals[d][c])
            else:
                p = profiles[d].columns.get(c)
                attributes[names.allocate(snake(c), d)] = (p.semantic if p else "UNKNOWN", "basic", {d: c})
    change = {d: timestamp_column(profiles[d], CHANGE_WORDS) for d in order}
    dated = {d: change[d] or timestamp_column(profiles[d], CREATION_WORDS) for d in order}
    ranks = {d: i for i, d in enumerate([*(x for x in priority or [] if x in order), *(x for x in order if x not in (priority or []))])}

    def moment(d: str, c: str | None) -> Column:
        usable = c is not None and dict(frames[d].dtypes)[c] in ("date", "timestamp", "timestamp_ntz")
        return (F.col(c) if usable else F.lit(None)).cast("timestamp_ntz")
    members = None
    for d in order:
        one = frames[d].select(rid(d).alias("node"), F.lit(ranks[d]).alias("priority"), moment(d, change[d]).alias("ts"), moment(d, dated[d]).alias("dated"),
                               *[F.col(cols[d]).cast("string").alias(n) for n, (_, _, cols) in attributes.items() if d in cols], *[F.col(c).cast("double").alias(n) for n, (x, c, _) in sums.items() if x == d])
        members = one if members is None else members.unionByName(one, allowMissingColumns=True)
    members = stored(members.join(assignment.drop("confidence").withColumnRenamed("link", "confidence"), "node"))

    norms = {n: {"NAME": "person", "PHONE": "digits", "DATE": "basic", "DATETIME": "basic"}.get(kind, norm) for n, (kind, norm, _) in attributes.items()}
    values = fusion.candidate_values(members, {n: n for n in attributes}, norms)
    values = stored(_unified_variants(values, [n for n, (kind, _, _) in attributes.items() if kind == "NAME"]))
    accuracy = fusion.source_accuracy(values) if strategy == "source_accuracy_vote" else None
    table = fusion.entity_records(values, members, list(attributes), strategy, accuracy).drop("_entity_confidence")
    # Values travel as text; where all sources agree on another type they return to it.
    back = {}
    for n, (_, _, cols) in attributes.items():
        types = {dict(frames[d].dtypes)[c] for d, c in cols.items()}
        kind = types.pop() if len(types) == 1 else "string"
        if strategy != "keep_all" and kind != "string" and not kind.startswith(("array", "map", "struct")):
            back[n] = F.col(n).try_cast(kind)
    table = table.withColumns(back) if back else table
    if sums:
        more = members.groupBy("entity_id").agg(*[fusion.fused_number(f, F.col(n)).alias(n) for n, (_, _, f) in sums.items()])
        table = table.join(more, "entity_id", "left")
    table = stored(table.join(assignment.groupBy("entity_id").agg(F.first("confidence").alias("_entity_confidence")), "entity_id"))

    columns_of = F.create_map(*[F.lit(x) for n, (_, _, cols) in attributes.items() for d, c in cols.items() for x in (f"{n}|{d}", c)])
    provenance = fusion.cell_provenance(values, strategy, accuracy).withColumn("source_column", F.element_at(columns_of, F.concat_ws("|", "attribute", "source_dataset")))
    facts = [n for n, (kind, _, _) in attributes.items() if kind not in NO_HISTORY]
    history = None
    if any(dated.values()) and facts:
        known = values.where(F.col("attribute").isin(*facts)).join(members.select("entity_id", "dataset", "row", "dated"), ["entity_id", "dataset", "row"])
        moving = known.where("dated IS NOT NULL").groupBy("entity_id", "attribute").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo != hi").drop("lo", "hi")
        kinds = {d: "change" if change[d] else "creation" for d in order}
        history = fusion.history(known.join(moving, ["entity_id", "attribute"], "left_semi").select("entity_id", "attribute", "value", "norm", F.col("dated").alias("ts"), "priority", "dataset"))
        history = stored(history.withColumn("timestamp_kinds", F.transform("sources", lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), s))))
    return Fused(group, found, table, assignment, stored(fusion.conflicts(values, strategy, accuracy)), stored(provenance), history, [*attributes, *sums])


def attached(anchor: DataFrame, fused: Fused) -> DataFrame:
    """The anchor's rows, all of them and once each, with their entity's columns."""
    own = fused.assignment.where(F.col("dataset") == fused.group.anchor)
    clash = {c: f"{fused.group.id}_{c}" for c in fused.entities.columns if c != "entity_id" and c in anchor.columns}
    entities = fused.entities.withColumnsRenamed(clash)
    if "entity_id" not in anchor.columns:
        return fusion.attach_entities(anchor, own, entities, ROW)
    key = f"{fused.group.id}_entity_id"
    return fusion.attach_entities(anchor.withColumnRenamed("entity_id", "__kept"), own, entities, ROW).withColumnRenamed("entity_id", key).withColumnRenamed("__kept", "entity_id")


def group_statistics(fused: Fused) -> dict:
    """Counts of a group: records, entities, entities of several sources, duplicates within a dataset, links across, conflicts."""
    by = fused.assignment.groupBy("entity_id", "dataset").agg(F.count("*").alias("n"))
    e = by.groupBy("entity_id").agg(F.count("*").alias("sources"), F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("within"))
    r = e.agg(F.count("*").alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count_if(F.col("sources") > 1).alias("multi_source_entities"),
              F.coalesce(F.sum("within"), F.lit(0)).alias("within_dataset_duplicates")).first().asDict()
    return {"datasets": fused.group.datasets, "anchor": fused.group.anchor, **r, "cross_source_links": r["records"] - r["entities"] - r["within_dataset_duplicates"],
            "conflicts": fused.conflicts.count(), **{k: v for k, v in fused.resolution.statistics.items() if k != "records"}}
