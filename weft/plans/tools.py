"""The session as named operations with checked arguments, and rules that read a request in plain words.

Each tool has a JSON schema, so that any model that can call functions can drive a session; ``read`` needs no model.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.fusion import STRATEGIES
from weft.operators.joins import match_statistics
from weft.operators.profile import issues
from weft.operators.resolution import MatchField
from weft.plans import lineage
from weft.plans.entity_groups import group_fields
from weft.plans.session import Session
from weft.sources.sinks import json_ready

MODES = ("strict", "balanced", "permissive")
_TEXT, _DATASET = {"type": "string"}, {"type": "string", "description": "a loaded dataset"}


class BadArguments(ValueError):
    pass


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    run: Callable[..., Any]
    properties: dict[str, dict]
    required: tuple[str, ...] = ()
    changes: bool = False

    @property
    def schema(self) -> dict:
        return {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": self.properties, "required": list(self.required), "additionalProperties": False}}


TOOLS: dict[str, Tool] = {}


def tool(description: str, required: tuple[str, ...] = (), changes: bool = False, **properties: dict):
    def add(f: Callable[..., Any]) -> Callable[..., Any]:
        TOOLS[f.__name__] = Tool(f.__name__, description, f, properties, required, changes)
        return f
    return add


def _limit(most: int) -> dict:
    return {"type": "integer", "minimum": 1, "maximum": most}


def _one_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


_PREFERENCES = {"mode": _one_of(*MODES), "conflict_strategy": _one_of(*STRATEGIES), "confidence_threshold": {"type": "number", "minimum": 0, "maximum": 100}, "primary_key": _TEXT,
                "merge_uncertain": {"type": "boolean"}, "source_priority": {"type": "array", "items": _TEXT}}


def _rows(df: DataFrame, limit: int) -> list[dict]:
    return [r.asDict() for r in json_ready(df.limit(limit)).collect()]


@tool("The loaded datasets with size and format.")
def list_datasets(s: Session) -> list[dict]:
    return [{"dataset": d.id, "format": d.format, "source": d.source, "columns": d.columns} for d in s.datasets.values()]


@tool("Some rows of a dataset.", ("dataset",), dataset=_DATASET, limit=_limit(100))
def inspect_dataset(s: Session, dataset: str, limit: int = 10) -> list[dict]:
    return _rows(s.preview(dataset, limit), limit)


@tool("Types, meanings, missing and distinct values, statistics and duplicate rows of a dataset.", ("dataset",), dataset=_DATASET)
def profile_dataset(s: Session, dataset: str) -> dict:
    p = s.profile(dataset)
    return {"dataset": dataset, "rows": p.rows, "duplicate_rows": p.duplicates, "issues": issues([p]),
            "columns": [{"name": c.name, "type": c.logical, "meaning": c.semantic, "filled": c.non_null, "distinct": c.distinct, "cardinality": c.cardinality, "top": c.top} for c in p.columns.values()]}


@tool("The scored correspondences between the columns of two datasets, with their evidence.", ("left", "right"), left=_DATASET, right=_DATASET)
def compare_schemas(s: Session, left: str, right: str) -> list[dict]:
    return [{"left": m.left, "right": m.right, "score": round(m.score, 4), "accepted": m.accepted, "evidence": m.evidence} for m in s.compare_schemas(left, right)]


@tool("Profiles, matches and relates all datasets.", force={"type": "boolean"})
def find_candidate_relationships(s: Session, force: bool = False) -> list[dict]:
    if force or s.stale:
        s.discover()
    return [{"kind": r.kind, "left": r.left, "right": r.right, "keys": r.keys, "confidence": round(r.confidence, 4), "reason": r.reason} for r in s.relations]


@tool("Column correspondences, accepted ones and the best of the others.")
def show_mappings(s: Session) -> dict:
    s._fresh()
    ranked = sorted(s.matches, key=lambda m: -m.score)
    return {"accepted": [(m.left, m.right, round(m.score, 4)) for m in ranked if m.accepted], "others": [(m.left, m.right, round(m.score, 4), m.reason) for m in ranked if not m.accepted][:20]}


@tool("The integration graph of datasets or of columns.", level=_one_of("dataset", "column"))
def build_graph(s: Session, level: str = "dataset") -> dict:
    view = s.graph_view()
    return view if level == "dataset" else view | {"columns": [(m.left, m.right, round(m.score, 4)) for m in s.matches if m.accepted]}


@tool("Links records of two datasets, or finds duplicates within one, without merging.", ("left",), left=_DATASET, right=_DATASET)
def find_entity_matches(s: Session, left: str, right: str | None = None) -> dict:
    s._fresh()
    names = [left] if right is None else [left, right]
    if right is None:
        kinds = ("NAME", "EMAIL", "PHONE", "CITY")
        fields = [(c.name, c.semantic, "digits" if c.semantic == "PHONE" else "basic", {left: c.name}) for c in s.profile(left).columns.values() if c.semantic in kinds]
    else:
        fields = [(f.name, f.semantic, f.norm, f.columns) for f in group_fields(names, s.matches, s.profiles)]
    if not fields:
        return {"entities": 0, "pairs": [], "note": "no shared attributes to compare"}
    columns = {d: {cols[d]: f"f_{n}" for n, _, _, cols in fields if d in cols} for d in names}
    found = s.entity_match_preview(names, columns, [MatchField(f"f_{n}", k, norm) for n, k, norm, _ in fields], tuple(names) if right is None else ())
    return {"entities": found.entities.select("entity_id").distinct().count(), "statistics": found.statistics, "pairs": _rows(found.pairs.orderBy(F.desc("p")), 50)}


@tool("Sets how merges are made.", (), True, **_PREFERENCES)
def set_preferences(s: Session, mode=None, conflict_strategy=None, confidence_threshold=None, primary_key=None, merge_uncertain=None, source_priority=None) -> dict:
    p = s.preferences
    changed: dict[str, Any] = {k: v for k, v in (("mode", mode), ("strategy", conflict_strategy), ("priority", source_priority)) if v is not None}
    limits = dict(p.thresholds)
    if confidence_threshold is not None:
        limits["min_edge"] = confidence_threshold / 100 if confidence_threshold > 1 else confidence_threshold
    if merge_uncertain is not None:
        limits = {k: v for k, v in limits.items() if k != "entity_merge"} | ({} if merge_uncertain else {"entity_merge": 0.9})
    if limits != p.thresholds:
        changed["thresholds"] = limits
    if primary_key is not None:
        owner, _, column = primary_key.rpartition(".")
        changed["primary"] = next((d.id for d in s.datasets.values() if owner in ("", d.id) and column in d.columns), primary_key)
    s.set_preferences(**changed)
    return {"mode": p.mode, "conflict_strategy": p.strategy, "thresholds": p.thresholds, "primary": p.primary, "source_priority": p.priority}


def _preferred(s: Session, options: dict) -> None:
    if options:
        set_preferences(s, **options)


@tool("The merge plan: root, joins, entity groups, transforms and thresholds, without carrying it out.", (), True, **{k: v for k, v in _PREFERENCES.items() if k != "source_priority"})
def generate_merge_plan(s: Session, **options: Any) -> list[str]:
    _preferred(s, options)
    return s.make_plan().steps()


@tool("Integrates the datasets, checks the result and writes all outputs.", (), True, **{k: v for k, v in _PREFERENCES.items() if k != "source_priority"})
def execute_merge(s: Session, **options: Any) -> dict:
    _preferred(s, options)
    m = s.execute()
    return {"merge": m.id, "rows": m.rows, "passed": m.report["passed"], "match_rates": m.report["match_rates"], "groups": m.report["groups"]}


@tool("Conflicting values met while fusing entities, with all candidates.", attribute=_TEXT, entity_id=_TEXT, limit=_limit(200))
def show_conflicts(s: Session, attribute: str | None = None, entity_id: str | None = None, limit: int = 20) -> list[dict]:
    return _rows(s.conflicts(None, attribute, entity_id, limit), limit) if os.path.exists(os.path.join(_merged(s).folder, "conflicts.csv")) else []


@tool("Entities that stand for several records.", limit=_limit(100))
def show_duplicates(s: Session, limit: int = 10) -> dict:
    out = {}
    for g in _merged(s).plan.entity_groups:
        out[g.id] = _rows(s.entities(g.id).where("_entity_record_count > 1").orderBy(F.desc("_entity_record_count"), "entity_id"), limit)
    return out


@tool("Why two columns were matched, or were not.", ("left", "right"), left=_TEXT, right=_TEXT)
def explain_match(s: Session, left: str, right: str) -> str:
    s._fresh()
    ends = [[x for m in s.matches for x in m.pair if x == name or x.split(".", 1)[1] == name] for name in (left, right)]
    a, b = next(((a, b) for m in sorted(s.matches, key=lambda m: -m.score) for a, b in (m.pair, m.pair[::-1]) if a in ends[0] and b in ends[1]), (left, right))
    return s.explain_match(a, b)


@tool("Why two datasets were linked, or the route between them.", ("left", "right"), left=_DATASET, right=_DATASET)
def explain_relationship(s: Session, left: str, right: str) -> str:
    told = s.explain_relationship(left, right)
    return told if told != "no relationship" else "; ".join(s.route(left, right, 1)) or told


@tool("The most reliable routes between two datasets.", ("source", "target"), source=_DATASET, target=_DATASET, cost_mode=_one_of("neglog", "linear"))
def find_integration_route(s: Session, source: str, target: str, cost_mode: str | None = None) -> list[str]:
    return s.route(source, target, 3, cost_mode)


@tool("Approves or rejects a correspondence of columns.", ("left", "right", "decision"), True, left=_TEXT, right=_TEXT, decision=_one_of("approved", "rejected"))
def decide_mapping(s: Session, left: str, right: str, decision: str) -> str:
    s.decide_match(left, right, decision == "approved")
    return f"{left} ~ {right}: {decision}"


@tool("Record pairs whose labels would help most, some of them drawn at random.", limit=_limit(50))
def review_entity_links(s: Session, limit: int = 10) -> dict:
    return {g.id: s.review_links(g, limit) for g in s.make_plan().entity_groups}


@tool("Labels two records as the same entity or not.", ("left_dataset", "left_row", "right_dataset", "right_row", "decision"), True, left_dataset=_DATASET, left_row={"type": "integer", "minimum": 0},
      right_dataset=_DATASET, right_row={"type": "integer", "minimum": 0}, decision=_one_of("match", "non_match"))
def label_entity_link(s: Session, left_dataset: str, left_row: int, right_dataset: str, right_row: int, decision: str) -> int:
    s.label_entity_link(f"{left_dataset}:{left_row:012d}", f"{right_dataset}:{right_row:012d}", decision == "match")
    return len(s.labels)


@tool("A sum, count or mean of the unified table, with how much of it depends on uncertain matches.", measure=_TEXT, group_by=_TEXT, agg=_one_of("sum", "count", "avg"))
def aggregate_with_uncertainty(s: Session, measure: str | None = None, group_by: str | None = None, agg: str = "sum") -> list[dict]:
    return _rows(s.aggregate_with_uncertainty("count" if measure is None else agg, measure, group_by), 30)


@tool("How attributes of entities changed, or what held at a date.", entity_id=_TEXT, attribute=_TEXT, as_of=_TEXT, as_known_at=_TEXT)
def entity_history(s: Session, entity_id: str | None = None, attribute: str | None = None, as_of: str | None = None, as_known_at: str | None = None) -> list[dict]:
    from datetime import datetime

    h = s.entity_history(None, entity_id, attribute, as_of, datetime.fromisoformat(as_known_at) if as_known_at else None)
    return [] if h is None else _rows(h.orderBy("entity_id", "attribute", "valid_from"), 100)


@tool("Where the unified table's columns come from.", column=_TEXT)
def show_provenance(s: Session, column: str | None = None) -> list[dict]:
    return [r for r in lineage.column_lineage(_merged(s).plan, s.frames) if column in (None, r["output"], r["column"])]


@tool("The lineage of the current merge in words.")
def lineage_report(s: Session) -> str:
    _merged(s)
    return s.lineage_report()


@tool("Which shares of rows and records were matched.")
def match_rates(s: Session) -> dict:
    m, out = _merged(s), s.unified()
    aliases = [a.alias for a in m.plan.attachments if f"_match_{a.alias}" in out.columns]
    return {"rows": m.rows, "joins": [r.asDict() for r in match_statistics(out, aliases).collect()] if aliases else [], "groups": m.report["groups"]}


TOOLS["match_statistics"] = Tool("match_statistics", TOOLS.pop("match_rates").description, match_rates, {})


@tool("The quality report of the current merge.")
def quality_report(s: Session) -> dict:
    return _merged(s).report


@tool("Some rows of the unified table.", limit=_limit(100), columns={"type": "array", "items": _TEXT})
def preview_output(s: Session, limit: int = 10, columns: list[str] | None = None) -> list[dict]:
    _merged(s)
    out = s.unified()
    return _rows(out.select(*columns) if columns else out, limit)


@tool("Takes the last merge back; its outputs stay in the archive.", (), True)
def undo_merge(s: Session) -> str:
    return _merged(s) and s.undo().id


@tool("The files that the current merge wrote.")
def export_dataset(s: Session) -> list[str]:
    folder = _merged(s).folder
    return sorted(os.path.join(folder, f) for f in os.listdir(folder))


def _merged(s: Session):
    if not s.merges:
        raise BadArguments("there is no merge yet")
    return s.merges[-1]


def _checked(s: Session, t: Tool, given: dict[str, Any]) -> dict[str, Any]:
    """Arguments as a tool takes them: known names, right types and ranges, datasets by their id in any case."""
    if unknown := set(given) - set(t.properties):
        raise BadArguments(f"{t.name} takes no {', '.join(sorted(unknown))}")
    if missing := [k for k in t.required if given.get(k) is None]:
        raise BadArguments(f"{t.name} needs {', '.join(missing)}")
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list}
    out = {}
    for k, v in given.items():
        p = t.properties[k]
        if v is None:
            continue
        if not isinstance(v, kinds[p["type"]]) or p["type"] in ("integer", "number") and isinstance(v, bool):
            raise BadArguments(f"{k} must be of type {p['type']}")
        if "enum" in p and v not in p["enum"]:
            raise BadArguments(f"{k} must be one of {', '.join(p['enum'])}")
        if p is _DATASET:
            v = next((d for d in s.datasets if d.lower() == v.lower()), None)
            if v is None:
                raise BadArguments(f"no dataset {given[k]!r}; there are {', '.join(sorted(s.datasets)) or 'none'}")
        if p["type"] in ("integer", "number"):
            v = max(p.get("minimum", v), min(p.get("maximum", v), v))
        out[k] = v
    return out


def call(s: Session, name: str, arguments: dict[str, Any] | None = None) -> dict[str, Any]:
    """{"tool", "ok", and "result" or "error"}; what is wrong with a request comes back as text and raises nothing."""
    if name not in TOOLS:
        return {"tool": name, "ok": False, "error": f"there is no {name}"}
    try:
        return {"tool": name, "ok": True, "result": TOOLS[name].run(s, **_checked(s, TOOLS[name], arguments or {}))}
    except (BadArguments, ValueError, KeyError) as e:
        return {"tool": name, "ok": False, "error": str(e)}


# -- requests in plain words ------------------------------------------------------------------------------------------------

_STRATEGY_WORDS = (("latest|newest|recent", "prefer_latest"), ("majority", "majority_vote"), ("non[- ]?null", "prefer_non_null"), ("highest confidence", "highest_confidence"), ("keep all", "keep_all"),
                   ("manual|review (it|them) myself", "manual_review"), ("accura|truth|reliable source", "source_accuracy_vote"), ("prefer \\w* ?source|trust", "prefer_source"))
#: (what the request says, tool, how many datasets and columns it must name, arguments from those). The first that fits is taken.
_REQUESTS: tuple[tuple[str, str, int, int, Callable[[list, list], dict]], ...] = (
    (r"\b(undo|revert|roll ?back|take back)\b", "undo_merge", 0, 0, lambda d, c: {}),
    (r"lineage (report|story)|report .*lineage", "lineage_report", 0, 0, lambda d, c: {}),
    (r"\b(export|download|files)\b", "export_dataset", 0, 0, lambda d, c: {}),
    (r"\b(provenance|lineage|come from|comes from|origin)\b", "show_provenance", 0, 0, lambda d, c: {"column": c[0].split(".")[-1]} if c else {}),
    (r"\b(why|explain|reason)\b", "explain_match", 0, 2, lambda d, c: {"left": c[0], "right": c[1]}),
    (r"\b(why|explain|reason)\b", "explain_relationship", 2, 0, lambda d, c: {"left": d[0], "right": d[1]}),
    (r"\b(route|path)\b|how (is|are) .*(connected|related|linked)", "find_integration_route", 2, 0, lambda d, c: {"source": d[0], "target": d[1]}),
    (r"\b(reject|wrong|incorrect|not the same|no match)\b", "decide_mapping", 0, 2, lambda d, c: {"left": c[0], "right": c[1], "decision": "rejected"}),
    (r"\b(approve|confirm|accept|correct)\b", "decide_mapping", 0, 2, lambda d, c: {"left": c[0], "right": c[1], "decision": "approved"}),
    (r"\bconflict", "show_conflicts", 0, 0, lambda d, c: {"attribute": c[0].split(".")[-1]} if c else {}),
    (r"\bduplicat", "find_entity_matches", 1, 0, lambda d, c: {"left": d[0]}),
    (r"\bduplicat", "show_duplicates", 0, 0, lambda d, c: {}),
    (r"\b(label|review|uncertain pairs)\b", "review_entity_links", 0, 0, lambda d, c: {}),
    (r"\b(history|changed over time|as of)\b", "entity_history", 0, 0, lambda d, c: {"attribute": c[0].split(".")[-1]} if c else {}),
    (r"percent|share of|match rate|how many .*match", "match_statistics", 0, 0, lambda d, c: {}),
    (r"quality", "quality_report", 0, 0, lambda d, c: {}),
    (r"\b(graph|visuali[sz]e|draw)\b", "build_graph", 0, 0, lambda d, c: {}),
    (r"same entit|match(ing)? (entit|record|people|customer)|record linkage|entity (resolution|matching)", "find_entity_matches", 2, 0, lambda d, c: {"left": d[0], "right": d[1]}),
    (r"\bcompare\b", "compare_schemas", 2, 0, lambda d, c: {"left": d[0], "right": d[1]}),
    (r"mapping|correspond|columns? (refer|map|match)", "show_mappings", 0, 0, lambda d, c: {}),
    (r"\bplan\b|how would you", "generate_merge_plan", 0, 0, lambda d, c: {}),
    (r"\b(sum|total|average|mean|count)\b.*\bby\b", "aggregate_with_uncertainty", 0, 2, lambda d, c: {"measure": c[0].split(".")[-1], "group_by": c[1].split(".")[-1]}),
    (r"\b(merge|integrate|combine|unify|go ahead|proceed)\b", "execute_merge", 0, 0, lambda d, c: {}),
    (r"(preview|show).*(result|output|unified|merged)", "preview_output", 0, 0, lambda d, c: {}),
    (r"\b(profile|schema|types|statistics)\b", "profile_dataset", 1, 0, lambda d, c: {"dataset": d[0]}),
    (r"(list|what|which).*(datasets|tables|loaded)", "list_datasets", 0, 0, lambda d, c: {}),
    (r"\b(show|preview|inspect|look at|open)\b", "inspect_dataset", 1, 0, lambda d, c: {"dataset": d[0], "limit": 10}),
    (r"relat|discover|analy[sz]e|connect|find|link", "find_candidate_relationships", 0, 0, lambda d, c: {}),
)


def _named(s: Session, text: str) -> tuple[list[str], list[str]]:
    """Datasets and columns that a text names, in its order; longer names first where they overlap."""
    low = text.lower()

    def places(names: dict[str, str]) -> list[str]:
        taken, found = [False] * len(low), []
        for word, name in sorted(names.items(), key=lambda x: -len(x[0])):
            for m in re.finditer(rf"(?<![\w.]){re.escape(word)}(?![\w])", low):
                if not any(taken[m.start():m.end()]):
                    taken[m.start():m.end()] = [True] * (m.end() - m.start())
                    found.append((m.start(), name))
        return list(dict.fromkeys(n for _, n in sorted(found)))
    datasets = {w: d for d in s.datasets for w in {d.lower(), d.lower().replace("_", " ")}}
    columns = {}
    for d in s.datasets.values():
        for c in d.columns:
            columns.setdefault(c.lower(), c)
            columns[f"{d.id}.{c}".lower()] = f"{d.id}.{c}"
    return places(datasets), places(columns)


def read(s: Session, request: str) -> list[tuple[str, dict[str, Any]]]:
    """The calls that a request in plain words asks for: preferences that it states, then at most one action."""
    low = request.lower()
    stated: dict[str, Any] = {}
    if m := re.search(r"(\d+(?:\.\d+)?)\s*(?:%|percent)|(?:above|over|least|threshold(?: of)?)\s+(0?\.\d+)", low):
        stated["confidence_threshold"] = float(m.group(1) or m.group(2))
        low = low.replace(m.group(), " ")
    for mode in MODES:
        if re.search(rf"\b{mode}\b", low):
            stated["mode"] = mode
    if m := re.search(r"(don'?t|do not|never|avoid)\s+(auto-?)?merg\w*\s+(any\s+)?(uncertain|ambiguous|doubtful)\w*(\s+\w+)?", low):
        stated["merge_uncertain"] = False
        low = low.replace(m.group(), " ")
    if m := re.search(r"use\s+([\w.]+)\s+as\s+(?:the\s+)?(?:primary\s+|main\s+)?(?:identifier|key|id)\b", request, re.IGNORECASE):
        stated["primary_key"] = m.group(1)
        low = low.replace(m.group().lower(), " ")
    if re.search(r"\b(prefer|use|resolve|keep|trust|conflicts?)\b", low):
        for words, strategy in _STRATEGY_WORDS:
            if re.search(words, low):
                stated["conflict_strategy"] = strategy
                break
    calls: list[tuple[str, dict[str, Any]]] = [("set_preferences", stated)] if stated else []
    datasets, columns = _named(s, request)
    for words, name, n_datasets, n_columns, arguments in _REQUESTS:
        if len(datasets) >= n_datasets and len(columns) >= n_columns and re.search(words, low) and not (name == "show_conflicts" and "conflict_strategy" in stated):
            return [*calls, (name, arguments(datasets, columns))]
    return calls or [("list_datasets", {})]


def answer(s: Session, request: str) -> list[dict[str, Any]]:
    """Results of the calls that a request asks for, up to the first that fails."""
    out = []
    for name, arguments in read(s, request):
        out.append(call(s, name, arguments))
        if not out[-1]["ok"]:
            break
    return out
