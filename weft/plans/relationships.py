"""Relationships between datasets from accepted column matches: lookups, key merges, entity links, aggregate lookups."""

from __future__ import annotations

from dataclasses import dataclass, field

from weft import config
from weft.operators.profile import ColumnProfile, DatasetProfile
from weft.plans.matching import Match, Sketch, overlap
from weft.plans.names import reference_words

LOOKUP, KEY_MERGE, RESOLUTION, AGGREGATE, NONE = "LOOKUP", "ENTITY_KEY_MERGE", "ENTITY_RESOLUTION", "AGGREGATE_LOOKUP", "NONE"
PRIORITY = {KEY_MERGE: 0, LOOKUP: 1, RESOLUTION: 2, AGGREGATE: 3}
DISCRIMINATIVE = ("NAME", "EMAIL", "PHONE")


@dataclass
class Relationship:
    kind: str
    left: str  # the referencing (finer) dataset
    right: str  # the referenced dataset
    keys: list[tuple[str, str]] = field(default_factory=list)
    confidence: float = 0.0
    norm: str = "basic"
    coverage: float = 0.0
    matches: list[Match] = field(default_factory=list)
    reason: str = ""

    @property
    def pair(self) -> frozenset[str]:
        return frozenset((self.left, self.right))


def effective_uniqueness(c: ColumnProfile, p: DatasetProfile) -> float:
    """Distinct values over values, not counting rows that repeat others entirely."""
    n = c.non_null - p.duplicates
    return min(1.0, c.distinct / n) if n > 0 else 0.0


def row_weighted_coverage(ref: ColumnProfile, target: Sketch) -> float | None:
    """The share of rows whose value the target holds, if the value counts of the reference are all known."""
    if not ref.top or sum(ref.top.values()) < ref.non_null or not target.complete:
        return None
    hit = sum(n for v, n in ref.top.items() if v.strip().lower() in target.values)
    return hit / ref.non_null if ref.non_null else None


def is_dense(s: Sketch) -> bool:
    try:
        v = sorted(int(x) for x in s.values)
    except ValueError:
        return False
    return s.complete and len(v) > 1 and len(v) / (v[-1] - v[0] + 1) >= 0.5


def chance_overlap(ref: Sketch, target: Sketch) -> bool:
    """Whether containment says nothing: both are dense integer ranges, or small and starting together."""
    return is_dense(target) and (is_dense(ref) or all(x.lstrip("-").isdigit() for x in list(ref.values)[:50]))


def name_support(ref: ColumnProfile, target: ColumnProfile, dataset: str) -> bool:
    """Whether the reference's name agrees with the key's or with the referenced dataset's."""
    own = reference_words(ref.name)
    flat = "".join(c for c in ref.name.lower() if c.isalnum())
    tail = "".join(c for c in target.name.lower().split("_")[-1] if c.isalnum())
    return bool(own & (reference_words(target.name) | reference_words(dataset))) or (len(tail) > 4 and flat.endswith(tail))


def infer(profiles: list[DatasetProfile], matches: list[Match], sketches: dict[str, Sketch], settings: dict | None = None) -> list[Relationship]:
    """The best relationship of each dataset pair, less links that a shared parent implies."""
    cfg = (settings or config.settings())["merge"]
    by_name = {p.dataset: p for p in profiles}
    columns = {c.key: c for p in profiles for c in p.columns.values()}
    groups: dict[frozenset[str], list[Match]] = {}
    for m in matches:
        if m.accepted:
            groups.setdefault(frozenset((columns[m.left].dataset, columns[m.right].dataset)), []).append(m)
    out = []
    for pair, found in groups.items():
        options = []
        for m in found:
            a, b = columns[m.left], columns[m.right]
            ua, ub = effective_uniqueness(a, by_name[a.dataset]), effective_uniqueness(b, by_name[b.dataset])
            _, ca, cb, _ = overlap(sketches[a.key], sketches[b.key]) if m.norm == "basic" and a.key in sketches and b.key in sketches else (0.0, *m.containment, 0)
            jaccard = ca * cb / (ca + cb - ca * cb) if ca + cb > 0 else 0.0
            keyish = {"ID", "NUMERIC", "ZIPCODE", "CATEGORY", "CITY", "COUNTRY", "UNKNOWN", "NAME", "EMAIL"}
            chance = chance_overlap(sketches.get(a.key, Sketch({})), sketches.get(b.key, Sketch({}))) or chance_overlap(sketches.get(b.key, Sketch({})), sketches.get(a.key, Sketch({})))
            if min(ua, ub) >= cfg["entity_uniqueness"] and jaccard >= cfg["entity_overlap"] and (not chance or name_support(a, b, b.dataset) and name_support(b, a, a.dataset)):
                options.append(Relationship(KEY_MERGE, a.dataset, b.dataset, [(a.name, b.name)], 0.7 * m.score + 0.3 * jaccard, m.norm, jaccard, found, "both keys unique"))
            for ref, key, uk, coverage in ((a, b, ub, ca), (b, a, ua, cb)):
                if uk < cfg["key_uniqueness"] or ref.semantic not in keyish or key.logical == "float" or ref.logical == "float":
                    continue
                weighted = row_weighted_coverage(ref, sketches.get(key.key, Sketch({}, False)))
                share = weighted if weighted is not None else coverage
                if share < cfg["lookup_containment"]:
                    continue
                if chance and not name_support(ref, key, key.dataset):
                    continue
                options.append(Relationship(LOOKUP, ref.dataset, key.dataset, [(ref.name, key.name)], 0.7 * m.score + 0.3 * share, m.norm, share, found, f"{share:.0%} of rows resolve"))
            if max(ua, ub) < cfg["key_uniqueness"] and max(ca, cb) >= cfg["lookup_containment"] and m.score >= 0.9 * config.DEFAULTS["thresholds"]["medium"] and not chance and a.semantic in keyish and a.logical != "float":
                fine, coarse = (a, b) if by_name[a.dataset].rows >= by_name[b.dataset].rows else (b, a)
                options.append(Relationship(AGGREGATE, fine.dataset, coarse.dataset, [(fine.name, coarse.name)], 0.85 * (0.7 * m.score + 0.3 * max(ca, cb)), m.norm, max(ca, cb), found, "shared key, not unique"))
        described = [m for m in found if columns[m.left].semantic in (*DISCRIMINATIVE, "CITY", "COUNTRY", "DATE", "ZIPCODE", "CATEGORY")]
        telling = [m for m in described if columns[m.left].semantic in DISCRIMINATIVE and columns[m.left].semantic == columns[m.right].semantic and max(m.containment) >= cfg["entity_shared"]]
        x, y = sorted(pair)
        sizes = sorted((by_name[x].rows, by_name[y].rows))
        if len(described) >= 2 and telling and sizes[1] < 20 * max(1, sizes[0]):
            top = sorted((m.score for m in described), reverse=True)[:3]
            options.append(Relationship(RESOLUTION, x, y, [], sum(top) / len(top) * (0.95 if len(telling) > 1 else 0.85), "basic", 0.0, found, "descriptive columns agree"))
        if options:
            best = max(o.confidence for o in options)
            chosen = min((o for o in options if o.confidence >= best - 0.05), key=lambda o: (PRIORITY[o.kind], -o.confidence, o.keys))
            chosen.keys = list(dict.fromkeys([*chosen.keys, *[k for o in options if o.kind == chosen.kind and (o.left, o.right) == (chosen.left, chosen.right) for k in o.keys]]))
            out.append(chosen)
    return drop_implied(out)


def drop_implied(relations: list[Relationship]) -> list[Relationship]:
    """Without links between siblings that both reference one key by the columns that link them: the parent connects them."""
    parents: dict[tuple[str, str], set[tuple[str, str]]] = {}
    for r in relations:
        if r.kind == LOOKUP:
            for ref, key in r.keys:
                parents.setdefault((r.left, ref), set()).add((r.right, key))

    def implied(r: Relationship) -> bool:
        return r.kind in (LOOKUP, AGGREGATE, KEY_MERGE) and bool(r.keys) and all(
            parents.get((r.left, a), set()) & parents.get((r.right, b), set()) for a, b in r.keys)
    return [r for r in relations if not implied(r)]
