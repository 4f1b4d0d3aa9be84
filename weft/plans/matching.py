"""Schema matching: seven signals by column pair, similarity flooding, alignment; metadata only, on the driver."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations
from typing import Protocol

import numpy as np

from weft import config
from weft.operators.profile import ColumnProfile, DatasetProfile, quantile_distance
from weft.plans.assignment import assign
from weft.plans.names import concepts, name_similarity, name_tokens

Pair = tuple[str, str]

#: How well logical types and semantic types go together (1 if equal).
TYPE_PAIRS = {("integer", "float"): 0.9, ("date", "datetime"): 0.9, ("integer", "string"): 0.5, ("float", "string"): 0.4, ("date", "string"): 0.4, ("datetime", "string"): 0.4,
              ("boolean", "integer"): 0.4, ("boolean", "string"): 0.4}
RELATED_TYPES = ({"DATE", "DATETIME"}, {"ID", "ZIPCODE"}, {"NUMERIC", "CURRENCY"}, {"CITY", "NAME"}, {"CATEGORY", "CITY"}, {"CATEGORY", "COUNTRY"}, {"ID", "NUMERIC"}, {"CATEGORY", "BOOLEAN"})
VAGUE_TYPES = {"UNKNOWN", "FREE_TEXT", "CATEGORY", "NUMERIC"}


@dataclass
class Sketch:
    """A column's normalised sample values with hashes; ``complete`` if it holds all distinct values."""

    values: dict[str, int]
    complete: bool = True

    @property
    def tau(self) -> int:
        return max(self.values.values(), default=0)

    def restricted(self, tau: int) -> set[str]:
        return {v for v, h in self.values.items() if h <= tau}


@dataclass
class Match:
    left: str
    right: str
    score: float
    evidence: dict[str, float] = field(default_factory=dict)
    norm: str = "basic"
    containment: tuple[float, float] = (0.0, 0.0)
    accepted: bool = False
    reason: str = ""
    shape: tuple[float, ...] = ()  # what the two profiles are like, for learned scorers

    @property
    def pair(self) -> Pair:
        return (self.left, self.right)


@dataclass(frozen=True)
class Strategy:
    signals: tuple[str, ...] = ("name", "datatype", "semantic", "value_overlap", "distribution", "pattern", "cardinality")
    flooding: bool = True
    one_to_one: bool = True


def overlap(a: Sketch, b: Sketch, fn: Callable[[str], str | None] | None = None) -> tuple[float, float, float, int]:
    """(jaccard, containment of a, containment of b, intersection) on the shared part of the value space."""
    if a.complete and b.complete:
        x, y = set(a.values), set(b.values)
    else:
        tau = min(s.tau for s in (a, b) if not s.complete)
        x, y = a.restricted(tau), b.restricted(tau)
    if fn is not None:
        x, y = {fn(v) for v in x} - {None}, {fn(v) for v in y} - {None}
    both = len(x & y)
    union = len(x | y)
    return (both / union if union else 0.0, both / len(x) if x else 0.0, both / len(y) if y else 0.0, both)


def datatype_similarity(a: str, b: str) -> float:
    return 1.0 if a == b else TYPE_PAIRS.get((a, b), TYPE_PAIRS.get((b, a), 0.1))


def type_compatibility(a: str, b: str) -> float:
    if a == b and a != "UNKNOWN":
        return 1.0
    if {a, b} in RELATED_TYPES:
        return 0.6
    return 0.5 if a in VAGUE_TYPES or b in VAGUE_TYPES else 0.0


class ColumnEncoder(Protocol):
    """What compares column descriptions: made from documents by column key, it gives similarities from 0 to 1."""

    def __init__(self, documents: dict[str, str]) -> None: ...

    def cosine(self, a: str, b: str) -> float: ...


class TfIdf:
    """Character 3- to 5-grams within words, sublinear counts, inverse document frequencies, unit length."""

    def __init__(self, documents: dict[str, str]):
        grams = {k: self._grams(v) for k, v in documents.items()}
        df: dict[str, int] = defaultdict(int)
        for g in grams.values():
            for t in g:
                df[t] += 1
        n = len(documents)
        self.vectors = {}
        for k, g in grams.items():
            v = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in g.items()}
            length = math.sqrt(sum(x * x for x in v.values())) or 1.0
            self.vectors[k] = {t: x / length for t, x in v.items()}

    @staticmethod
    def _grams(text: str) -> dict[str, int]:
        out: dict[str, int] = defaultdict(int)
        for word in text.lower().split():
            w = f" {word} "
            for n in (3, 4, 5):
                for i in range(len(w) - n + 1):
                    out[w[i:i + n]] += 1
        return out

    def cosine(self, a: str, b: str) -> float:
        x, y = self.vectors.get(a, {}), self.vectors.get(b, {})
        return sum(v * y.get(t, 0.0) for t, v in x.items())


def column_document(c: ColumnProfile) -> str:
    return " ".join([*name_tokens(c.name), *name_tokens(c.name), c.semantic.lower(), *list(c.top)[:10]])


def semantic_similarity(a: ColumnProfile, b: ColumnProfile, index: ColumnEncoder | None) -> float:
    x, y = concepts(name_tokens(a.name)), concepts(name_tokens(b.name))
    shared = len(x & y) / len(x | y) if x | y else 0.0
    return 0.4 * shared + 0.3 * type_compatibility(a.semantic, b.semantic) + 0.3 * (index.cosine(a.key, b.key) if index else 0.0)


def expected_containment(source: Sketch, target: Sketch) -> float | None:
    """For complete integer columns the share of a random value in the source's range that the target would hold."""
    def ints(s: Sketch) -> list[int] | None:
        if not s.complete or not s.values:
            return None
        try:
            return sorted(int(v) for v in s.values)
        except ValueError:
            return None
    a, b = ints(source), ints(target)
    if a is None or b is None:
        return None
    inside = [v for v in b if a[0] <= v <= a[-1]]
    return min(1.0, len(inside) / (a[-1] - a[0] + 1))


NORM_COSTS = {"basic": 0.0, "alnum": 0.01, "identifier": 0.02, "digits": 0.03, "geo": 0.03}


def python_normalizers(a: ColumnProfile, b: ColumnProfile) -> dict[str, Callable[[str], str | None]]:
    """The normalisers worth trying for a pair, over values that are already in basic form."""
    import re

    def alnum(v: str) -> str | None:
        return " ".join(re.sub(r"[^\w\s]", " ", v).split()) or None

    def ident(v: str) -> str | None:
        bare = re.sub(r"^[a-z]+[-_ ]?", "", v)
        return (bare.lstrip("0") or "0") if re.fullmatch(r"\d+", bare) else v

    def only_digits(v: str) -> str | None:
        d = re.sub(r"\D", "", v)
        return d[-10:] if len(d) >= 6 else None

    def place(v: str) -> str | None:
        for s in config.GEO_SUFFIXES:
            v = re.sub(s, "", v)
        return alnum(v)

    def of_domain(d: str) -> Callable[[str], str | None]:
        aliases = config.DOMAINS[d]

        def fn(v: str) -> str | None:
            for form in (alnum(v), alnum(re.sub(config.STATE_SUFFIX, "", v)), place(v)):
                if form in aliases:
                    return aliases[form]
            return place(v)
        return fn
    out: dict[str, Callable[[str], str | None]] = {"basic": lambda v: v}
    kinds = {a.semantic, b.semantic}
    if a.logical == "string" or b.logical == "string":
        out["alnum"] = alnum
        if kinds & {"ID", "NUMERIC", "UNKNOWN", "ZIPCODE"}:
            out["identifier"] = ident
        if "PHONE" in kinds:
            out["digits"] = only_digits
        if kinds & {"CITY", "COUNTRY", "CATEGORY", "UNKNOWN", "NAME"}:
            out["geo"] = place
            for d in config.DOMAINS:
                out[f"domain:{d}"] = of_domain(d)
    return out


def coded_prefix(s: Sketch) -> str | None:
    """The letters before a number that nine in ten values share, if there are any."""
    counts: dict[str, int] = defaultdict(int)
    for v in list(s.values)[:500]:
        letters = v.rstrip("0123456789")
        if letters != v and letters.strip("-_ ").isalpha():
            counts[letters] += 1
    best = max(counts, key=lambda k: (counts[k], k), default=None)
    return best if best and counts[best] >= 0.9 * min(500, len(s.values)) else None


def value_similarity(a: ColumnProfile, sa: Sketch, b: ColumnProfile, sb: Sketch, extra: dict[str, Callable] | None = None) -> tuple[float, str, tuple[float, float]]:
    """(score, normaliser, containments): the best normaliser by 0.4 jaccard + 0.6 larger containment less its cost.

    Complete integer columns count only what exceeds the overlap of dense ranges by chance; small domains and floats
    are discounted.
    """
    best = (0.0, "basic", (0.0, 0.0))
    pa, pb = coded_prefix(sa), coded_prefix(sb)
    for name, fn in {**python_normalizers(a, b), **(extra or {})}.items():
        if name == "identifier" and pa and pb and pa != pb:
            continue  # two code systems: their numbers only look alike
        j, ca, cb, both = overlap(sa, sb, None if name == "basic" else fn)
        score = 0.4 * j + 0.6 * max(ca, cb) - NORM_COSTS.get(name, 0.03)
        if a.logical == b.logical == "integer" and name == "basic":
            ea, eb = expected_containment(sa, sb), expected_containment(sb, sa)
            if ea is not None and eb is not None:
                above = max((ca - ea) / (1 - ea) if ea < 1 else 0.0, (cb - eb) / (1 - eb) if eb < 1 else 0.0, 0.0)
                score = 0.4 * j + 0.6 * above
        score *= min(1.0, math.log2(1 + both) / math.log2(33)) if both < 32 else 1.0
        if "float" in (a.logical, b.logical):
            score *= 0.5
        if score > best[0] + 1e-12:
            best = (score, name, (ca, cb))
    return best


def distribution_similarity(a: ColumnProfile, b: ColumnProfile) -> float:
    if a.quantiles and b.quantiles and a.logical in ("integer", "float") and b.logical in ("integer", "float"):
        return max(0.0, 1 - quantile_distance(a.quantiles, b.quantiles))
    if a.avg_length and b.avg_length and a.logical == b.logical == "string":
        return min(a.avg_length, b.avg_length) / max(a.avg_length, b.avg_length)
    return 0.5 if a.logical == b.logical else 0.2


def cardinality_similarity(a: ColumnProfile, b: ColumnProfile) -> float:
    return math.sqrt(min(a.distinct, b.distinct) / max(a.distinct, b.distinct)) if a.distinct and b.distinct else 0.0


def pattern_similarity(a: ColumnProfile, b: ColumnProfile) -> float:
    x, y = a.patterns, b.patterns
    if not x or not y:
        return 0.5
    dot = sum(v * y.get(k, 0.0) for k, v in x.items())
    return dot / (math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values())))


def score_pair(a: ColumnProfile, sa: Sketch, b: ColumnProfile, sb: Sketch, index: ColumnEncoder | None, weights: dict[str, float], signals: tuple[str, ...] = Strategy.signals,
               extra: dict[str, Callable] | None = None) -> Match:
    value, norm, containment = value_similarity(a, sa, b, sb, extra)
    evidence = {"name": name_similarity(a.name, b.name), "datatype": datatype_similarity(a.logical, b.logical), "semantic": semantic_similarity(a, b, index), "value_overlap": value,
                "distribution": distribution_similarity(a, b), "pattern": pattern_similarity(a, b), "cardinality": cardinality_similarity(a, b)}
    total = sum(weights[k] for k in signals)
    score = sum(weights[k] * evidence[k] for k in signals) / total
    if type_compatibility(a.semantic, b.semantic) == 0 and min(a.confidence, b.confidence) >= 0.6:
        score *= 0.6
    return Match(a.key, b.key, score, evidence, norm, containment, shape=pair_shape(a, b))


def pair_shape(a: ColumnProfile, b: ColumnProfile) -> tuple[float, ...]:
    """How alike two profiles are beside the weighed signals: keys, gaps, lengths, ranges and how sure their types are."""
    def close(x: float, y: float) -> float:
        return min(x, y) / max(x, y) if max(x, y) > 0 else 1.0
    filled = [c.non_null / c.rows if c.rows else 0.0 for c in (a, b)]
    inside = 0.0
    if None not in (a.minimum, a.maximum, b.minimum, b.maximum):
        spread = max(a.maximum, b.maximum) - min(a.minimum, b.minimum)
        inside = max(0.0, min(a.maximum, b.maximum) - max(a.minimum, b.minimum)) / spread if spread > 0 else 1.0
    return (max(a.uniqueness, b.uniqueness), min(a.uniqueness, b.uniqueness), float(a.semantic == b.semantic), type_compatibility(a.semantic, b.semantic), min(a.confidence, b.confidence),
            close(a.avg_length, b.avg_length), 1 - abs(filled[0] - filled[1]), inside, close(float(a.rows), float(b.rows)))


def candidate_pairs(profiles: list[DatasetProfile], sketches: dict[str, Sketch], limit: int = 5000) -> list[Pair]:
    """All cross-dataset pairs up to ``limit``; beyond, pairs that share a name concept, a specific type or enough values."""
    columns = [c for p in profiles for c in p.columns.values()]
    every = [(a, b) for a, b in combinations(columns, 2) if a.dataset != b.dataset]
    if len(every) <= limit:
        return [(a.key, b.key) for a, b in every]
    rows = [np.array(sorted(sketches[c.key].values.values())[:128]) if c.key in sketches else np.zeros(0) for c in columns]
    near: set[Pair] = set()
    bands: dict[tuple, list[str]] = defaultdict(list)
    for c, r in zip(columns, rows):  # coordinated samples that share their smallest hashes overlap
        for h in r[:32]:
            bands[(int(h),)].append(c.key)
        for t in concepts(name_tokens(c.name)):
            bands[("name", t)].append(c.key)
        if c.semantic not in VAGUE_TYPES and c.confidence >= 0.6:
            bands[("type", c.semantic)].append(c.key)
    dataset = {c.key: c.dataset for c in columns}
    for keys in bands.values():
        if len(keys) <= 200:
            near |= {(a, b) for a, b in combinations(sorted(set(keys)), 2) if dataset[a] != dataset[b]}
    order = {c.key: i for i, c in enumerate(columns)}
    return sorted(((a, b) if order[a] < order[b] else (b, a) for a, b in near))


def flood(scores: dict[Pair, float], dataset_of: dict[str, str], alpha: float = 0.5, beta: float = 0.15, center: float = 0.6, gamma: float = 0.35, rounds: int = 10, epsilon: float = 0.001) -> dict[Pair, float]:
    """Refined scores: pairs gain by two-hop paths through a third dataset and by good sibling columns, and lose to rivals."""
    base = dict(scores)
    now = dict(scores)
    by_column: dict[str, list[str]] = defaultdict(list)
    for a, b in scores:
        by_column[a].append(b)
        by_column[b].append(a)

    def of(s: dict[Pair, float], x: str, y: str) -> float:
        return s.get((x, y), s.get((y, x), 0.0))
    for _ in range(rounds):
        best_to = {(x, d): sorted(((of(now, x, y), y) for y in ys if dataset_of[y] == d), reverse=True)[:2] for x, ys in by_column.items() for d in {dataset_of[y] for y in ys}}
        siblings: dict[tuple[str, str], list[tuple[str, list[tuple[float, str]]]]] = defaultdict(list)
        for (x, d), top in best_to.items():
            siblings[(dataset_of[x], d)].append((x, top))
        new = {}
        for (a, b), s0 in base.items():
            da, db = dataset_of[a], dataset_of[b]
            path = max((of(now, a, c) * of(now, c, b) for c in by_column[a] if dataset_of[c] not in (da, db)), default=0.0)
            own = now[(a, b)]
            # What a's siblings have in b's dataset, b itself left out: a pair must not support itself through its rivals.
            rest = sorted((next((v for v, y in top if y != b), 0.0) for x, top in siblings[(da, db)] if x != a), reverse=True)
            coherence = sum(rest[:3]) / 3 if rest else 0.0
            value = s0 + alpha * max(0.0, path - s0) + beta * max(0.0, coherence - center)
            rivals = max([v for k, y in (((a, db), b), ((b, da), a)) for v, other in best_to[k] if other != y] or [0.0])
            exclusivity = min(1.0, own / rivals) if rivals > 0 else 1.0
            new[(a, b)] = max(0.0, min(1.0, value * exclusivity**gamma))
        moved = max((abs(new[p] - now[p]) for p in new), default=0.0)
        now = new
        if moved < epsilon:
            break
    return now


def align(matches: list[Match], uniqueness: dict[str, float], dataset_of: dict[str, str], least: float, key_uniqueness: float = 0.98, fk_containment: float = 0.9, one_to_one: bool = True, vetoed: dict[Pair, str] | None = None) -> list[Match]:
    """Accepts by dataset pair the assignment of greatest total score; references to unique keys are admitted besides."""
    groups: dict[tuple[str, str], list[Match]] = defaultdict(list)
    for m in matches:
        m.accepted, m.reason = False, ""
        if vetoed and m.pair in vetoed:
            m.reason = vetoed[m.pair]
        elif m.score < least:
            m.reason = f"score {m.score:.2f} below {least:.2f}"
        else:
            groups[(dataset_of[m.left], dataset_of[m.right])].append(m)
    for group in groups.values():
        if not one_to_one:
            for m in group:
                m.accepted = True
            continue
        xs, ys = sorted({m.left for m in group}), sorted({m.right for m in group})
        gain = np.zeros((len(xs), len(ys)))
        for m in group:
            gain[xs.index(m.left), ys.index(m.right)] = m.score
        chosen = {(xs[i], ys[j]) for i, j in assign(gain) if gain[i, j] > 0}
        for m in group:
            if m.pair in chosen:
                m.accepted = True
            elif any(uniqueness.get(t, 0) >= key_uniqueness and c >= fk_containment for t, c in ((m.right, m.containment[0]), (m.left, m.containment[1]))):
                m.accepted, m.reason = True, "reference to a unique key"
            else:
                m.reason = "another column fits better"
    return matches


def match_schemas(profiles: list[DatasetProfile], sketches: dict[str, Sketch], settings: dict | None = None, strategy: Strategy = Strategy(), least: float | None = None,
                  crosswalks: dict[Pair, dict[str, str]] | None = None, scorer: Callable[[Match], float] | None = None,
                  encoder: type[ColumnEncoder] = TfIdf) -> list[Match]:
    """Scored, flooded and aligned column matches of all dataset pairs; a learned ``scorer`` has the last word on scores."""
    cfg = (settings or config.settings())["matching"]
    columns = {c.key: c for p in profiles for c in p.columns.values()}
    dataset_of = {k: c.dataset for k, c in columns.items()}
    index = encoder({k: column_document(c) for k, c in columns.items()})
    empty = Sketch({})
    matches = {}
    for a, b in candidate_pairs(profiles, sketches, cfg["lsh_pair_threshold"]):
        extra = None
        if crosswalks and (a, b) in crosswalks:
            table = crosswalks[(a, b)]
            extra = {"crosswalk": lambda v, table=table: table.get(v, v)}
        matches[(a, b)] = score_pair(columns[a], sketches.get(a, empty), columns[b], sketches.get(b, empty), index, cfg["weights"], strategy.signals, extra)
    if strategy.flooding and cfg["flooding"]["enabled"]:
        f = cfg["flooding"]
        for p, s in flood({p: m.score for p, m in matches.items()}, dataset_of, f["alpha"], f["beta"], f["center"], f["gamma"], f["max_iterations"], f["epsilon"]).items():
            matches[p].score = s
    if scorer is not None:
        for m in matches.values():
            m.score = scorer(m)
    kept = [m for m in matches.values() if m.score >= cfg["min_candidate_score"]]
    vetoed = {m.pair: "different identifier systems" for m in kept if columns[m.left].semantic == columns[m.right].semantic == "ID" and max(m.containment) < cfg["identifier_min_overlap"]}
    uniqueness = {k: c.uniqueness for k, c in columns.items()}
    merge = (settings or config.settings())["merge"]
    balanced = config.DEFAULTS["modes"]["balanced"]["min_edge"]
    return align(kept, uniqueness, dataset_of, least if least is not None else balanced, merge["key_uniqueness"], cfg["fk_min_containment"], strategy.one_to_one, vetoed)


# -- learned scorer -----------------------------------------------------------------------------------------------------------

FEATURES = ("name", "datatype", "semantic", "value_overlap", "distribution", "pattern", "cardinality")


def pair_features(m: Match) -> list[float]:
    """Twenty numbers: the seven signals, both containments, two products of signals and the profiles' shape."""
    e = [m.evidence[k] for k in FEATURES]
    return [*e, max(m.containment), min(m.containment), e[0] * e[3], e[2] * e[3], *(m.shape or (0.0,) * 9)]


def isotonic_line(points: list[tuple[float, float, float]]) -> Callable[[float], float]:
    """The non-decreasing step function nearest to (x, y, weight), by pooling adjacent violators, joined by lines."""
    pools: list[list[float]] = []  # sums of weight, of y and of x, and the last x
    for x, y, w in sorted(points):
        pools.append([w, w * y, w * x])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    xs, ys = [p[2] / p[0] for p in pools], [p[1] / p[0] for p in pools]
    return lambda x: float(np.interp(x, xs, ys)) if xs else x


def train_scorer(spark, examples: list[tuple[list[float], int, float]], groups: list | None = None, folds: int = 5):
    """A boosted-tree scorer of (features, label, weight): the calibrated probability that a pair of columns matches.

    With ``groups`` (such as the pair of datasets of each example) the trees' probabilities are calibrated by an isotonic
    line over predictions for groups that the trees have not seen, in at most ``folds`` parts.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Vectors

    width = len(examples[0][0])

    def fitted(some: list[tuple[list[float], int, float]]):
        frame = spark.createDataFrame([(*map(float, f), float(y), float(w)) for f, y, w in some], [*(f"f{i}" for i in range(width)), "label", "weight"])
        assembler = VectorAssembler(inputCols=[f"f{i}" for i in range(width)], outputCol="features")
        model = GBTClassifier(maxIter=20, maxDepth=3, seed=7, weightCol="weight").fit(assembler.transform(frame))
        return lambda f: float(model.predictProbability(Vectors.dense(f))[1])
    line: Callable[[float], float] = lambda x: x
    if groups is not None and len(set(groups)) > 1:
        order = {g: i % folds for i, g in enumerate(sorted(set(groups)))}
        points = []
        for k in sorted(set(order.values())):
            seen = [e for e, g in zip(examples, groups) if order[g] != k]
            if len({y for _, y, _ in seen}) == 2:
                guess = fitted(seen)
                points += [(guess(f), float(y), w) for (f, y, w), g in zip(examples, groups) if order[g] == k]
        if points:
            line = isotonic_line(points)
    whole = fitted(examples)
    return lambda m: line(whole(pair_features(m)))


# -- crosswalks ---------------------------------------------------------------------------------------------------------------


def verify_crosswalk(left: set[str], right: set[str], proposal: dict[str, str], coverage: float = 0.5, injectivity: float = 0.8, hallucinated: float = 0.2) -> tuple[dict[str, str] | None, str]:
    """The part of a proposed value map that the data bear out, or None with the reason for refusing it."""
    if not proposal:
        return None, "empty proposal"
    real = {a: b for a, b in proposal.items() if a in left and b in right}
    if 1 - len(real) / len(proposal) > hallucinated:
        return None, "too many values that do not occur"
    if sum(a != b for a, b in real.items()) < 2:
        return None, "nothing to translate"
    if len(real) / min(len(left), len(right)) < coverage:
        return None, "covers too few values"
    if len(set(real.values())) / len(real) < injectivity:
        return None, "maps different values to one"
    return real, "verified"


def crosswalk_candidates(profiles: list[DatasetProfile], sketches: dict[str, Sketch], matches: list[Match], small: int = 80, large: int = 400) -> list[Pair]:
    """Column pairs with small vocabularies that barely overlap and are not matched yet: worth a proposed value map."""
    columns = {c.key: c for p in profiles for c in p.columns.values()}
    accepted = {x for m in matches if m.accepted for x in m.pair}
    out = []
    for a, b in combinations(columns.values(), 2):
        if a.dataset == b.dataset or a.key in accepted or b.key in accepted or a.logical != "string" or b.logical != "string":
            continue
        x, y = sketches.get(a.key), sketches.get(b.key)
        if x is None or y is None or not (x.complete and y.complete):
            continue
        sizes = sorted((len(x.values), len(y.values)))
        if 3 <= sizes[0] <= small and sizes[1] <= large and max(overlap(x, y)[1:3]) < 0.5 and a.uniqueness < 1.01:
            out.append((type_compatibility(a.semantic, b.semantic) + name_similarity(a.name, b.name), (a.key, b.key)))
    return [p for _, p in sorted(out, key=lambda t: (-t[0], t[1]))]
