"""The session: datasets in, discovery, plan, merge, questions to the result, labels and undo."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import config
from weft.functions.values import mapped, register_normalizer
from weft.operators import fusion, uncertainty, validation
from weft.operators.joins import ROW, agreement, match_statistics
from weft.operators.clustering import concurrently, stored
from weft.operators.profile import DatasetProfile, bottom_k, cell_counts, issues, profile
from weft.operators.resolution import MatchField, Resolution, random_review, resolve, review_queue
from weft.plans import graph as g
from weft.plans import lineage
from weft.plans.matching import ColumnEncoder, Match, Sketch, Strategy, TfIdf, crosswalk_candidates, match_schemas, verify_crosswalk
from weft.plans.entity_groups import EntityGroup, GroupField, group_statistics
from weft.plans.planner import Attachment, MergePlan, Transform, build_plan, effective_thresholds, executed, relationship_flags
from weft.plans.relationships import LOOKUP, Relationship, infer
from weft.sources.readers import Dataset, Workspace, ingest, read_rest, numbered
from weft.sources.sinks import write_cell_provenance, write_conflicts, write_entities, write_history, write_reports, write_unified


@dataclass
class Merge:
    id: str
    plan: MergePlan
    folder: str
    rows: int
    report: dict
    recorded_at: datetime
    outdated: bool = False


@dataclass
class Preferences:
    mode: str = "balanced"
    strategy: str = "majority_vote"
    priority: list[str] = field(default_factory=list)
    primary: str | None = None
    thresholds: dict[str, float] = field(default_factory=dict)


class Session:
    """Keeps datasets, their profiles and what was found about them; discovery is redone when something changed."""

    def __init__(self, spark: SparkSession, root: str | None = None, proposer=None, **overrides):
        self.spark = spark
        # Discovery, plans and merges of frames keep no files; on a cluster what does keep some asks for a root then.
        own = tempfile.mkdtemp(prefix="weft-session-") if root is None and spark.sparkContext.master.startswith("local") else None
        self.workspace = Workspace(root or own)
        self.settings = config.settings(**overrides)
        self.proposer = proposer
        self.preferences = Preferences()
        self.datasets: dict[str, Dataset] = {}
        self.frames: dict[str, DataFrame] = {}
        self.profiles: dict[str, DatasetProfile] = {}
        self.sketches: dict[str, Sketch] = {}
        self.decisions: dict[tuple[str, str], bool] = {}
        self.matches: list[Match] = []
        self.relations: list[Relationship] = []
        self.labels: list[tuple[str, str, bool]] = []
        self.drawn: set[tuple[str, str]] = set()  # pairs that chance chose for review: only their labels calibrate
        self.crosswalks: dict[tuple[str, str], dict[str, str]] = {}  # verified value maps by pair of columns
        self.refused: set[tuple[str, str]] = set()
        self.scorer = None
        self.merges: list[Merge] = []
        self.archive: list[Merge] = []
        self.stale = True

    # -- datasets ---------------------------------------------------------------------------------------------------------

    def add_file(self, path: str, name: str | None = None, **options: str) -> Dataset:
        d = ingest(self.spark, self.workspace, path, name, set(self.datasets), **options)
        return self._added(d, d.frame(self.spark))

    def add_files(self, path: str) -> list[Dataset]:
        """A dataset for each table of a SQLite file, or one of any other file."""
        from weft.sources.detect import detect_format
        from weft.sources.readers import sqlite_tables

        if detect_format(path) == "sqlite":
            return [self.add_file(path, t, table=t) for t in sqlite_tables(path)]
        return [self.add_file(path)]

    def add_frame(self, name: str, df: DataFrame) -> Dataset:
        df = df if ROW in df.columns else numbered(df)
        return self._added(Dataset(name, "frame", "frame", "", columns=[c for c in df.columns if c != ROW]), df)

    def add_rest(self, url: str, name: str, params: dict[str, str] | None = None, page_size: int = 1000) -> Dataset:
        return self.add_frame(name, read_rest(self.spark, url, params, page_size))

    def _added(self, d: Dataset, df: DataFrame) -> Dataset:
        self.datasets[d.id], self.frames[d.id] = d, df
        self._invalidate()
        return d

    def remove_dataset(self, name: str) -> None:
        for table in (self.datasets, self.frames, self.profiles):
            table.pop(name, None)
        self._invalidate()

    def _invalidate(self) -> None:
        self.stale = True
        for m in self.merges:
            m.outdated = True

    def profile(self, name: str) -> DatasetProfile:
        if name not in self.profiles:
            df = self.frames[name].drop(ROW)
            counts = stored(cell_counts(df))
            k = self.settings["matching"]["sketch_size"]
            by_column = F.map_from_entries(F.collect_list(F.struct("value", "h"))).alias("v"), F.bool_and("complete").alias("c")
            made, sketches = concurrently(lambda: profile(df, name, counts=counts), lambda: bottom_k(df, k=k, counts=counts).groupBy("column").agg(*by_column).collect())
            for r in sketches:
                self.sketches[f"{name}.{r['column']}"] = Sketch(dict(r["v"]), r["c"])
            self.profiles[name] = made
        return self.profiles[name]

    def preview(self, name: str, limit: int = 50, offset: int = 0) -> DataFrame:
        return self.frames[name].orderBy(ROW).offset(offset).limit(min(limit, 500))

    def record(self, name: str, rows: list[int], columns: list[str] | None = None) -> DataFrame:
        df = self.frames[name].where(F.col(ROW).isin(*rows))
        return df.select(ROW, *(columns or [c for c in df.columns if c != ROW]))

    def duplicates(self) -> dict[str, int]:
        return {n: self.profile(n).duplicates for n in self.datasets}

    def issues(self) -> list[str]:
        """What to look at before integrating, references without a match among it once relationships are known."""
        found = issues([self.profile(n) for n in self.datasets])
        orphans = [r for r in self.relations if r.kind == LOOKUP and r.keys and r.coverage < 1]
        return found + [f"{r.left}.{r.keys[0][0]}: {1 - r.coverage:.1%} of references are not in {r.right}" for r in orphans]

    # -- discovery --------------------------------------------------------------------------------------------------------

    def discover(self, strategy: Strategy = Strategy(), encoder: type[ColumnEncoder] = TfIdf) -> list[Relationship]:
        """Profiles, matches and relates all datasets; a retrained matcher, where there is one, scores the matches."""
        profiles = concurrently(*[lambda n=n: self.profile(n) for n in self.datasets])
        least = max(effective_thresholds(self.preferences.mode)["min_edge"], self.preferences.thresholds.get("min_edge", 0.0))
        self.matches = match_schemas(profiles, self.sketches, self.settings, strategy, least, self.crosswalks or None, self.scorer, encoder)
        if self.proposer is not None:
            self._crosswalks(profiles, least, strategy)
        for m in self.matches:
            if m.pair in self.decisions:
                m.accepted, m.reason = self.decisions[m.pair], "decided by the user"
        self.relations = infer(profiles, self.matches, self.sketches, self.settings)
        self._verify_rows()
        self.graph = g.IntegrationGraph()
        for n in self.datasets:
            self.graph.add_dataset(n, list(self.profile(n).columns), rows=self.profile(n).rows)
        self.graph.add_matches(self.matches)
        self.graph.add_relationships(self.relations)
        self.stale = False
        return self.relations

    def _crosswalks(self, profiles: list[DatasetProfile], least: float, strategy: Strategy) -> None:
        found = {}
        cfg = self.settings["matching"]["crosswalk"]
        for a, b in crosswalk_candidates(profiles, self.sketches, self.matches):
            if (a, b) in self.crosswalks or (a, b) in self.refused:
                continue  # proposals are asked for once
            proposal = self.proposer({"left": sorted(self.sketches[a].values), "right": sorted(self.sketches[b].values)})
            table, _ = verify_crosswalk(set(self.sketches[a].values), set(self.sketches[b].values), proposal, cfg["min_coverage"], cfg["min_injectivity"], cfg["max_hallucinated"])
            if table:
                found[(a, b)] = table
            else:
                self.refused.add((a, b))
        if found:
            self.crosswalks |= found
            for (a, b), table in found.items():
                register_normalizer(f"crosswalk:{a}~{b}", mapped(table))
            self.matches = match_schemas(profiles, self.sketches, self.settings, strategy, least, self.crosswalks, self.scorer)

    def _verify_rows(self) -> None:
        """Attribute matches between key-joined datasets must agree on the joined rows."""
        floor, sample = self.settings["merge"]["min_agreement"], self.settings["merge"]["verify_sample"]
        for r in self.relations:
            if not r.keys or r.kind != LOOKUP:
                continue
            ref, key = r.keys[0]
            attributes = []
            for m in r.matches:
                a, b = (m.left, m.right) if m.left.startswith(r.left + ".") else (m.right, m.left)
                x, y = a.split(".", 1)[1], b.split(".", 1)[1]
                if (x, y) not in r.keys and x != ref and y != key and m.pair not in self.decisions:
                    attributes.append((m, x, y))
            if not attributes:
                continue
            got = {(q["left_column"], q["right_column"]): q for q in agreement(self.frames[r.left], self.frames[r.right], ref, key, [(x, y) for _, x, y in attributes], r.norm, sample).collect()}
            for m, x, y in attributes:
                q = got[(x, y)]
                if q["compared"] >= 30 and q["agreed"] / q["compared"] < floor:
                    m.accepted, m.reason = False, f"agrees on {q['agreed']} of {q['compared']} joined rows"

    def _fresh(self) -> None:
        if self.stale:
            self.discover()

    def compare_schemas(self, a: str, b: str) -> list[Match]:
        self._fresh()
        return [m for m in self.matches if {m.left.split(".")[0], m.right.split(".")[0]} == {a, b}]

    def explain_match(self, left: str, right: str) -> str:
        self._fresh()
        return next((g.explain_match(m, self.settings["matching"]["weights"]) for m in self.matches if {m.left, m.right} == {left, right}), "no such pair")

    def explain_relationship(self, a: str, b: str) -> str:
        self._fresh()
        return next((g.explain_relationship(r) for r in self.relations if r.pair == frozenset((a, b))), "no relationship")

    def route(self, a: str, b: str, k: int = 3, mode: str | None = None) -> list[str]:
        self._fresh()
        return [g.explain_route(p, c) for p, c in g.routes(self.graph.datasets()[1], a, b, k, mode or self.settings["graph"]["path_cost"])]

    def column_route(self, left: str, right: str, k: int = 1) -> list[str]:
        """Routes from one column to another along accepted correspondences and the datasets that hold both ends."""
        self._fresh()
        edges = [(m.left, m.right, m.score) for m in self.matches if m.accepted]
        edges += [(f"{p.dataset}.{c}", f"{p.dataset}.", 1.0) for p in self.profiles.values() for c in p.columns]
        return [g.explain_route([x for x in path if not x.endswith(".")], c) for path, c in g.routes(edges, left, right, k, self.settings["graph"]["path_cost"])]

    def decide_match(self, left: str, right: str, accept: bool) -> None:
        """Pins a pair of columns as the same or not."""
        pair = next((m.pair for m in self.matches if {m.left, m.right} == {left, right}), (left, right))
        self.decisions[pair] = accept
        self._invalidate()

    def graph_view(self) -> dict:
        self._fresh()
        names, edges = self.graph.datasets()
        keys = {n: [c.name for c in self.profile(n).columns.values() if c.semantic == "ID" and c.uniqueness >= 0.98] for n in names}
        references = [(f"{r.left}.{a}", f"{r.right}.{b}") for r in self.relations if r.kind == LOOKUP for a, b in r.keys]
        links = [(r.left, r.right, r.kind) for r in self.relations if r.kind != LOOKUP]
        return {"layout": g.layered_layout(names, [(r.left, r.right) for r in self.relations]), "edges": edges, "keys": keys, "references": references, "links": links, **self.graph.stats()}

    # -- entities -----------------------------------------------------------------------------------------------------------

    def records_of(self, datasets: list[str], columns: dict[str, dict[str, str]]) -> DataFrame:
        """Compared fields of several datasets in one frame: rid, dataset, row and the output names of ``columns``."""
        out = None
        for d in datasets:
            one = self.frames[d].select(F.concat(F.lit(d + ":"), F.lpad(F.col(ROW).cast("string"), 12, "0")).alias("rid"), F.lit(d).alias("dataset"), F.col(ROW).alias("row"),
                                        *[F.col(c).cast("string").alias(n) for n, c in columns[d].items()])
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def entity_match_preview(self, datasets: list[str], columns: dict[str, dict[str, str]], fields: list[MatchField], dedupe: tuple[str, ...] = ()) -> Resolution:
        limits = effective_thresholds(self.preferences.mode, **self.preferences.thresholds)
        frame = self.spark.createDataFrame(self.labels, "a string, b string, same boolean") if self.labels else None
        return resolve(self.records_of(datasets, columns), fields, dedupe, limits["entity_merge"], limits["entity_review"], labels=frame, calibration=self._calibration())

    def _calibration(self) -> DataFrame | None:
        fair = [x for x in self.labels if x[:2] in self.drawn]
        return self.spark.createDataFrame(fair, "a string, b string, same boolean") if fair else None

    def entity_review_queue(self, found: Resolution, limit: int = 20) -> DataFrame:
        known = self.spark.createDataFrame([(min(a, b), max(a, b)) for a, b, _ in self.labels] or [], "a string, b string")
        return review_queue(found.pairs.join(known, ["a", "b"], "left_anti"), limit)

    def review_links(self, group: EntityGroup, limit: int = 10, at_random: float = 0.3) -> list[dict]:
        """Pairs of a group worth a label: the most doubtful, and a share drawn at random, whose labels calibrate."""
        columns = {d: {f.columns[d]: f"f_{f.name}" for f in group.fields if d in f.columns} for d in group.datasets}
        found = self.entity_match_preview(group.datasets, columns, [MatchField(f"f_{f.name}", f.semantic, f.norm) for f in group.fields], tuple(group.datasets))
        n = round(limit * at_random)
        known = self.spark.createDataFrame([(min(a, b), max(a, b)) for a, b, _ in self.labels] or [], "a string, b string")
        drawn = random_review(found.pairs.join(known, ["a", "b"], "left_anti"), n).collect()
        self.drawn |= {(r["a"], r["b"]) for r in drawn}
        rows = [(r, "random") for r in drawn] + [(r, "uncertain") for r in self.entity_review_queue(found, limit).collect() if (r["a"], r["b"]) not in {(x["a"], x["b"]) for x in drawn}]
        return [{"a": r["a"], "b": r["b"], "p": r["p"], "sampling": how} for r, how in rows[:limit]]

    def label_entity_link(self, a: str, b: str, same: bool) -> None:
        for x in (a, b):
            name, row = x.split(":")
            if name not in self.datasets or not 0 <= int(row) < self.profile(name).rows:
                raise ValueError(f"no such record: {x}")
        self.labels = [(x, y, s) for x, y, s in self.labels if {x, y} != {a, b}] + [(min(a, b), max(a, b), same)]

    # -- merging ------------------------------------------------------------------------------------------------------------

    def set_preferences(self, **values) -> None:
        for k, v in values.items():
            setattr(self.preferences, k, v)
        self._invalidate()

    def make_plan(self) -> MergePlan:
        self._fresh()
        return build_plan(list(self.profiles.values()), self.relations, self.preferences.mode, self.preferences.primary, **self.preferences.thresholds)

    def execute(self, plan: MergePlan | None = None, csv: bool = False) -> Merge:
        """Carries a plan out and writes what it leaves: the unified table (``csv``: as CSV too), entities, histories,
        cell provenance and conflicts of its groups, and the reports."""
        plan = plan or self.make_plan()
        labels = self.spark.createDataFrame(self.labels, "a string, b string, same boolean") if self.labels else None
        done = executed(plan, self.frames, self.profiles, self.preferences.strategy, labels, self.preferences.priority, self._calibration())
        id_ = f"merge_{len(self.merges) + 1}_{uuid.uuid4().hex[:6]}"
        folder = self.workspace.folder("merges", id_)
        os.makedirs(folder, exist_ok=True)
        back = write_unified(done.unified, folder, csv)
        at = datetime.now()
        groups, checks = {}, []
        provenance = conflicts = None
        for gid, fused in done.groups.items():
            groups[gid] = group_statistics(fused)
            write_entities(fused.entities, folder, gid)
            if fused.history is not None:
                write_history(fused.history, folder, gid, at)
            provenance = fused.provenance if provenance is None else provenance.unionByName(fused.provenance)
            conflicts = fused.conflicts if conflicts is None else conflicts.unionByName(fused.conflicts)
            checks += validation.group_checks(gid, fused.assignment, fused.entities, groups[gid]["conflicts"])
            if fused.history is not None:
                n = fusion.history_violations(fused.history).count()
                checks.append(validation.Check(f"temporal_consistency:{gid}", n == 0, f"{n} violations"))
        if provenance is not None:
            write_cell_provenance(provenance, folder)
            write_conflicts(conflicts, folder)
        aliases = [a.alias for a in plan.attachments if f"_match_{a.alias}" in back.columns]
        source = self.frames[plan.root]
        kept = {c: c for c in source.columns if c != ROW and c in back.columns and c not in {t.column for t in plan.transforms.get(plan.root, [])}}
        found = [r.asDict() for r in match_statistics(back, aliases).collect()] if aliases else []
        checks = validation.validate(source, back, aliases, kept) + validation.join_checks([(a.alias, a.kind, a.parent, a.child) for a in plan.attachments], {plan.root: self.profile(plan.root).rows}, found) + checks
        checks += validation.source_checks([(d.id, d.copy, d.source, d.sha256) for d in self.datasets.values() if d.id in plan.datasets()])
        checks += validation.date_checks(done.ready, {d: [t.column for t in ts if t.kind in ("parse_date", "parse_timestamp")] for d, ts in plan.transforms.items() if d in done.ready})
        rates = {r["alias"]: r["matched"] / max(1, r["rows"]) for r in found}
        expected = uncertainty.uncertain_rows(back).first()
        rows = back.count()
        report = validation.quality_report(checks, rates, expected["expected_rows"] or 0.0, rows) | {"groups": groups}
        merge = Merge(id_, plan, folder, rows, report, at)
        write_reports(folder, merge_report=report, schema_mapping=[asdict(m) for m in self.matches if m.accepted], integration_graph=json.loads(self.graph.to_json()),
                      provenance=lineage.prov_document(plan, id_, rows), data_quality_report=validation.report_text(report))
        self.merges.append(merge)
        return merge

    def unified(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.merges[-1].folder, "unified_dataset.parquet"))

    def aggregate_with_uncertainty(self, function: str, measure: str | None = None, group_by: str | None = None, **options) -> DataFrame:
        unified = self.unified()
        options.setdefault("scenarios", relationship_flags(self.merges[-1].plan, unified.columns))
        return uncertainty.aggregate_with_uncertainty(unified, function, measure, group_by, **options)

    def _group_files(self, merge: Merge, prefix: str) -> list[str]:
        return sorted(os.path.join(merge.folder, f) for f in os.listdir(merge.folder) if f.startswith(prefix) and f.endswith(".parquet"))

    def entities(self, group: str = "G1") -> DataFrame:
        """The entities of a group of the last merge, also those that no row of the unified table has."""
        return self.spark.read.parquet(os.path.join(self.merges[-1].folder, f"entities_{group}.parquet"))

    def cell_provenance(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.merges[-1].folder, "cell_provenance.parquet"))

    def conflicts(self, found: DataFrame | None = None, attribute: str | None = None, entity: str | None = None, limit: int = 200) -> DataFrame:
        """Conflicts of the last merge (or of ``found``), a row for each candidate, by entity and attribute."""
        if found is None:
            found = self.spark.read.csv(os.path.join(self.merges[-1].folder, "conflicts.csv"), header=True)
        for column, value in (("attribute", attribute), ("entity_id", entity)):
            if value is not None:
                found = found.where(F.col(column) == value)
        return found.orderBy("entity_id", "attribute").limit(limit)

    def retrain_matcher(self, weight: float = 10.0):
        """A learned scorer from the user's decisions over the current matches; None with fewer than two of each kind."""
        from weft.plans.matching import pair_features, train_scorer

        examples = [(pair_features(m), int(self.decisions.get(m.pair, m.accepted)), weight if m.pair in self.decisions else 1.0) for m in self.matches]
        if min(sum(y for _, y, _ in examples), sum(1 - y for _, y, _ in examples)) < 2:
            return None
        groups = ["~".join(sorted(x.split(".", 1)[0] for x in m.pair)) for m in self.matches]
        self.scorer = train_scorer(self.spark, examples, groups)
        self._invalidate()
        return self.scorer

    def entity_history(self, history: DataFrame | None = None, entity: str | None = None, attribute: str | None = None, as_of=None, as_known_at=None) -> DataFrame | None:
        """What held at ``as_of``, as the last merge at or before ``as_known_at`` (default: the last of all) recorded it."""
        if history is None:
            known = [m for m in self.merges if as_known_at is None or m.recorded_at <= as_known_at]
            files = self._group_files(known[-1], "entity_history_") if known else []
            if not files:
                return None
            history = fusion.united_histories([(known[-1].recorded_at, self.spark.read.parquet(f).drop("recorded_at")) for f in files])
        return fusion.history_at(history, F.lit(as_of).cast("timestamp_ntz") if as_of is not None else None, entity, attribute)

    def lineage_report(self) -> str:
        return lineage.report(self.merges[-1].plan, self.frames)

    def undo(self) -> Merge | None:
        """Takes the last merge back; its folder stays, in the archive."""
        if not self.merges:
            return None
        merge = self.merges.pop()
        self.archive.append(merge)
        return merge

    def stats(self) -> dict:
        return {"datasets": len(self.datasets), "rows": {n: self.profile(n).rows for n in self.datasets}, "matches": sum(m.accepted for m in self.matches), "relationships": len(self.relations), "merges": len(self.merges)}

    # -- persistence ----------------------------------------------------------------------------------------------------------

    def save(self) -> str:
        """Decisions, labels, preferences, merges and datasets as JSON, replaced in one step; frames without a file of their
        own are written as Parquet."""
        path = os.path.join(self.workspace.base(), "session.json")
        for d in self.datasets.values():
            if not d.path:
                d.path = self.workspace.folder("frames", f"{d.id}_{uuid.uuid4().hex[:6]}")
                self.frames[d.id].write.parquet(d.path)
        state = {"version": 2, "datasets": [asdict(d) for d in self.datasets.values()], "decisions": [[a, b, v] for (a, b), v in self.decisions.items()], "labels": self.labels, "drawn": sorted(self.drawn),
                 "preferences": asdict(self.preferences), "merges": [_merge_state(m) for m in self.merges], "archive": [_merge_state(m) for m in self.archive]}
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump(state, f)
        os.replace(path + ".new", path)
        return path

    @classmethod
    def restore(cls, spark: SparkSession, root: str) -> Session:
        """A session as it was saved, with its merges and what they wrote."""
        with open(os.path.join(root, "session.json"), encoding="utf-8") as f:
            state = json.load(f)
        if state["version"] != 2:
            raise ValueError("saved by another version")
        s = cls(spark, root)
        for d in state["datasets"]:
            s.datasets[d["id"]] = Dataset(**d)
            s.frames[d["id"]] = s.datasets[d["id"]].frame(spark)
        s.decisions = {(a, b): v for a, b, v in state["decisions"]}
        s.labels = [tuple(x) for x in state["labels"]]
        s.drawn = {tuple(x) for x in state["drawn"]}
        s.preferences = Preferences(**state["preferences"])
        s.merges, s.archive = ([_merge_from(m) for m in state[k]] for k in ("merges", "archive"))
        return s


def _merge_state(m: Merge) -> dict:
    return asdict(m) | {"recorded_at": m.recorded_at.isoformat()}


def _merge_from(state: dict) -> Merge:
    p = state["plan"]
    groups = [EntityGroup(g["id"], g["datasets"], [GroupField(**f) for f in g["fields"]]) for g in p["entity_groups"]]
    plan = MergePlan(p["root"], [Attachment(**a) for a in p["attachments"]], {d: [Transform(**t) for t in ts] for d, ts in p["transforms"].items()}, groups,
                     [tuple(x) for x in p["excluded"]], p["unreached"], p["thresholds"])
    return Merge(state["id"], plan, state["folder"], state["rows"], state["report"], datetime.fromisoformat(state["recorded_at"]), state["outdated"])
