"""Entity groups in a session: resolved, fused, written, asked about and brought back."""

import os

import numpy as np
import pytest

from weft.operators import fusion
from weft.operators.joins import ROW
from weft.operators.resolution import random_review
from weft.plans.entity_groups import EntityGroup, GroupField, group_fields
from weft.plans.matching import Match
from weft.plans.planner import MergePlan, executed
from weft.plans.session import Session

FIRST = "anna bela carl dora emil fred gina hugo ines jane karl lena mona nils olga paul rita saul tina ugo".split()
LAST = "adams baker clark davis evans frank ghosh hills irwin jones klein lopez meyer novak owens patel quinn rossi singh turner".split()


def persons():
    """60 persons in one system; the first 40 and 20 others in the second, with other spellings, towns and dates."""
    crm, erp = [], []
    for i in range(80):
        first, last = FIRST[i % 20].title(), LAST[(i * 7 + i // 20) % 20].title()
        mail, phone, town = f"{first}.{last}{i}@mail.org".lower(), f"+1 555 010 {i:04d}", ["Pune", "Delhi", "Turin"][i % 3]
        if i < 60:
            crm.append((1000 + i, f"{first} {last}", mail, phone, town, f"2024-01-{i % 28 + 1:02d}"))
        if i < 40 or i >= 60:
            erp.append((f"M-{i}", f"{last.upper()}, {first}", mail if i % 4 else None, phone.replace(" ", "-"), "Oslo" if i % 8 == 1 else town, f"2024-03-{i % 28 + 1:02d}", float(i)))
    return crm, erp


@pytest.fixture(scope="module")
def frames(spark):
    crm, erp = persons()
    return (spark.createDataFrame(crm, "client_no long, client_name string, email string, phone string, city string, last_updated string"),
            spark.createDataFrame(erp, "member string, member_name string, mail string, telephone string, town string, updated_on string, score double"))


@pytest.fixture(scope="module")
def session(spark, frames, tmp_path_factory):
    from pyspark.sql import functions as F

    s = Session(spark, str(tmp_path_factory.mktemp("ws")))
    for name, df, at in (("crm", frames[0], "last_updated"), ("erp", frames[1], "updated_on")):
        s.add_frame(name, df.withColumn(at, F.to_date(at)).coalesce(1))
    fields = [GroupField("name", "NAME", "basic", {"crm": "client_name", "erp": "member_name"}), GroupField("mail", "EMAIL", "basic", {"crm": "email", "erp": "mail"}),
              GroupField("phone_no", "PHONE", "digits", {"crm": "phone", "erp": "telephone"}), GroupField("place", "CITY", "basic", {"crm": "city", "erp": "town"})]
    s.discover()
    s.merge = s.execute(MergePlan("crm", [], {}, [EntityGroup("G1", ["crm", "erp"], fields)], thresholds={"entity_merge": 0.5, "entity_review": 0.2}), csv=True)
    return s


def test_anchor_rows_keep_their_grain_and_get_their_entity(session):
    out = {r.client_no: r for r in session.unified().collect()}
    assert len(out) == 60 and session.merge.report["passed"], session.merge.report
    for i in range(60):
        r = out[1000 + i]
        assert r._entity_record_count == (2 if i < 40 else 1) and r._has_conflict == (i < 40 and i % 8 == 1), i
        assert r.place == ["Pune", "Delhi", "Turin"][i % 3] and (r.score == i if i < 40 else r.score is None)
        assert r.mail == r.email and r.client_name == f"{FIRST[i % 20]} {LAST[(i * 7 + i // 20) % 20]}".title()
    stats = session.merge.report["groups"]["G1"]
    assert (stats["records"], stats["entities"], stats["cross_source_links"], stats["within_dataset_duplicates"]) == (120, 80, 40, 0)
    names = {c["name"] for c in session.merge.report["checks"]}
    assert {"entity_assignment:G1", "conflicts_recorded:G1", "temporal_consistency:G1", "row_conservation", "no_fan_out", "root_values_preserved"} <= names


def test_what_a_merge_leaves(session):
    folder = session.merge.folder
    assert session.entities().count() == 80  # also those that the anchor has not
    assert os.path.isdir(os.path.join(folder, "unified_dataset.csv"))
    told = session.conflicts().collect()
    assert {r.attribute for r in told} == {"place"} and len(told) == 2 * sum(i % 8 == 1 for i in range(40))
    cells = session.cell_provenance().collect()
    assert {r.source_dataset for r in cells if r.attribute == "place"} == {"crm"} and {r.source_column for r in cells if r.attribute == "place"} == {"city"}
    assert all(r.strategy == ("majority_vote" if r.reason.startswith("chosen") else "agreement") for r in cells)


def test_history_says_what_held_when(session):
    h = session.entity_history(attribute="place").collect()
    assert len(h) == 2 * sum(i % 8 == 1 for i in range(40)) and all(r.timestamp_kinds == ["change"] for r in h)
    march, may = session.entity_history(attribute="place", as_of="2024-02-15 00:00:00"), session.entity_history(attribute="place", as_of="2024-05-01 00:00:00")
    assert "Oslo" not in {r.value for r in march.collect()} and {r.value for r in may.collect()} == {"Oslo"}
    from datetime import datetime
    assert session.entity_history(as_known_at=datetime(2000, 1, 1)) is None


def test_a_session_comes_back_with_its_merges(spark, session):
    session.save()
    back = Session.restore(spark, session.workspace.root)
    assert back.merges[-1].plan == session.merge.plan and back.unified().count() == 60 and back.frames["crm"].count() == 60
    assert back.entity_history(attribute="place").count() == session.entity_history(attribute="place").count()
    assert back.undo().id == session.merge.id and back.merges == [] and len(back.archive) == 1
    assert Session.restore(spark, session.workspace.root).archive == []


def test_canonical_fields(frames):
    from weft.operators.profile import ColumnProfile, DatasetProfile

    kinds = {"crm": {"name": "NAME", "price": "CURRENCY", "city": "CITY"}, "erp": {"full_name": "NAME", "cost": "CURRENCY", "town": "CITY"}}
    profiles = {d: DatasetProfile(d, 1, 0, {c: ColumnProfile(d, c, "string", semantic=k) for c, k in cols.items()}) for d, cols in kinds.items()}
    matches = [Match("crm.name", "erp.full_name", .9, accepted=True), Match("crm.price", "erp.cost", .9, accepted=True), Match("crm.city", "erp.town", .8, norm="semantic:CITY", accepted=True),
               Match("crm.city", "erp.full_name", .2)]
    got = group_fields(["crm", "erp"], matches, profiles)
    assert [(f.semantic, f.norm, f.columns) for f in sorted(got, key=lambda f: f.semantic)] == [("CITY", "semantic:CITY", {"crm": "city", "erp": "town"}), ("NAME", "basic", {"crm": "name", "erp": "full_name"})]


def test_strategies_and_numbers_at_entity_grain(spark):
    a = spark.createDataFrame([(0, "Jane Doe", "j@x.org", "red"), (1, "Mark Roe", "m@x.org", "blue")], f"{ROW} long, name string, mail string, colour string")
    b = spark.createDataFrame([(0, "DOE, Jane", "j@x.org", "green", 2.0, 3), (1, "Jane Doe", "j@x.org", "green", 4.0, 5)], f"{ROW} long, person string, email string, shade string, orders_amount_sum double, orders_record_count int")
    from weft.plans.entity_groups import attached, fuse

    group = EntityGroup("G1", ["a", "b"], [GroupField("n", "NAME", "basic", {"a": "name", "b": "person"}), GroupField("m", "EMAIL", "basic", {"a": "mail", "b": "email"}), GroupField("hue", "CATEGORY", "basic", {"a": "colour", "b": "shade"})])
    from weft.operators.profile import DatasetProfile

    profiles = {"a": DatasetProfile("a", 2, 0, {}), "b": DatasetProfile("b", 2, 0, {})}
    labels = spark.createDataFrame([("a:000000000000", "b:000000000000", True), ("a:000000000000", "b:000000000001", True), ("a:000000000001", "b:000000000000", False), ("a:000000000001", "b:000000000001", False)], "a string, b string, same boolean")
    totals = {"b": {"orders_amount_sum": "sum", "orders_record_count": "count"}}
    for strategy, want in (("majority_vote", "green"), ("keep_all", '["red","green"]')):
        fused = fuse(group, {"a": a, "b": b}, profiles, totals, strategy, labels=labels)
        got = {r.name: r for r in attached(a, fused).collect()}
        assert got["Jane Doe"].hue == want and got["Jane Doe"].orders_amount_sum == 6.0 and got["Jane Doe"].orders_record_count == 8 and got["Mark Roe"].hue == "blue", strategy
        assert got["Jane Doe"].n == "Jane Doe" or strategy == "keep_all"
        assert got["Jane Doe"]._entity_record_count == 3 and fused.conflicts.count() == 1


def test_random_review_ignores_scores(spark):
    pairs = spark.createDataFrame([(i, i + 1, float(p)) for i, p in enumerate(np.linspace(0, 1, 200))], "a long, b long, p double")
    got = random_review(pairs, 30).collect()
    assert len(got) == 30 and all(0.01 < r.p < 0.999 for r in got) and np.std([r.p for r in got]) > 0.15
    assert fusion.united_histories([]) is None
