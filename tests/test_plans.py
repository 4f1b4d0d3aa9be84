"""Names, matching, relationships, graph, planner, sources and the session."""

import csv
import json
import math
import sqlite3
import uuid
import zipfile

import numpy as np
import pytest

from weft.operators.profile import ColumnProfile, DatasetProfile, cardinality_label, profile
from weft.plans import graph as g
from weft.plans import lineage
from weft.plans.assignment import assign
from weft.plans.matching import Match, Sketch, align, flood, name_similarity, overlap, verify_crosswalk
from weft.plans.names import NameAllocator, canonical_name, name_tokens, role_of, snake
from weft.plans.planner import aggregate_function, build_plan, effective_thresholds
from weft.plans.relationships import Relationship
from weft.plans.session import Session
from weft.sources import csv as wcsv
from weft.sources.detect import UnsupportedFormat, dataset_id, detect_format
from weft.sources.readers import Workspace, extract_records, fetch_pages, flatten_record, ingest, read_any


def test_names():
    assert name_tokens("custID") == ("customer", "identifier") and snake("PULocationID") == "pu_location_id"
    assert name_similarity("cust_name", "customer_name") == 1.0 and name_similarity("city", "amount") < .4
    assert role_of("PULocationID", "LocationID") == "pickup" and role_of("cust_id", "customer_id") is None
    assert canonical_name([("a", "cust_nm"), ("b", "customer_name")], ["a", "b"]) == "customer_name"
    n = NameAllocator()
    assert [n.allocate("city", q) for q in ("x", "y", "y")] == ["city", "y_city", "y_city_2"]


def test_assignment_against_all_permutations():
    from itertools import permutations
    rng = np.random.default_rng(0)
    for shape in ((4, 4), (3, 5), (5, 3)):
        gain = rng.random(shape)
        got = sum(gain[i, j] for i, j in assign(gain))
        small, big = min(shape), max(shape)
        t = gain if shape[0] <= shape[1] else gain.T
        assert abs(got - max(sum(t[i, p[i]] for i in range(small)) for p in permutations(range(big), small))) < 1e-12


def test_alignment_flooding_and_crosswalks():
    ms = [Match("a.x", "b.x", .9), Match("a.x", "b.y", .8), Match("a.z", "b.y", .6), Match("a.z", "b.w", .3)]
    align(ms, {}, {m: m[0] for m in ("a.x", "a.z", "b.x", "b.y", "b.w")}, .55)
    assert [m.accepted for m in ms] == [True, False, True, False]
    s = flood({("a.x", "b.x"): .6, ("b.x", "c.x"): .9, ("a.x", "c.x"): .9}, {"a.x": "a", "b.x": "b", "c.x": "c"})
    assert s[("a.x", "b.x")] > .6
    table, why = verify_crosswalk({"ca", "ny", "tx"}, {"california", "new york", "texas"}, {"ca": "california", "ny": "new york", "tx": "texas"})
    assert table and why == "verified" and verify_crosswalk({"ca"}, {"x"}, {"zz": "yy"})[0] is None
    assert overlap(Sketch({"a": 1, "b": 2}), Sketch({"b": 2, "c": 3})) == (1 / 3, .5, .5, 1)


def test_graph():
    edges = [("a", "b", .9), ("b", "c", .9), ("a", "c", .45)]
    assert g.routes(edges, "a", "c")[0][0] == ["a", "b", "c"] and abs(g.routes(edges, "a", "c")[0][1] - .81) < 1e-12
    three = [("a", "b", .8), ("b", "c", .8), ("c", "d", .8), ("a", "d", .45)]
    assert g.routes(three, "a", "d", mode="neglog")[0][0] == ["a", "b", "c", "d"] and g.routes(three, "a", "d", mode="linear")[0][0] == ["a", "d"]
    kept, dropped = g.spanning_forest(edges)
    assert dropped == [("a", "c", .45)] and len(kept) == 2
    assert g.components(["a", "b", "c", "z"], edges) == [["a", "b", "c"], ["z"]]
    layout = g.layered_layout(["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")])
    assert layout["a"][0] == 0 and layout["c"][0] == 2 and math.isclose(g.cost(1.0), 0)


def test_planner_rules():
    assert effective_thresholds("strict")["min_edge"] == .85 and effective_thresholds("balanced", min_edge=.6)["min_edge"] == .6
    assert [aggregate_function(*x) for x in (("unit_price", "float", "CURRENCY"), ("total_amount", "float", "CURRENCY"), ("cust_id", "integer", "ID"), ("city", "string", "CITY"), ("note", "string", "FREE_TEXT"), ("day", "date", "DATE"))] == ["sum", "sum", "count_distinct", "mode", None, "max"]
    assert aggregate_function("household_income", "float", "CURRENCY") == "avg" and aggregate_function("code", "string", "ID") is None
    assert [cardinality_label(*x) for x in ((0, 0), (1, 9), (100, 100), (60, 100), (5, 1000), (200, 1000))] == ["empty", "constant", "unique", "high", "low", "medium"]
    ps = [DatasetProfile(n, r, 0, {}) for n, r in (("orders", 100), ("customer", 10), ("nation", 5))]
    rel = [Relationship("LOOKUP", "orders", "customer", [("cust", "id")], .9), Relationship("LOOKUP", "customer", "nation", [("n", "id")], .8)]
    plan = build_plan(ps, rel)
    assert plan.root == "orders" and [a.alias for a in plan.attachments] == ["customer", "nation"]
    assert build_plan(ps, rel, primary="customer").attachments[0].kind == "AGGREGATE_LOOKUP"
    assert any("customer" in s for s in plan.steps()) and "weft:nation" in lineage.prov_document(plan, "m", 3)["entity"]


def test_column_profile_types(spark):
    rows = [(i, f"Person {chr(65 + i % 26)}x", f"u{i}@mail.org", f"{i % 28 + 1:02d}/03/2024", ["Pune", "Delhi"][i % 2], float(i), "7") for i in range(60)]
    p = profile(spark.createDataFrame(rows, "cust_id long, full_name string, email string, signup_date string, city string, total_amount double, n string"), "d")
    assert {c: p.columns[c].semantic for c in ("cust_id", "full_name", "email", "signup_date", "city", "total_amount")} == {"cust_id": "ID", "full_name": "NAME", "email": "EMAIL", "signup_date": "DATE", "city": "CITY", "total_amount": "CURRENCY"}
    assert p.columns["signup_date"].dayfirst and p.columns["n"].logical == "integer" and p.duplicates == 0


def test_detection_and_reading(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(tmp_path / name)
    plain = put("a.csv", "zip,signup,amount\n00501,2024-01-05,10\n10001,05/02/2024,11.5\n02134,23/03/2024,\n")
    assert detect_format(plain) == "csv"
    df = read_any(spark, plain)
    assert dict(df.dtypes) == {"zip": "string", "signup": "string", "amount": "double"} and df.count() == 3
    lines = put("b.json", '{"a": 1, "b": {"c": [1, 2]}}\n{"a": 2, "b": {"c": []}}\n')
    assert detect_format(lines) == "jsonl" and read_any(spark, lines).columns == ["a", "b.c"]
    doc = put("c.json", json.dumps({"source": "x", "records": [{"id": 1, "address": {"city": "Pune", "zip": "1"}, "tags": ["a"]}, {"id": "two"}]}))
    got = read_any(spark, doc)
    assert detect_format(doc) == "json" and got.columns == ["id", "address.city", "address.zip", "tags"] and dict(got.dtypes)["id"] == "string"
    spark.range(3).write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("*.parquet"))
    assert detect_format(put("odd.bin", part.read_bytes())) == "parquet"
    with pytest.raises(UnsupportedFormat):
        detect_format(put("x.bin", b"\0\1\2" * 50))
    assert dataset_id("My File.csv", {"my_file"}) == "my_file_2"
    assert extract_records([["a", "b"], [1, 2]]) == [{"a": 1, "b": 2}] and flatten_record({"a": {"b": [1]}}) == {"a.b": "[1]"}
    with pytest.raises(ValueError):
        extract_records([1, 2])
    pages = {0: [{"i": 1}, {"i": 2}], 2: [{"i": 3}]}
    assert len(fetch_pages("http://h/x", page_size=2, get=lambda u: json.dumps(pages[int(u.split("offset=")[1])]).encode())) == 3


def test_ragged_csv_is_repaired(spark, tmp_path):
    path = tmp_path / "r.csv"
    with open(path, "w") as f:
        f.write("id,customer,address,city,weight_kg,shipped\n")
        for i in range(200):
            weight = "NULL" if i % 10 == 0 else f"{i}.5"
            address = f"{i} Main St, Floor {i}" if i % 3 == 0 else f"{i} Main St"
            f.write(f"{i},Name {chr(65 + i % 26)},{address},Pune,{weight},2024-01-0{i % 9 + 1}\n")
    df = wcsv.read_csv(spark, str(path))
    assert df.columns == ["id", "customer", "address", "city", "weight_kg", "shipped"] and df.count() == 200
    assert dict(df.dtypes)["weight_kg"] == "double" and df.where("weight_kg IS NULL").count() == 20 and df.where("city = 'Pune'").count() == 200


def workbook(path, rows):
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + j)}{i + 1}"' + (f'><v>{v}</v></c>' if isinstance(v, (int, float)) else f' t="inlineStr"><is><t>{v}</t></is></c>') for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")


def test_workbook_sqlite_and_ingestion(spark, tmp_path):
    workbook(tmp_path / "w.xlsx", [["id", " name "], [1, "x"], [2, "y"]])
    df = read_any(spark, str(tmp_path / "w.xlsx"))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string"} and df.count() == 2
    db = sqlite3.connect(tmp_path / "d.sqlite")
    db.execute("CREATE TABLE artist (ArtistId INTEGER, Name TEXT)")
    db.executemany("INSERT INTO artist VALUES (?, ?)", [(i, f"n{i}") for i in range(50)])
    db.execute("CREATE TABLE album (AlbumId INTEGER, Title TEXT, ArtistId INTEGER)")
    db.executemany("INSERT INTO album VALUES (?, ?, ?)", [(i, f"t{i}", i % 50) for i in range(200)])
    db.commit()
    s = Session(spark, str(tmp_path / "ws"))
    assert sorted(d.id for d in s.add_files(str(tmp_path / "d.sqlite"))) == ["album", "artist"]
    found = s.discover()
    assert [(r.left, r.right, r.kind) for r in found] == [("album", "artist", "LOOKUP")]
    merge = s.execute()
    assert merge.rows == 200 and merge.report["passed"] and s.unified().where("_match_artist").count() == 200
    assert "Start from album" in s.lineage_report() and s.route("album", "artist")
    back = Session.restore(spark, s.workspace.root) if s.save() else None
    assert sorted(back.datasets) == ["album", "artist"]
    s.decide_match("album.ArtistId", "artist.ArtistId", False)
    assert s.merges[-1].outdated and s.discover() == []
    assert s.undo() is merge and s.undo() is None
    with open(tmp_path / "q.csv", "w", newline="") as f:
        csv.writer(f).writerows([["a", "b"], ["x", "1"]])
    d = ingest(spark, Workspace(str(tmp_path / "v")), str(tmp_path / "q.csv"), existing={"q"})
    assert d.id == "q_2" and d.rows == 1 and len(d.sha256) == 64


def test_star_with_meaningless_names(spark):
    """References are found by values where keys are unguessable, and siblings are not linked."""
    rng = np.random.default_rng(4)
    def keys(n):
        return [uuid.UUID(int=int(rng.integers(1, 2**62))).hex for _ in range(n)]
    cust, prod, orders = keys(300), keys(100), keys(500)
    s = Session(spark)
    s.add_frame("cust", spark.createDataFrame([(k, ["a", "b", "c"][i % 3]) for i, k in enumerate(cust)], "key string, town string"))
    s.add_frame("prod", spark.createDataFrame([(k, float(i)) for i, k in enumerate(prod)], "key string, weight double"))
    s.add_frame("orders", spark.createDataFrame([(k, cust[i % 280], ["new", "done"][i % 2]) for i, k in enumerate(orders)], "key string, cref string, state string"))
    s.add_frame("items", spark.createDataFrame([(orders[i % 480], prod[i % 90], i % 3, 1.5 * i) for i in range(900)], "oref string, pref string, seq int, price double"))
    found = {(r.left, r.right) for r in s.discover() if r.kind == "LOOKUP"}
    assert found == {("orders", "cust"), ("items", "orders"), ("items", "prod")}


def test_key_types(spark):
    c = ColumnProfile("d", "x", "integer", 10, 10, 10)
    assert c.key == "d.x" and c.uniqueness == 1.0 and c.cardinality == "unique"


def test_session_on_a_cluster_without_root(spark, sf_dir):
    """Discovery and plans of tables need no folder for files; keeping files asks for one."""
    from types import SimpleNamespace

    from weft import queries

    remote = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"), read=spark.read)
    s = queries.session(remote, sf_dir, "region", "nation")
    assert [(r.left, r.right, r.kind, r.keys) for r in s.discover()] == [("nation", "region", "LOOKUP", [("n_regionkey", "r_regionkey")])]
    assert s.make_plan().root == "nation"
    with pytest.raises(ValueError, match="root folder"):
        s.save()


def test_planned_merge_on_a_cluster(spark, sf_dir):
    """The query runs on a master that is not local, and keeps every order."""
    from types import SimpleNamespace

    from weft import queries

    remote = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"), read=spark.read)
    out = queries.planned_merge(remote, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count() and out.where("_match_region").count() > 0
