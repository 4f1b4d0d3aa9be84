"""Named operations, requests in plain words, files read whole, calibration and sibling support."""

import json

import pytest

from weft.operators import resolution
from weft.operators.resolution import MatchField
from weft.plans import tools
from weft.plans.matching import flood
from weft.plans.session import Session
from weft.sources import csv as wcsv
from weft.sources.readers import extract_records, fetch_pages, longest_records, listed_as_text, flattened, records_frame


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    s = Session(spark, str(tmp_path_factory.mktemp("tools")))
    s.add_frame("client_list", spark.createDataFrame([(f"C{i:05x}q{i * 7919 % 97}", ["Pune", "Delhi", "Turin"][i % 3]) for i in range(120)], "client_code string, city string"))
    s.add_frame("sales", spark.createDataFrame([(i, f"C{i % 100:05x}q{i % 100 * 7919 % 97}", float(i % 50)) for i in range(400)], "sale_no long, client_code string, amount double"))
    return s


def test_requests_in_plain_words(session):
    read = lambda x: tools.read(session, x)
    assert read("Merge everything, only above 80% and prefer the latest values") == [("set_preferences", {"confidence_threshold": 80.0, "conflict_strategy": "prefer_latest"}), ("execute_merge", {})]
    assert read("Why are sales and client_list linked?") == [("explain_relationship", {"left": "sales", "right": "client_list"})]
    assert read("explain sales.client_code and client_list.client_code") == [("explain_match", {"left": "sales.client_code", "right": "client_list.client_code"})]
    assert read("how is sales connected to client list") == [("find_integration_route", {"source": "sales", "target": "client_list"})]
    assert read("don't merge uncertain records") == [("set_preferences", {"merge_uncertain": False})]
    assert read("use client_code as the primary key and show me the plan") == [("set_preferences", {"primary_key": "client_code"}), ("generate_merge_plan", {})]
    assert read("show me some rows of sales") == [("inspect_dataset", {"dataset": "sales", "limit": 10})]
    assert read("average amount by city") == [("aggregate_with_uncertainty", {"measure": "amount", "group_by": "city"})]
    assert read("undo that") == [("undo_merge", {})] and read("any conflicts in city?") == [("show_conflicts", {"attribute": "city"})]
    assert read("duplicates in sales") == [("find_entity_matches", {"left": "sales"})] and read("hm") == [("list_datasets", {})]
    for words, name in (("lineage report", "lineage_report"), ("where does amount come from", "show_provenance"), ("what share of rows matched", "match_statistics"), ("data quality", "quality_report"),
                        ("draw the graph", "build_graph"), ("which columns correspond", "show_mappings"), ("profile sales", "profile_dataset"), ("find relationships", "find_candidate_relationships"),
                        ("compare sales with client_list", "compare_schemas"), ("export it", "export_dataset"), ("which datasets are loaded", "list_datasets")):
        assert read(words)[-1][0] == name, words


def test_arguments_are_checked(session):
    call = lambda *x: tools.call(session, *x)
    assert "there is no" in call("drop_tables")["error"] and "needs dataset" in call("inspect_dataset")["error"]
    assert "no dataset" in call("inspect_dataset", {"dataset": "x"})["error"] and "takes no" in call("list_datasets", {"x": 1})["error"]
    assert "one of" in call("set_preferences", {"mode": "wild"})["error"] and "type integer" in call("inspect_dataset", {"dataset": "sales", "limit": "3"})["error"]
    assert call("quality_report")["error"] == "there is no merge yet" and not call("undo_merge")["ok"]
    assert len(call("inspect_dataset", {"dataset": "SALES", "limit": 100_000})["result"]) == 100
    assert all(t.schema["parameters"]["additionalProperties"] is False and set(t.required) <= set(t.properties) for t in tools.TOOLS.values()) and len(tools.TOOLS) == 28


def test_a_session_driven_by_requests(session):
    merged = tools.answer(session, "Merge everything in strict mode? No: balanced")
    assert merged[-1]["ok"] and merged[-1]["result"]["rows"] == 400 and merged[-1]["result"]["passed"]
    rows = tools.call(session, "aggregate_with_uncertainty", {"measure": "amount"})["result"]
    assert rows[0]["point"] == sum(i % 50 for i in range(400))
    joins = tools.call(session, "match_statistics")["result"]["joins"]
    assert joins and joins[0]["matched"] == 400
    assert tools.call(session, "show_conflicts")["result"] == [] and any(f.endswith("unified_dataset.parquet") for f in tools.call(session, "export_dataset")["result"])
    assert [r["dataset"] for r in tools.call(session, "show_provenance", {"column": "amount"})["result"]] == ["sales"]
    assert session.column_route("sales.amount", "client_list.city")[0].startswith("sales.amount -> sales.client_code -> client_list.client_code -> client_list.city")
    assert tools.call(session, "undo_merge")["ok"] and session.merges == [] and len(session.archive) == 1


def test_headers_go_by_place_and_the_whole_file_decides(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("a,b\n1,x\na,b\n2,y,z\n" + "3,w\n" * 20_000 + "4,p,q\n")
    df = wcsv.read_csv(spark, str(path))
    rows = [tuple(r) for r in df.where("b NOT IN ('w')").collect()]
    assert df.count() == 20_004 and ("a", "b") in rows and ("2", "y,z") in rows and ("4", "p,q") in rows
    late = tmp_path / "q.csv"
    late.write_text("a,b\n" + "1,x\n" * 30_000 + '2,"two\nlines"\n')
    df = wcsv.read_csv(spark, str(late))
    assert df.count() == 30_001 and df.where("a = 2").first()["b"] == "two\nlines"


def test_json_is_alike_at_every_size(spark, tmp_path):
    docs = [{"meta": {"n": 2}, "data": {"rows": [{"id": 1, "tags": ["x"], "at": {"city": "P"}}, {"id": 2, "tags": [], "at": {"city": None}}]}, "few": [{"z": 1}]}, [{"id": 1}, {"id": 2}], {"id": 5, "at": {"c": 1}}]
    for i, doc in enumerate(docs):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(doc))
        small = records_frame(spark, extract_records(doc))
        large = listed_as_text(flattened(longest_records(spark.read.option("multiLine", True).json(str(path)))))
        told = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
        assert told(small) == told(large)
    with pytest.raises(ValueError):
        fetch_pages("http://h/x", page_size=1, max_pages=3, get=lambda u: b'[{"i": 1}]')


def test_labels_calibrate_and_rare_terms_weigh_more(spark):
    rows = [(f"a{i}", "x", f"n{i}", "common" if i < 50 else f"rare{i}") for i in range(60)] + [(f"b{i}", "y", f"n{i}", "common" if i < 50 else f"rare{i}") for i in range(60)]
    records = spark.createDataFrame(rows, "rid string, dataset string, email string, town string")
    fields = [MatchField("email", "EMAIL"), MatchField("town", "CATEGORY")]
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(60)], "a string, b string")
    model = resolution.FSModel(["email", "town"], {f: {"exact": .9, "high": .04, "medium": .03, "different": .03} for f in ("email", "town")}, {f: {"exact": .1, "high": .1, "medium": .1, "different": .7} for f in ("email", "town")}, .5)
    scored = resolution.scored(resolution.compared(records, pairs, fields), model)
    got = {r.a: r.weight for r in resolution.term_adjusted(scored, records, fields[1:], model).collect()}
    assert got["a55"] > got["a5"] and abs((got["a55"] - got["a5"]) - 5.643856) < 1e-3  # log2 of 100 / 120 over 2 / 120
    slope, intercept = resolution.calibrate([(4.0, 1.0, 100.0), (-4.0, 0.0, 100.0), (4.0, 0.0, 300.0)])
    assert 1 / (1 + 2 ** -(slope * 4 + intercept)) < 0.6


def test_a_pair_does_not_support_itself(spark):
    owner = {f"{d}.{c}": d for d in "ab" for c in "wxyz"}
    others = flood({("a.x", "b.x"): .7} | {(f"a.{c}", f"b.{c}"): .9 for c in "wyz"}, owner)
    itself = flood({("a.x", "b.x"): .7} | {(f"a.{c}", "b.x"): .7 for c in "wyz"}, owner)
    assert others[("a.x", "b.x")] > .7 >= itself[("a.x", "b.x")]


def test_a_retrained_matcher_scores_what_is_discovered(spark, session):
    from weft.plans.matching import isotonic_line, pair_features

    line = isotonic_line([(.1, 0, 1), (.2, 1, 1), (.3, 0, 1), (.9, 1, 1)])
    assert [line(x) for x in (.1, .25, .9)] == [0.0, .5, 1.0] and line(.05) == 0.0
    session._fresh()
    assert all(len(pair_features(m)) == 20 for m in session.matches)
    for m in session.matches[:4]:
        session.decide_match(*m.pair, m.left.split(".")[1] == m.right.split(".")[1])
    scorer = session.retrain_matcher()
    if scorer is not None:
        assert all(0 <= scorer(m) <= 1 for m in session.matches) and session.stale
    session.scorer = None

    class Plain:
        def __init__(self, documents):
            self.documents = documents

        def cosine(self, a, b):
            return float(self.documents[a] == self.documents[b])
    assert session.discover(encoder=Plain) and "sales.client_code" in {x for x, _ in session.graph_view()["references"]}


def test_proposals_are_asked_for_once(spark, tmp_path):
    asked = []
    def propose(sides):
        asked.append(sides)
        return {"ca": "california", "ny": "new york", "tx": "texas"}
    s = Session(spark, str(tmp_path / "ws"), proposer=propose)
    states = ["CA", "NY", "TX"]
    s.add_frame("shops", spark.createDataFrame([(i, states[i % 3]) for i in range(30)], "shop_id long, state string"))
    s.add_frame("taxes", spark.createDataFrame([(["California", "New York", "Texas"][i % 3], float(i)) for i in range(12)], "state_name string, rate double"))
    s.discover()
    n = len(asked)
    s.stale = True
    s.discover()
    assert n >= 1 and len(asked) == n and len(s.crosswalks) == 1
