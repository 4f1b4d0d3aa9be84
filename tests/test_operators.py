"""Operators on literals with known answers."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import fusion, resolution, uncertainty
from weft.operators.clustering import components, correlation_clusters, entity_table, greedy_contraction
from weft.operators.joins import ROW, as_of, first_by_key, key_groups, lookup, with_row_numbers
from weft.operators.resolution import FSModel, MatchField


def test_lookup_keeps_rows_and_order_of_duplicates(spark):
    p = spark.createDataFrame([(1, "A-1"), (2, "a2"), (3, None), (4, "zz")], "id int, k string")
    c = spark.createDataFrame([("001", "first", 5), ("1", "second", 2), ("2", "two", 3), (None, "none", 1)], f"key string, v string, {ROW} long")
    got = {r.id: (r.d_v, r._match_d, r._src_d_row) for r in lookup(p, c, "k", "key", "d", {"v": "d_v"}, "identifier").collect()}
    assert got == {1: ("second", True, 2), 2: ("two", True, 3), 3: (None, False, None), 4: (None, False, None)}
    assert first_by_key(c, F.col("key")).count() == 3


def test_row_numbers_are_dense(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    got = with_row_numbers(df, ["k"]).orderBy(ROW).collect()
    assert [r[ROW] for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)
    assert sorted(r[ROW] for r in with_row_numbers(df).collect()) == list(range(1000))


def test_as_of_takes_the_latest_fact(spark):
    p = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, t int, id int")
    f = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z")], "k string, t int, v string")
    assert {r.id: r.asof_v for r in as_of(p, f, "k", "t", "t", ["v"]).collect()} == {1: "y", 2: None, 3: None}


def test_key_groups_join_transitively(spark):
    r = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, None, None), (5, "b", "y")], "rid long, k1 string, k2 string")
    assert {x.rid: x.group_id for x in key_groups(r, ["k1", "k2"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    nodes = spark.createDataFrame([(i,) for i in range(400)], "node long")
    got = {r.node: r.label for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(400)}


def test_correlation_keeps_contradicting_records_apart(spark):
    pairs = [("a", "b", .97), ("b", "c", .96), ("a", "c", .001), ("d", "e", .99)]
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    frame = spark.createDataFrame(pairs, "a string, b string, p double")
    got = {r.node: r.cluster for r in correlation_clusters(nodes, frame).collect()}
    assert got["a"] != got["c"] and got["d"] == got["e"] and got["f"] == "f"
    split = spark.createDataFrame([("d", "e", False), ("a", "f", True)], "a string, b string, same boolean")
    got = {r.node: r.cluster for r in correlation_clusters(nodes, frame, labels=split).collect()}
    assert got["d"] != got["e"] and got["a"] == got["f"]
    with pytest.raises(ValueError):
        correlation_clusters(nodes, frame, default=0.1)
    ids = entity_table(spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "node string, cluster string"), frame).collect()
    assert {r.node: (r.entity_id, round(r.confidence, 2)) for r in ids} == {"a": ("E0000001", .97), "b": ("E0000001", .97), "c": ("E0000002", 1.0)}


def test_contraction_by_component_equals_the_whole():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(5, 14)
        w = {(i, j): rng.uniform(-3, 3) for i in range(n) for j in range(i + 1, n) if rng.random() < .3}
        whole = greedy_contraction(list(range(n)), w)
        groups = {}
        for k, v in whole.items():
            groups.setdefault(v, []).append(k)
        for g in groups.values():
            assert len(g) == 1 or any(w.get((a, b), 0) > 0 for a in g for b in g if a < b)


def test_levels_and_weights(spark):
    fields = [MatchField("name", "NAME"), MatchField("phone", "PHONE"), MatchField("born", "DATE"), MatchField("pay", "NUMERIC"), MatchField("mail", "EMAIL")]
    r = spark.createDataFrame([("1", "x", "Doe, Jane", "+91-98765-43210", "2020-01-01", "100", "a@b.c"), ("2", "y", "J. Doe", "9876543210", "2020-01-20", "100.05", "A@B.C"), ("3", "y", "Max Roe", None, "1990-05-05", "7", None)],
                              "rid string, dataset string, name string, phone string, born string, pay string, mail string")
    pairs = spark.createDataFrame([("1", "2"), ("1", "3")], "a string, b string")
    got = {x.b: x for x in resolution.compared(r, pairs, fields).collect()}
    assert [got["2"][f.name] for f in fields] == ["high", "exact", "medium", "high", "exact"]
    assert [got["3"][f.name] for f in fields] == ["different", "null", "different", "different", "null"]
    m, u = {"exact": .8, "high": .1, "medium": .05, "different": .05}, {"exact": .01, "high": .01, "medium": .08, "different": .9}
    model = FSModel(["name"], {"name": m}, {"name": u}, .01)
    lv = spark.createDataFrame([("1", "2", "exact"), ("1", "3", "null")], "a string, b string, name string")
    p = {x.b: x.p for x in resolution.scored(lv, model).collect()}
    assert abs(p["2"] - model.probability({"name": "exact"})) < 1e-12 and abs(p["3"] - .01) < 1e-9


def test_prior_over_all_pairs():
    model = FSModel(["f"], {"f": {"exact": .99, "high": .005, "medium": .003, "different": .002}}, {"f": {"exact": .0001, "high": .0001, "medium": .0001, "different": .9997}}, .01)
    patterns = [({"f": "exact"}, 420), ({"f": "different"}, 3000)]
    assert abs(resolution.prior_over_all_pairs(patterns, model, 200_000) - .002) < .0004


def test_calibration_and_one_to_one(spark):
    slope, intercept = resolution.calibrate([(w, 1.0 if w > 2 else 0.0, 5.0) for w in range(-10, 11)])
    assert slope > 0.5 and intercept < 0
    pairs = spark.createDataFrame([(1, 10, .9), (1, 11, .8), (2, 10, .85), (3, 12, .4)], "a long, b long, p double")
    assert {(r.a, r.b) for r in resolution.one_to_one(pairs).collect()} == {(1, 11), (2, 10)}


def generated_people(seed=11, n=150):
    rng = random.Random(seed)
    first = ["Anna", "Bela", "Carlos", "Dora", "Emil", "Farah", "Gina", "Hugo", "Ines", "Jonas", "Kavya", "Lars", "Mira", "Nora", "Omar"]
    last = ["Adams", "Bauer", "Castro", "Dutta", "Evans", "Fischer", "Ghosh", "Haddad", "Ivanov", "Jensen", "Khan", "Lopez", "Meyer", "Novak", "Okafor", "Patel", "Quinn", "Rossi"]
    rows = []
    for e in range(n):
        f, l, city = rng.choice(first), rng.choice(last), rng.choice(["Pune", "Delhi", "Mumbai", "Chennai"])
        mail, phone = f"{f}.{l}{e}@mail.org".lower(), f"98{rng.randrange(10**8):08d}"
        rows.append((f"a{e:05d}", "crm", f"{f} {l}", mail, phone, city, e))
        if rng.random() < .7:
            name = rng.choice([f"{l}, {f}", f"{f[0]}. {l}", f"{f} {l}"])
            rows.append((f"b{e:05d}", "erp", name, mail if rng.random() < .85 else None, "+91-" + phone if rng.random() < .85 else None, city, e))
    return rows


def test_resolution_finds_generated_entities(spark):
    rows = generated_people()
    r = spark.createDataFrame([x[:6] for x in rows], "rid string, dataset string, name string, email string, phone string, city string")
    fields = [MatchField("name", "NAME"), MatchField("email", "EMAIL"), MatchField("phone", "PHONE"), MatchField("city", "CITY", "geo")]
    got = resolution.resolve(r, fields)
    entity = {x.node: x.entity_id for x in got.entities.collect()}
    truth = {x[0]: x[6] for x in rows}
    assert len(entity) == len(rows)
    pairs = [(a, b) for a in truth for b in truth if a < b and a[0] != b[0]]
    tp = sum(truth[a] == truth[b] and entity[a] == entity[b] for a, b in pairs)
    precision = tp / max(1, sum(entity[a] == entity[b] for a, b in pairs))
    recall = tp / sum(truth[a] == truth[b] for a, b in pairs)
    assert precision >= .95 and recall >= .9 and got.statistics["reduction_ratio"] > .9


def test_strategies(spark):
    t = datetime.datetime
    c = spark.createDataFrame([("e", "city", "Mumbai", "mumbai", "crm", 1, t(2024, 1, 1), .5, 1), ("e", "city", "Pune", "pune", "mdm", 2, t(2025, 1, 1), .9, 0), ("e", "city", "Mumbai", "mumbai", "crm", 3, t(2023, 1, 1), .4, 1)],
                              "entity_id string, attribute string, value string, norm string, dataset string, row long, ts timestamp, confidence double, priority int")
    want = {"majority_vote": "Mumbai", "prefer_source": "Pune", "prefer_latest": "Pune", "prefer_non_null": "Pune", "highest_confidence": "Pune", "keep_all": '["Pune","Mumbai"]', "manual_review": None}
    for s, v in want.items():
        r = fusion.resolved_values(c, s).first()
        assert (r.resolved, r.conflict, r.n_values) == (v, True, 2), s
    assert fusion.resolved_values(c.where("norm = 'mumbai'"), "manual_review").first().resolved == "Mumbai"
    assert fusion.conflicts(c, "manual_review").first().status == "open"
    with pytest.raises(ValueError):
        fusion.resolved_values(c, "coin_toss")


def test_source_accuracy_ranks_sources(spark):
    rows = [(str(i), "x", f"v{i}" if s != "bad" or i % 10 == 0 else f"w{i}", s, i) for i in range(20) for s in ("good", "ok", "bad")]
    c = spark.createDataFrame([(e, a, v, v, s, r, None, None, 0) for e, a, v, s, r in rows], "entity_id string, attribute string, value string, norm string, dataset string, row long, ts timestamp, confidence double, priority int")
    acc = {r.dataset: r.accuracy for r in fusion.source_accuracy(c, 5).collect()}
    assert acc["good"] > .9 and acc["bad"] < .2


def test_history_of_a_value(spark):
    def day(n):
        return datetime.datetime(2024, 1, n)
    v = spark.createDataFrame([("e", "city", "Pune", "pune", day(1), 1, "a"), ("e", "city", "pune", "pune", day(5), 1, "b"), ("e", "city", "Bangalore", "bangalore", day(9), 1, "a"), ("e", "city", "Delhi", "delhi", None, 1, "a"),
                               ("f", "city", "Pune", "pune", day(3), 2, "a"), ("f", "city", "Mumbai", "mumbai", day(3), 0, "b")], "entity_id string, attribute string, value string, norm string, ts timestamp_ntz, priority int, dataset string")
    h = fusion.history(v)
    got = {(r.entity_id, r.value): r for r in h.collect()}
    assert (got["e", "Pune"].valid_from, got["e", "Pune"].valid_to, got["e", "Pune"].support) == (day(1), day(9), 2)
    assert got["e", "Bangalore"].current and got["e", "Bangalore"].valid_to is None and got["e", "Delhi"].valid_from is None
    assert ("f", "Mumbai") in got and ("f", "Pune") not in got
    assert fusion.history_violations(h).count() == 0
    assert [r.value for r in fusion.history_at(h, F.lit("2024-01-07").cast("timestamp_ntz"), "e").collect()] == ["Pune"]
    assert fusion.as_known_at([(1, h), (5, h.where("false"))], 3).count() == h.count()
    bad = h.where("entity_id = 'e' AND value = 'Pune'").withColumn("valid_to", F.lit("2023-01-01").cast("timestamp_ntz"))
    assert fusion.history_violations(bad).count() == 1


def test_uncertainty(spark):
    u = spark.createDataFrame([("a", 10.0, 1.0, True), ("a", 20.0, .5, True), ("b", 1.0, .9, False), ("b", 2.0, .25, True)], "g string, x double, _match_probability double, m boolean").withColumn("_relationship_confidence", F.lit(1.0))
    s = {r.g: r for r in uncertainty.aggregate_with_uncertainty(u, "sum", "x", "g", scenarios={"m": "m"}).collect()}
    assert (s["a"].point, s["a"].expected, s["a"].sd, s["a"].certain_only, s["a"].if_m_wrong, s["b"].if_m_wrong) == (30, 20, 10, 10, 0, 1)
    c = {r.g: r for r in uncertainty.aggregate_with_uncertainty(u, "count", group_by="g").collect()}
    assert c["b"].point == 2 and abs(c["b"].expected - 1.15) < 1e-12
    a = {r.g: r for r in uncertainty.aggregate_with_uncertainty(u, "avg", "x", "g").collect()}
    assert a["a"].point == 15 and abs(a["a"].expected - 20 / 1.5) < 1e-12 and a["a"].low is None


def test_graph_queries_take_whole_tables(spark, sf_dir):
    from weft import queries
    from weft.operators.clustering import _logit, correlation_clusters, greedy_contraction

    read = lambda t, *cols: [tuple(r) for r in queries.table(spark, sf_dir, t).select(*cols).collect()]
    customers, orders = [f"c{k}" for k, in read("customer", "c_custkey")], read("orders", "o_orderkey", "o_custkey")
    parent = {n: n for n in customers + [f"o{k}" for k, _ in orders] + [f"s{k}" for k, in read("supplier", "s_suppkey")]}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for x, y in [(f"o{k}", f"c{c}") for k, c in orders] + [(f"o{k}", f"s{s}") for k, s in read("lineitem", "l_orderkey", "l_suppkey")]:
        x, y = sorted((root(x), root(y)))
        parent[y] = x
    got = {r.node: r.label for r in queries.connected_components_whole(spark, sf_dir).collect()}
    assert got == {n: root(n) for n in parent}
    p = queries.table(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey) AS a", "concat('o', o_orderkey) AS b", "(o_orderkey % 100) / 100.0D AS p")
    nodes = p.selectExpr("explode(array(a, b)) AS node").distinct()
    clusters = {r.node: r.cluster for r in correlation_clusters(nodes, p, 0.9).collect()}
    links = {(f"c{c}", f"o{k}"): max(-12.0, _logit(k % 100 / 100)) - _logit(0.9) for k, c in orders}
    assert clusters == greedy_contraction(sorted({n for ab in links for n in ab}), links)


def test_oversized_blocks_keep_all_pairs(spark):
    from weft.operators import resolution
    from weft.operators.resolution import MatchField

    rows = [(f"r{i:04d}", "ab"[i % 2], f"Name{i}", "5551234567" if i < 2100 else f"777{i:07d}") for i in range(2110)]
    records = spark.createDataFrame(rows, "rid string, dataset string, name string, phone string")
    fields = [MatchField("name", "NAME"), MatchField("phone", "PHONE", "digits")]
    assert resolution.candidates(records, fields, schemes=("standard",)).count() == 1050 * 1050
    few = records.where("rid < 'r0040'")
    whole = {(x[0], y[0]) for x in rows[:40] for y in rows[:40] if x[0] < y[0] and x[1] != y[1]}
    blocks = resolution.all_blocks(few, fields, schemes=("standard",))
    for size in (3, 39, 40):
        pairs = resolution.candidates(few, fields, max_block=size, schemes=("standard",), blocks=blocks)
        assert sorted(tuple(r) for r in pairs.collect()) == sorted(whole)
        found = resolution.blocking_statistics(few, pairs, blocks=blocks, max_block=size).first()
        assert (found.oversized_blocks, found.oversized_records) == ((1, 40) if size < 40 else (0, 0))


def test_pairs_leave_once_without_a_shuffle(spark):
    """Records that share several blocks, of three datasets, in whole and dealt blocks: each admissible pair once, none shuffled."""
    rows = [(f"r{i:03d}", "abc"[i % 3], f"{k}{i % m}") for i in range(90) for k, m in (("p", 2), ("q", 5), ("r", 7))] + [("r000", "a", None)]
    blocks = spark.createDataFrame(rows, "rid string, dataset string, block string")
    at = {}
    for rid, dataset, block in rows:
        at.setdefault(rid, (dataset, set()))[1].add(block)
    for dedupe in ((), ("b",)):
        want = {(x, y) for x in at for y in at if x < y and (at[x][0] != at[y][0] or at[x][0] in dedupe) and (at[x][1] & at[y][1]) - {None}}
        for size in (4, 2000):
            pairs = resolution._pairs(blocks, dedupe, size)
            got = [tuple(r) for r in pairs.collect()]
            assert len(got) == len(set(got)) and set(got) == want
            plan = pairs._jdf.queryExecution().sparkPlan().toString()
            assert "Aggregate" not in plan[:plan.index("Join")]


def test_large_component_contracts_in_time():
    """A complete two-sided component of 1372 nodes and 110,596 links: seconds, not one pass over all links a merge."""
    import time

    from weft.operators.clustering import greedy_contraction

    weights = {(a, b): 3.2 for a in range(1286) for b in range(1286, 1372)}
    began = time.process_time()
    got = greedy_contraction(list(range(1372)), weights)
    assert time.process_time() - began < 30 and len(set(got.values())) == 599


def test_resolve_makes_pairs_anew(spark, monkeypatch):
    """Candidates are counted in full, and only pairs that link or may be looked at are written."""
    rows = [(f"{d}{i:03d}", d, f"a{'bcdefghkmnprstw'[i % 15] * 4}{'aeiou'[i % 5]} baker", f"u{i}@x.org" if i % 4 else None, f"555{i % 30:07d}") for i in range(120) for d in ("c", "s")]
    records = spark.createDataFrame(rows, "rid string, dataset string, name string, email string, phone string")
    fields = [MatchField("name", "NAME"), MatchField("email", "EMAIL"), MatchField("phone", "PHONE")]
    written = []
    keep = resolution.stored
    monkeypatch.setattr(resolution, "stored", lambda df: written.append(keep(df)) or written[-1])
    got = resolution.resolve(records, fields, refine_block=1000)
    n = resolution.candidates(records, fields, refine_block=1000).count()
    assert got.statistics["candidate_pairs"] == n >= 120 * 120
    assert max(df.count() for df in written if "a" in df.columns) < n // 4


def test_profiles_of_large_columns_hold_no_column_in_one_task(spark):
    """Narrowed percentiles and hash-cut sketches are those of one aggregate over all values, on odd numbers too."""
    from pyspark.sql import functions as F

    from weft.operators import profile

    df = spark.range(5000).select(F.col("id").alias("key"), F.when(F.col("id") % 7 > 0, F.pow(F.lit(1.3), F.col("id") % 900 - 450)).alias("wide"), (F.col("id") % 3 - 1).cast("double").alias("few"),
                                  F.when(F.col("id") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(float("nan"))).alias("zero"), F.when(F.col("id") == 9, F.lit(float("inf"))).otherwise(F.col("id") / 3).alias("endless"),
                                  F.concat(F.when(F.col("id") % 2 == 0, "A").otherwise("a"), (F.col("id") / 40).cast("int").cast("string")).alias("case"))
    counts = profile.stored(profile.cell_counts(df))
    old = profile.unpivoted(df).groupBy("column", "text").agg(F.first("number").alias("number"), F.count("*").alias("count"))
    assert not counts.exceptAll(old).count() and not old.exceptAll(counts).count()
    one, narrowed = ({r["column"]: r.asDict() for r in profile.statistics_of(counts, most).collect()} for most in (10**9, 2))
    assert one.keys() == narrowed.keys() and len(one) == 6
    for c in one:
        assert repr(one[c]["quantiles"]) == repr(narrowed[c]["quantiles"]), c
    ranges = {r["column"]: (r["lo"], r["hi"], r["n"]) for r in counts.where("`column` in ('key', 'wide')").groupBy("column").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.sum(F.when(F.col("number").isNotNull(), F.col("count"))).alias("n")).collect()}
    assert profile.narrowed_percentiles(counts, ranges) == {"key": one["key"]["quantiles"]}  # the other is left to the aggregate
    assert profile.narrowed_percentiles(counts, ranges, rounds=60) == {c: one[c]["quantiles"] for c in ranges}
    cut, whole = (sorted(map(tuple, profile.bottom_k(df, k=20, hash_of=h, counts=counts).collect())) for h in (profile.sketch_hash, lambda c: F.xxhash64(c)))
    assert cut == whole and {c: sum(x[0] == c for x in cut) for c in ("key", "few", "case")} == {"key": 20, "few": 3, "case": 20}


def test_duplicate_rows_are_grouped_only_without_a_key(spark, monkeypatch):
    from weft.operators import profile

    keyed = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id long, x double")
    repeated = spark.createDataFrame([(1, 0.5), (1, 0.5), (None, 0.5)], "id long, x double")
    assert (profile.profile(repeated, "r").rows, profile.profile(repeated, "r").duplicates) == (3, 1)
    monkeypatch.setattr(profile, "duplicate_rows", None)
    assert (profile.profile(keyed, "k").rows, profile.profile(keyed, "k").duplicates) == (2, 0)


def test_contraction_by_classes_merges_as_between_nodes():
    import numpy as np

    from weft.operators.clustering import _contracted_by_class, contracted_classes

    for seed in range(150):
        r = random.Random(seed)
        n, k = r.randint(4, 40), r.randint(1, 5)
        _, cls = np.unique([r.randrange(k) for _ in range(n)], return_inverse=True)
        k = int(cls.max()) + 1
        between = {(a, b): r.choice([-3, -1, .3, .7, 1.5, 2, 5]) for a in range(k) for b in range(a, k) if r.random() < .6}
        own = {tuple(sorted(r.sample(range(n), 2))): r.choice([-4, -1, .3, 2, 5, 5.1, 1e6]) for _ in range(r.randint(0, n))}
        ends = lambda d: [*np.array(list(d), dtype=np.int64).reshape(-1, 2).T, np.array(list(d.values()), dtype=float)]
        marked = np.isin(np.arange(n), [x for ab in own for x in ab])
        one_by_one = contracted_classes(cls, *ends(between), *ends(own))
        assert (one_by_one == _contracted_by_class(cls, k, *ends(between), *ends(own), marked, -0.4)).all(), seed


def test_resolve_meets_classes_instead_of_records(spark, monkeypatch):
    """Records that nothing tells apart meet as one; pairs, counts, clusters and confidences are those of all records."""
    from weft.operators import clustering

    rows = [(f"{d}{i:03d}", d, f"a{'bcd'[i % 3] * 4} baker" if i != 7 else None, (f"u{i}@x.org" if i % 9 else "all@x.org") if i % 4 else None, f"555{i % 6:07d}", float(i % 2)) for d, m in (("c", 90), ("s", 60)) for i in range(m)]
    records = spark.createDataFrame(rows, "rid string, dataset string, name string, email string, phone string, amount double")
    fields = [MatchField("name", "NAME"), MatchField("email", "EMAIL"), MatchField("phone", "PHONE"), MatchField("amount", "NUMERIC")]
    labels = spark.createDataFrame([("c006", "s006", False), ("s012", "c000", True), ("c001", "c002", False)], "a string, b string, same boolean")
    leveled, names = resolution._leveled, [f.name for f in fields]
    for dedupe, told in (((), None), (("c",), labels)):
        made = []
        with monkeypatch.context() as m:
            m.setattr(resolution, "_leveled", lambda *a: made.append(leveled(*a)) or made[-1])
            got = resolution.resolve(records, fields, dedupe, labels=told, refine_block=1000)
        pairs = resolution.candidates(records, fields, dedupe, refine_block=1000)
        pairs = pairs if told is None else pairs.unionByName(told.selectExpr("least(a, b) AS a", "greatest(a, b) AS b")).distinct()
        whole = resolution.with_labels(resolution.scored(resolution.compared(records, pairs, fields), got.model), told)
        rated = {(r.a, r.b): r.p for r in whole.collect()}
        assert got.statistics["candidate_pairs"] == len(rated) and max(df.count() for df in made) < len(rated) / 4
        kept = {(r.a, r.b): r.p for r in got.pairs.collect()}
        assert got.pairs.count() == len(kept) and kept == pytest.approx({ab: p for ab, p in rated.items() if p >= 0.1})
        clusters = clustering.correlation_clusters(records.selectExpr("rid AS node"), whole.select("a", "b", "p"), 0.5, labels=told)
        want = {r.node: (r.cluster, r.entity_id, round(r.confidence, 9)) for r in clustering.entity_table(clusters, whole.select("a", "b", "p")).collect()}
        assert {r.node: (r.cluster, r.entity_id, round(r.confidence, 9)) for r in got.entities.collect()} == want
        assert len({c for c, _, _ in want.values()}) < 140
