"""The eleven queries on small tables, each against a brute-force version or SQL."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("weft.llm")
from weft.llm import bagminhash, exact_dedup, mih_ann, mixing, packing, pii, queries  # noqa: E402


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def same(a: pd.DataFrame, b: pd.DataFrame):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir, queries.ORACLE_SQL[name]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_similarity(a, b):
    def bag(t):
        w = words(t)
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute_classes(rows):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (d, t) in enumerate(rows):
        for e, u in rows[i + 1:]:
            if words(t) and words(u) and min(len(words(t)), len(words(u))) >= 0.7 * max(len(words(t)), len(words(u))) and brute_similarity(t, u) >= 0.8:
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in parent}


def test_near_duplicates_against_all_pairs(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in queries.op3_near_duplicates(spark, sf_dir).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_chain_and_edges(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-6] + ["x"] * 6)), (3, " ".join(["y"] * 6 + base[6:])), (4, " ".join(base)),
            (5, None), (6, ""), (7, " \n"), (8, "one two"), (9, "one two"), (10, "other words only"), (11, "a " * 5000), (12, "a " * 5100), (13, "a " * 3000),
            (None, "lost")]
    docs = frame(spark, [(a, b, 1, "k") for a, b in rows], "doc_id long, text string, rep int, node string")
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()}
    want = brute_classes([r for r in rows if r[0] is not None])
    assert got == want | {None: None}
    assert got[12] == 11 and got[13] == 13 and got[9] == 8
    assert bagminhash.near_duplicates(docs.where("false")).count() == 0
    assert sorted(r.doc_id for r in bagminhash.keep_one_of_each(docs).collect() if r.doc_id) == [1, 5, 6, 7, 8, 10, 11, 13]


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(7, a), (7, b), (9, a), (3, b), (3, b), (5, c), (5, c), (5, c + " end"), (None, c), (None, "alone in the world"), (None, "alone in the world")]
    docs = frame(spark, rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in bagminhash.near_duplicates(docs).collect())
    assert got == sorted([(7, 7, 2), (7, 3, 3), (9, 7, 2), (3, 3, 3), (3, 3, 3), (5, 5, 4), (5, 5, 4), (5, 5, 4), (0, 5, 4), (0, 0, 2), (0, 0, 2)])
    kept = sorted((r.doc_id or 0, r.text) for r in bagminhash.keep_one_of_each(docs.withColumn("n", F.lit(1))).collect())
    assert [(i, t) for i, t in kept if i != 5] == sorted([(7, a), (3, b), (0, "alone in the world")]) and [i for i, _ in kept].count(5) == 1
    firsts = sorted((r.doc_id or 0, r.text) for r in exact_dedup.keep_first_copies(docs).collect())
    assert firsts == sorted([(7, a), (3, b), (5, c), (5, c + " end"), (0, "alone in the world")])


def test_a_large_group_of_near_copies_against_all_pairs(spark, monkeypatch):
    """Texts at all distances from one another, in blocks so small that a bucket takes many."""
    monkeypatch.setattr(bagminhash, "BLOCK_TEXTS", 8)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(160):
        t = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 9)):
            t[k] = f"x{rng.integers(3) if d % 2 else d}"
        rows.append((d, " ".join(t)))
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame(spark, rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert 1 < len(set(want.values())) < 100 and got == want


def test_blocks_and_pieces_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(str(x) for x in rng.integers(0, 9, n)) for n in (0, 3, 700, 40)] + ["z" * 300 + " b  c", " lead", "é" * 90]
    raw = [t.encode() for t in texts]
    joined, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    whole, starts = bagminhash.shingles(joined, offsets)
    text, element, weight = bagminhash.multisets(whole, starts)
    sig = bagminhash.signatures(text, element, weight, len(texts), 40)
    assert (sig == bagminhash.signatures(text, element, weight, len(texts), 40, block=13)).all()
    monkeypatch.setattr(bagminhash, "PIECE", 64)
    again, begins = bagminhash.shingles(joined, offsets)
    assert (again == whole).all() and (begins == starts).all()
    assert [int(n) for n in np.diff(starts)] == [max(1, len(t.split()) - 4) if t.split() else 0 for t in texts]


def test_block_similarities_and_joining_links():
    rng = np.random.default_rng(7)
    bags = [np.unique(rng.integers(0, 40, rng.integers(1, 30))) for _ in range(12)]
    got = bagminhash.similarities(bags, columns=7)
    for i, x in enumerate(bags):
        for j, y in enumerate(bags):
            assert abs(got[i, j] - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 1e-9
    similar = np.zeros((6, 6), bool)
    similar[0, 1] = similar[1, 0] = similar[1, 5] = similar[5, 1] = similar[3, 4] = similar[4, 3] = True
    a, b = bagminhash.joining_links(similar, np.array([10, 20, 30, 40, 40, 50]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(20, 10), (50, 10)]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(40):
        e, w = rng.integers(1, 2**62, 300).astype(np.uint64), rng.integers(1, 9, 300)
        v = np.maximum(w + rng.integers(-3, 4, 300), 0)
        k = v > 0
        text = np.concatenate([np.zeros(300, int), np.ones(int(k.sum()), int)])
        s = bagminhash.signatures(text, np.concatenate([e, e[k]]), np.concatenate([w, v[k]]), 2, 100)
        gaps.append((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert abs(np.mean(gaps)) < 0.025


def test_packing_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "it's  \n\n  we'll 'tis ''s don't <|endoftext|>"), (10**6 + 3, "\t x 　y  12½ ñ"), (10**6 + 4, "ab " * 9000)]
    docs = frame(spark, rows, "doc_id long, text string")
    got = packing.pack(docs, queries.tokenizer_path()).toPandas()
    by_doc = dict(list(got.groupby("doc_id")))
    assert len(by_doc) == len(rows)
    for d, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for p in by_doc[d].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    total = 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"].to_numpy() == np.concatenate([[0], s["length"].cumsum()[:-1]])).all() and s["length"].sum() <= 2048
        total += 2048
    assert got["length"].sum() / total > 0.95
    assert packing.pack(docs.where("false"), queries.tokenizer_path()).count() == 0
    twice = packing.pack(docs.limit(3).unionByName(docs.limit(3)), queries.tokenizer_path()).toPandas()
    assert twice.groupby("sequence_id")["length"].sum().max() <= 2048 and (twice.groupby(["doc_id", "start"]).size() == 2).all()


def test_cutting_plan_is_exact_and_near_the_bound():
    rng = np.random.default_rng(3)
    demand = np.zeros(129, np.int64)
    np.add.at(demand, rng.integers(1, 128, 5000), 1)
    plan = packing.cutting_plan(demand, 128)
    assert (sum(p * n for p, n in zip(plan.patterns, plan.times)) == demand).all()
    assert all((p * np.arange(129)).sum() <= 128 for p in plan.patterns)
    assert plan.sequences <= (demand * np.arange(129)).sum() / 128 * 1.02 + 2


def test_neighbours_recall_and_order(spark, sf_dir):
    got = queries.op2_nearest_neighbours(spark, sf_dir).toPandas()
    t = queries.table(spark, sf_dir, "embeddings").toPandas()
    x, ids = np.array(t["embedding"].to_list(), dtype=np.float64), t["vec_id"].to_numpy()
    hits = asked = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21))
        assert (np.diff(mine["score"]) <= 1e-12).all()
        hits += len(set(mine["vec_id"]) & set(ids[order]))
        asked += 20
    assert hits / asked >= 0.9


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]),
            (8, [None, 1.0]), (9, [float("inf"), 1.0]), (40, [0.6, 0.8]), (None, [1.0, 1.0]), (10, [1.0, 0.0, 0.0]), (3, [1.0, 0.0])]
    v = frame(spark, [(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, ids string")
    got = mih_ann.nearest(v, v.where("vec_id % 20 = 0"), k=3).toPandas().sort_values(["query_id", "rank"])
    assert list(got[got.query_id == 0]["vec_id"]) == [3, 20, 40]
    assert list(got[got.query_id == 20]["vec_id"]) == [0, 3, 40]
    assert list(got[got.query_id == 40]["vec_id"]) == [4, 0, 3]
    assert mih_ann.nearest(v.where("false"), v.where("false")).count() == 0
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.8]), (20, [1.0, 0.0, 0.0]), (3, [0.5, 0.0, 0.0]), (2, [0.4, 0.4])]
    v = frame(spark, rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in mih_ann.nearest(v, v.where("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.9), (0, 2, 2, 0.8), (20, 1, 3, 0.5)]


def test_neighbours_recall_at_a_larger_size(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op2_nearest_neighbours(spark, sf_dir).toPandas().groupby("query_id")["vec_id"].apply(set)
    t = queries.table(spark, sf_dir, "embeddings").toPandas()
    x, ids = np.array(t["embedding"].to_list(), dtype=np.float64), t["vec_id"].to_numpy()
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        recall.append(len(got[ids[q]] & set(ids[[i for i in np.lexsort((ids, -s))[:21] if i != q][:20]])) / 20)
    assert np.mean(recall) >= 0.9


def test_multi_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 3000).astype(np.uint64)
    codes[:500] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    index = mih_ann.MultiIndex(codes)
    for r in (0, 3, 9, 20, 27):
        assert (index.within(codes[0], r) == np.flatnonzero(np.bitwise_count(codes ^ codes[0]) <= r)).all()


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = ["a@b.co", "x a@b.com_y@z.org!é a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "+1 (389) 555-5010 +12 +123456789012345678", "4111 1111 1111 1111 4111-1111-1111-1112",
        "ñé 4111111111111111é 70.123.182.155", "@@a@b..c a.@-.-", "1 " * 20000, "7" * 50000, "a" * 100000 + "@b.c", "+1" + " " * 50000, None, "", "a@b.c" * 50,
        "call me at (212) 555-0188 today", "phone: 212-555-0188 or write jane (at) example (dot) com", "serial 212-555-0188-9",
        "server 192[.]168[.]1[.]20 and host 2001:0db8:0000:0000:0000:ff00:0042:8329", "card 4111.1111.1111.1111 and visa 4111/1111/1111/1112", "version 212.555.0188 of it", "a@b.co " * 3000]


def test_personal_data_against_plain_patterns(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()] + [(10**6 + i, t) for i, t in enumerate(HARD)]
    docs = frame(spark, [(a, b, 0) for a, b in rows], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for d, t in rows:
        want = plain_spans(t)
        assert got[d].base_spans == ",".join(want), d
        assert [got[d]["n_" + k] for k in PLAIN] == [sum(w.startswith(k) for w in want) for k in PLAIN]
        assert set(want) <= set(got[d].spans.split(",")) | {""}
    assert got[10**6 + 15].n_added == 2 and got[10**6 + 14].n_added == 1 and got[10**6 + 16].n_added == 0
    assert got[10**6 + 17].n_added == 2 and got[10**6 + 18].n_added >= 1 and "card:5:24" in got[10**6 + 18].spans and got[10**6 + 19].n_added == 0
    assert got[10**6 + 20].n_email == 3000
    assert pii.personal_data(docs.where("false")).count() == 0


def test_span_classifier_against_brute_force(spark):
    """Votes and scores recomputed in Python from the same weights decide as the columns do."""
    def bit(pattern, t):
        return int(re.search(pattern.replace("(?i:2", "(?:2"), t) is not None)
    texts = ["call 212-555-0188 now", "it is 212 555 0188", "order 912-555-0188", "ring (212) 555-0188", "x 0049 30 1234567", "tel 0049 30 1234567", "sku 212-555-0188 and 312-555-0199"] * 5
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    wide = [[(m.start(), m.end(), m.group()) for m in re.finditer(pii.WIDE["phone"], t)] for t in texts]
    cells = Counter()
    def feats(t, spans, i):
        s, e, m = spans[i]
        before = t[spans[i - 1][1] if i else 0:s][-32:]
        return (bit(pii.FORM["phone"], m), bit(pii.GAZETTEER["phone"], m), bit(pii.CONTEXT["phone"], before), bit(pii.AGAINST, before), min(len(m), 40) // 4 / 10)
    for t, spans in zip(texts, wide):
        for i in range(len(spans)):
            cells[feats(t, spans, i)] += 1
    w = pii.train(sorted(cells.items()))
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    for d, (t, spans) in enumerate(zip(texts, wide)):
        keep = [f"phone:{s}:{e}" for i, (s, e, _) in enumerate(spans) if w[0] + sum(a * b for a, b in zip(w[1:], feats(t, spans, i))) >= 0]
        assert got[d] == ",".join(keep), t
    assert got[0] and not got[2]


def test_exact_copies_edges(spark):
    rows = [(5, "a  b"), (3, "a\n\tb"), (9, "a b "), (1, None), (2, ""), (4, "a b"), (None, "a b"), (7, "x" * 1000 + "1"), (8, "x" * 1000 + "2"), (7, "x" * 1000 + "1"),
            (11, "y" * 1000 + "1"), (11, "y" * 1000 + "2"), (12, "y" * 1000 + "1")]
    docs = frame(spark, [(a, b, 1) for a, b in rows], "doc_id long, text string, group_size int")
    for limit in (0, 10**6):
        found = exact_dedup.exact_duplicates(docs, max_broadcast_keys=limit, digests=True).collect()
        assert len(found) == len(rows)
        eleven = {r.text_sha256: (r.keep_id, r.group_size, r.kept) for r in found if r.doc_id == 11}
        assert eleven == {hashlib.sha256(("y" * 1000 + k).encode()).hexdigest(): v for k, v in (("1", (11, 2, True)), ("2", (11, 1, True)))}
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found if r.doc_id not in (11, 12)}
        assert got == {5: (3, 4, False), 3: (3, 4, True), 4: (3, 4, False), None: (3, 4, False), 9: (9, 1, True), 1: (1, 2, True), 2: (1, 2, False), 7: (7, 2, True), 8: (8, 1, True)}
    assert exact_dedup.exact_duplicates(docs.where("false")).count() == 0


def test_mixing_meets_targets(spark, sf_dir):
    rows = [(i, "w " * (i % 50), f"s{i % 3}", 1) for i in range(3000)] + [(4000, "one two", None, 1), (4001, None, "s9", 1), (4002, " ", None, 1)]
    docs = frame(spark, rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    source = {i: s for i, _, s, _ in rows}
    for _, g in got.groupby(got["doc_id"].map(lambda i: source[i] or "null")):  # several sources have equal sizes
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= max(49, 0.5 * g["size"].max())
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].where(got["size"] > 0, 1) == 0).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    same(got, again)
    assert mixing.mix(docs.where("false")).count() == 0
    copies = mixing.mixed_documents(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    want = got[got.taken > 0].set_index("doc_id")
    assert (copies.sort_index() == (want["taken"] // want["size"]).sort_index()).all()


def test_hash_matches_contract_fold(spark):
    got = spark.range(50).select(queries._fold("id", 3).alias("f"), "id").collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in got)
    assert hashlib.sha256(b"").hexdigest()
