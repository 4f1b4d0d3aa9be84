"""The engine's operators as queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import values as V
from weft.operators import fusion, joins, profile, resolution, uncertainty, validation
from weft.operators.clustering import components, correlation_clusters
from weft.operators.joins import ROW, Aggregate
from weft.operators.resolution import MatchField
from weft.plans.planner import Transform, apply_transforms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """The driver's keys are dense from 0, so the key is the row number."""
    return df.withColumn(ROW, F.col(key).cast("long"))


# -- joins ------------------------------------------------------------------------------------------------------------------


def star(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with orders, customer, nation and region looked up in turn, and the unified table's columns."""
    nation = joins.lookup(table(spark, d, "nation"), table(spark, d, "region"), "n_regionkey", "r_regionkey", "region", {"r_name": "region"})
    customer = numbered(table(spark, d, "customer"), "c_custkey").where("c_custkey % 10 <> 0")
    customer = joins.lookup(customer, nation, "c_nationkey", "n_nationkey", "nation", {"n_name": "nation", "region": "region", "_match_region": "_match_region"})
    orders = joins.lookup(numbered(table(spark, d, "orders"), "o_orderkey"), customer, "o_custkey", "c_custkey", "customer",
                          {"c_name": "customer", "nation": "nation", "region": "region", "_match_nation": "_match_nation"})
    line = table(spark, d, "lineitem").withColumn(ROW, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    line = joins.lookup(line, orders, "l_orderkey", "o_orderkey", "orders",
                        {"o_orderdate": "orderdate", "customer": "customer", "nation": "nation", "region": "region", "_match_customer": "_match_customer", "_src_customer_row": "_src_customer_row"})
    out = joins.final_columns(line, "lineitem", {"orders": 0.95, "customer": 0.9})
    return out.withColumn("_match_probability", F.when(F.col("_match_customer"), 1 - (F.col("l_orderkey") % 5) * 0.05).otherwise(F.lit(1.0)))


_STAR_SQL = """
c AS (SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 10 <> 0),
o AS (SELECT o_orderkey, o_orderdate, c_custkey, c_name, n_name, r_name FROM orders LEFT JOIN c ON o_custkey = c_custkey),
s AS (SELECT l.*, 'lineitem:' || (l_orderkey * 10 + l_linenumber) AS _record_id, o.c_custkey AS _src_customer_row, o.o_orderkey AS _src_orders_row, o.c_name AS customer, o.n_name AS nation, o.r_name AS region,
             o.o_orderkey IS NOT NULL AS _match_orders, coalesce(o.c_custkey IS NOT NULL, false) AS _match_customer,
             CASE WHEN o.c_custkey IS NOT NULL THEN 1 - (l_orderkey % 5) * 0.05::DOUBLE ELSE 1.0::DOUBLE END AS p,
             CASE WHEN o.c_custkey IS NOT NULL THEN 0.95::DOUBLE * 0.9::DOUBLE WHEN o.o_orderkey IS NOT NULL THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS rc
      FROM lineitem l LEFT JOIN o ON l_orderkey = o_orderkey)"""


@query(f"WITH {_STAR_SQL} SELECT _record_id, _src_orders_row, _src_customer_row, customer, nation, region, _match_orders, _match_customer, CASE WHEN _match_customer THEN 0.9::DOUBLE WHEN _match_orders THEN 0.95::DOUBLE END AS _match_confidence, round(rc, 6) AS _relationship_confidence FROM s")
def unified_star(spark, d):
    out = star(spark, d)
    return out.select("_record_id", "_src_orders_row", "_src_customer_row", "customer", "nation", "region", "_match_orders", F.coalesce("_match_customer", F.lit(False)).alias("_match_customer"),
                      "_match_confidence", F.round("_relationship_confidence", 6).alias("_relationship_confidence"))


def revenue(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))


def _uncertain_sql(function: str) -> str:
    point = {"sum": "sum(x)", "count": "count(*)::DOUBLE", "avg": "avg(x)"}[function]
    expected = "sum(p * x) / sum(CASE WHEN x IS NOT NULL THEN p END)" if function == "avg" else "sum(p * x)"
    only = {"sum": "sum(x) FILTER (p >= 0.9)", "count": "(count(*) FILTER (p >= 0.9))::DOUBLE", "avg": "avg(x) FILTER (p >= 0.9)"}[function]
    x = "1.0::DOUBLE" if function == "count" else "l_extendedprice * (1 - l_discount)"
    k = 0 if function == "sum" else 3  # large sums differ in their last digits by the order of addition
    sd = "NULL::DOUBLE" if function == "avg" else f"round(sqrt(sum(p * (1 - p) * x * x)), {k})"
    return f"WITH {_STAR_SQL}, u AS (SELECT *, {x} AS x FROM s) SELECT region, count(*) AS rows, round({point}, {k}) AS point, round({expected}, {k}) AS expected, {sd} AS sd, round({only}, {k}) AS certain_only, round(avg(p), 6) AS mean_probability, round(min(rc), 6) AS min_relationship_confidence FROM u GROUP BY region"


def _uncertain(spark, d, function):
    out = uncertainty.aggregate_with_uncertainty(revenue(star(spark, d)), function, "revenue", "region")
    return out.select("region", "rows", *[F.round(c, 0 if function == "sum" else 3).alias(c) for c in ("point", "expected", "sd", "certain_only")], *[F.round(c, 6).alias(c) for c in ("mean_probability", "min_relationship_confidence")])


@query(_uncertain_sql("sum"))
def uncertain_sum(spark, d):
    return _uncertain(spark, d, "sum")


@query(_uncertain_sql("count"))
def uncertain_count(spark, d):
    return _uncertain(spark, d, "count")


@query(_uncertain_sql("avg"))
def uncertain_avg(spark, d):
    return _uncertain(spark, d, "avg")


@query(f"WITH {_STAR_SQL} SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 0) AS point, round(coalesce(sum(l_extendedprice * (1 - l_discount)) FILTER (NOT _match_customer), 0), 0) AS if_customer_wrong FROM s GROUP BY l_returnflag")
def scenario_if_wrong(spark, d):
    out = uncertainty.aggregate_with_uncertainty(revenue(star(spark, d)), "sum", "revenue", "l_returnflag", scenarios={"customer": "_match_customer"})
    return out.select("l_returnflag", F.round("point", 0).alias("point"), F.round("if_customer_wrong", 0).alias("if_customer_wrong"))


@query(f"WITH {_STAR_SQL} SELECT round(sum(p), 4) AS expected_rows, count(*) FILTER (p < 0.9) AS rows_below FROM s")
def expected_row_count(spark, d):
    return uncertainty.uncertain_rows(star(spark, d)).select(F.round("expected_rows", 4).alias("expected_rows"), "rows_below")


@query(f"WITH {_STAR_SQL} SELECT 'orders' AS alias, count(*) AS rows, count(*) FILTER (_match_orders) AS matched FROM s UNION ALL SELECT 'customer', count(*), count(*) FILTER (_match_customer) FROM s")
def match_statistics(spark, d):
    return joins.match_statistics(star(spark, d), ["orders", "customer"])


@query("SELECT o_orderkey, c_name AS customer_name, c_custkey IS NOT NULL AS _match_customer, c_custkey AS _src_customer_row FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey")
def lookup_join_flags(spark, d):
    child = numbered(table(spark, d, "customer"), "c_custkey").where("c_custkey % 7 <> 0")
    return joins.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), child, "o_custkey", "c_custkey", "customer", {"c_name": "customer_name"}).drop("o_custkey")


@query("""WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
SELECT c_custkey, e.event_type AS first_event, e.event_id AS _src_event_row, e.event_id IS NOT NULL AS _match_event FROM customer LEFT JOIN e ON c_custkey = e.user_id""")
def lookup_first_duplicate(spark, d):
    events = table(spark, d, "events").withColumn(ROW, F.col("event_id"))
    return joins.lookup(table(spark, d, "customer").select("c_custkey"), events, "c_custkey", "user_id", "event", {"event_type": "first_event"})


@query("""SELECT o_orderkey, c_custkey IS NOT NULL AS _match_c FROM (SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'CUST-' || lpad(o_custkey::VARCHAR, 6, '0') END AS k FROM orders) o
LEFT JOIN customer ON ltrim(substr(k, 6), '0') = CASE WHEN c_custkey = 0 THEN '' ELSE c_custkey::VARCHAR END AND k IS NOT NULL""")
def lookup_normalised_keys(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 11 != 0, F.concat(F.lit("CUST-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))).alias("k"))
    return joins.lookup(o, table(spark, d, "customer").select("c_custkey"), "k", "c_custkey", "c", {"c_custkey": "__x"}, "identifier").select("o_orderkey", "_match_c")


@query("""WITH a AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, max(o_orderdate) AS last, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN 'same' ELSE 'mixed' END AS st, count(DISTINCT o_orderpriority) AS prio FROM orders GROUP BY o_custkey)
SELECT c_custkey, a.n AS orders_record_count, a.total AS orders_total, a.mean AS orders_mean, a.last::DATE::VARCHAR AS orders_last, a.prio AS orders_priorities, a.n IS NOT NULL AS _match_orders FROM customer LEFT JOIN a ON c_custkey = o_custkey""")
def aggregate_lookup(spark, d):
    aggs = [Aggregate("o_totalprice", "sum", "orders_total"), Aggregate("o_totalprice", "avg", "orders_mean"), Aggregate("o_orderdate", "max", "orders_last"), Aggregate("o_orderpriority", "count_distinct", "orders_priorities")]
    out = joins.aggregate_lookup(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey", "orders", aggs)
    return out.select("c_custkey", "orders_record_count", F.round("orders_total", 2).alias("orders_total"), F.round("orders_mean", 6).alias("orders_mean"), F.col("orders_last").cast("date").cast("string").alias("orders_last"), "orders_priorities", "_match_orders")


@query("""SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS through, CASE WHEN min(l_tax) = max(l_tax) THEN min(l_tax) ELSE round(sum(l_tax), 6) END AS tax FROM lineitem GROUP BY l_orderkey""")
def aggregate_functional_dependency(spark, d):
    line = table(spark, d, "lineitem")
    out = joins.aggregate_to_key(line, F.col("l_orderkey"), [Aggregate("l_tax", "sum", "tax", through=True), Aggregate("l_linestatus", "min", "lo"), Aggregate("l_linestatus", "max", "hi")], "n")
    return out.select(F.col("__ck").alias("l_orderkey"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("through"), F.round("tax", 6).alias("tax"))


@query("""WITH f AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority AS usual FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""")
def aggregate_mode(spark, d):
    out = joins.aggregate_to_key(table(spark, d, "orders"), F.col("o_custkey"), [Aggregate("o_orderpriority", "mode", "usual")], "n")
    return out.select(F.col("__ck").alias("o_custkey"), "usual")


@query("SELECT s_suppkey, a.n_name AS home_n_name, b.n_name AS branch_n_name, a.n_nationkey IS NOT NULL AS _match_home, b.n_nationkey IS NOT NULL AS _match_branch FROM (SELECT *, (s_suppkey % 30)::INT AS branch FROM supplier) LEFT JOIN nation a ON s_nationkey = a.n_nationkey LEFT JOIN nation b ON branch = b.n_nationkey")
def role_joins(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 30).cast("int").alias("branch"))
    return joins.roles(s, table(spark, d, "nation"), "n_nationkey", {"home": "s_nationkey", "branch": "branch"}, ["n_name"]).drop("s_nationkey", "branch")


@query("""WITH s AS (SELECT * FROM orders ORDER BY md5(o_custkey::VARCHAR), o_orderkey LIMIT 100000000)
SELECT 'o_a' AS left_column, 'c_nationkey' AS right_column, count(*) AS compared, count(*) FILTER (a = c_nationkey) AS agreed FROM (SELECT o_custkey, (o_custkey % 25)::INT AS a FROM s) JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'o_b', 'c_mktsegment', count(*), count(*) FILTER (lower(b) = lower(c_mktsegment)) FROM (SELECT o_custkey, o_orderpriority AS b FROM s) JOIN customer ON o_custkey = c_custkey""")
def attribute_agreement(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_custkey") % 25).cast("int").alias("o_a"), F.col("o_orderpriority").alias("o_b"))
    return joins.agreement(o, table(spark, d, "customer"), "o_custkey", "c_custkey", [("o_a", "c_nationkey"), ("o_b", "c_mktsegment")], sample=None)


@query("SELECT event_id FROM events ORDER BY md5('7' || event_id::VARCHAR) LIMIT 500")
def hash_sample(spark, d):
    return joins.sample_by_hash(table(spark, d, "events"), F.col("event_id"), 500, "7").select("event_id")


@query("""SELECT o.event_id, f.event_id AS asof_event_id, f.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') o ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') f ON o.user_id = f.user_id AND o.ts >= f.ts""")
def as_of_join(spark, d):
    e = table(spark, d, "events")
    out = joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'"), "user_id", "ts", "ts", ["event_id", "value"])
    return out.select("event_id", "asof_event_id", "asof_value")


@query("""WITH r AS (SELECT 'c' || c_custkey AS rid, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 400 END AS k FROM customer UNION ALL SELECT 's' || s_suppkey, s_suppkey FROM supplier)
SELECT rid, coalesce(CASE WHEN k IS NOT NULL THEN min(rid) OVER (PARTITION BY k) END, rid) AS group_id FROM r""")
def key_groups_single(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("rid"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 400).cast("string").alias("k"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("rid"), F.col("s_suppkey").cast("string").alias("k"))
    return joins.key_groups(c.unionByName(s), ["k"]).select("rid", "group_id")


@query("""WITH n AS (SELECT 'o' || o_orderkey AS node, o_custkey AS c, o_orderkey - o_orderkey % 40 AS chain, 'o' AS kind FROM orders UNION ALL SELECT 'c' || c_custkey, c_custkey, NULL, 'c' FROM customer),
m AS (SELECT chain, min(node) AS label FROM n WHERE kind = 'o' GROUP BY chain)
SELECT node, CASE WHEN kind = 'o' THEN label ELSE node END AS label FROM n LEFT JOIN m USING (chain)""")
def connected_components(spark, d):
    """All orders, each linked to the next of its forty, and all customers, linked to nothing."""
    o, c = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "customer").select("c_custkey")
    nodes = o.select(F.concat(F.lit("o"), "o_orderkey").alias("node")).unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("node")))
    edges = o.where("o_orderkey % 40 <> 0").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("o"), F.col("o_orderkey") - 1).alias("b"))
    return components(nodes, edges)


@query()
def connected_components_whole(spark, d):
    """All customers, orders and suppliers, linked by all orders and lineitems."""
    c, o, s = (table(spark, d, t).select(F.concat(F.lit(t[0]), k).alias("node")) for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey")))
    of = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b"))
    by = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    return components(c.unionByName(o).unionByName(s), of.unionByName(by))


# -- profiling --------------------------------------------------------------------------------------------------------------

_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\", min({c}) AS min, max({c}) AS max, round(avg({c}), {4 if c == 'l_extendedprice' else 7}) AS mean, round(stddev_samp({c}), 6) AS stddev, round(quantile_cont({c}, 0.05), 6) AS q05, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.95), 6) AS q95 FROM lineitem" for c in _NUM))
def profile_numeric(spark, d):
    s = profile.column_statistics(table(spark, d, "lineitem").select(*_NUM))
    q = F.col("quantiles")
    return s.select("column", "rows", "non_null", "distinct", "min", "max", F.when(F.col("column") == "l_extendedprice", F.round("mean", 4)).otherwise(F.round("mean", 7)).alias("mean"), F.round("stddev", 6).alias("stddev"), F.round(q[0], 6).alias("q05"), F.round(q[2], 6).alias("q50"), F.round(q[4], 6).alias("q95"))


_TXT = ("c_name", "c_mktsegment")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(x) AS non_null, count(DISTINCT x) AS \"distinct\", round(avg(length(x)), 6) AS avg_length FROM (SELECT CASE WHEN c_custkey % 13 <> 0 THEN {c} END AS x FROM customer)" for c in _TXT))
def profile_text(spark, d):
    c = table(spark, d, "customer").select(*[F.when(F.col("c_custkey") % 13 != 0, F.col(x)).alias(x) for x in _TXT])
    return profile.column_statistics(c).select("column", "rows", "non_null", "distinct", F.round("avg_length", 6).alias("avg_length"))


@query("SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS duplicate_rows FROM lineitem")
def profile_duplicate_rows(spark, d):
    return profile.duplicate_rows(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", {c}::VARCHAR AS text, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS rank FROM part GROUP BY {c}) WHERE rank <= 25" for c in ("p_brand", "p_name", "p_size")))
def profile_top_values(spark, d):
    return profile.top_values(table(spark, d, "part").select("p_brand", "p_name", "p_size")).select("column", "text", "count", F.col("rank").cast("long"))


@query("""WITH s AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(left(v, 64), '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), '[0-9]+', '9', 'g'), '\\s+', ' ', 'g'), '#+', '#', 'g') AS pattern FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment || ' x' ELSE 'ab-' || c_custkey END AS v FROM customer))
SELECT left(pattern, 12) AS pattern, count(*) AS count, round(count(*) / (SELECT count(*) FROM s), 4) AS share FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def pattern_histogram(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.concat("c_mktsegment", F.lit(" x"))).otherwise(F.concat(F.lit("ab-"), k)).alias("v"))
    return profile.pattern_histogram(c, "v")


@query("""WITH v AS (SELECT DISTINCT 'o_custkey' AS "column", o_custkey::VARCHAR AS value FROM orders UNION SELECT 'o_orderpriority', lower(o_orderpriority) FROM orders), r AS (SELECT *, md5(value) AS h, row_number() OVER (PARTITION BY "column" ORDER BY md5(value)) AS r, count(*) OVER (PARTITION BY "column") <= 300 AS complete FROM v)
SELECT "column", value, h, complete FROM r WHERE r <= 300""")
def bottom_k_sketch(spark, d):
    return profile.bottom_k(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], 300, lambda c: F.md5(c.cast("binary")))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT c_custkey AS v FROM customer WHERE c_custkey % 4 <> 0), x AS (SELECT count(*) AS n FROM a JOIN b USING (v)), na AS (SELECT count(*) AS n FROM a), nb AS (SELECT count(*) AS n FROM b)
SELECT 'a' AS "left", 'b' AS "right", na.n AS n_left, nb.n AS n_right, x.n AS intersection, round(x.n / (na.n + nb.n - x.n), 9) AS jaccard, round(x.n / na.n, 9) AS containment_left, round(x.n / nb.n, 9) AS containment_right FROM x, na, nb""")
def overlap_statistics(spark, d):
    a = profile.bottom_k(table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("a")), k=10_000_000)
    b = profile.bottom_k(table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("b")), k=10_000_000)
    out = profile.overlap_statistics(a.unionByName(b)).drop("exact")
    return out.select("left", "right", "n_left", "n_right", "intersection", *[F.round(c, 9).alias(c) for c in ("jaccard", "containment_left", "containment_right")])


_MIN_SQL = ", ".join(f"min(md5('{i}|' || value))" for i in range(16))


@query(f"""WITH v AS (SELECT 'o_custkey' AS "column", o_custkey::VARCHAR AS value FROM orders UNION SELECT 'o_orderpriority', lower(o_orderpriority) FROM orders UNION SELECT 'o_orderstatus', lower(o_orderstatus) FROM orders)
SELECT "column", array_to_string([{_MIN_SQL}], ',') AS signature FROM v GROUP BY 1""")
def minhash_signatures(spark, d):
    s = profile.bottom_k(table(spark, d, "orders"), ["o_custkey", "o_orderpriority", "o_orderstatus"], 10_000_000)
    made = profile.minhash(s, 16, lambda value, seed: F.md5(F.concat(F.lit(f"{seed}|"), value).cast("binary")))
    return made.select("column", F.array_join("signature", ",").alias("signature"))


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT DISTINCT '{c}' AS \"column\", {c}::VARCHAR AS text FROM part ORDER BY text LIMIT 10)" for c in ("p_brand", "p_size")))
def sample_values(spark, d):
    return profile.sample_values(table(spark, d, "part"), ["p_brand", "p_size"])


@query("SELECT o_orderkey FROM orders ORDER BY md5('42' || o_orderkey::VARCHAR) LIMIT 1000")
def sample_rows(spark, d):
    return profile.sample_rows(table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"))


@query("SELECT count(*) FILTER (c_custkey % 17 = 0) AS a, count(*) AS n FROM customer")
def conditional_counts(spark, d):
    return table(spark, d, "customer").agg(F.count_if(F.col("c_custkey") % 17 == 0).alias("a"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def preview_page(spark, d):
    return numbered(table(spark, d, "orders"), "o_orderkey").orderBy(ROW).offset(50).limit(100).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS rn FROM lineitem")
def dense_row_numbers(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = joins.with_row_numbers(line, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", F.col(ROW).alias("rn"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS o_totalprice FROM orders")
def json_cells(spark, d):
    from weft.sources.sinks import json_ready

    k = F.col("o_orderkey")
    return json_ready(table(spark, d, "orders").select(k, "o_orderdate", F.when(k % 5 != 0, F.col("o_totalprice")).otherwise(F.lit(float("nan"))).alias("o_totalprice")))


@query("SELECT node, 1::BIGINT AS rounds FROM (SELECT DISTINCT user_id AS node FROM events) UNION ALL SELECT user_id, 2 FROM (SELECT DISTINCT user_id FROM events)")
def united_histories(spark, d):
    """Histories that two merges recorded, in one."""
    h = table(spark, d, "events").select(F.col("user_id").alias("node")).distinct()
    both = fusion.united_histories([("2024-01-01 00:00:00", h), ("2024-02-01 00:00:00", h)])
    return both.select("node", F.month("recorded_at").cast("long").alias("rounds"))


# -- values -----------------------------------------------------------------------------------------------------------------

_RAW = "CASE c_custkey % 5 WHEN 0 THEN '  ' || c_name || '  X ' WHEN 1 THEN 'CUST-00' || c_custkey WHEN 2 THEN c_custkey || '.0' WHEN 3 THEN '+91 (' || lpad(c_custkey::VARCHAR, 5, '0') || ') 43-210' ELSE '' END"


def _raw(spark, d):
    k = F.col("c_custkey")
    s = k.cast("string")
    return table(spark, d, "customer").select(k, F.when(k % 5 == 0, F.concat(F.lit("  "), "c_name", F.lit("  X "))).when(k % 5 == 1, F.concat(F.lit("CUST-00"), s)).when(k % 5 == 2, F.concat(s, F.lit(".0")))
                                              .when(k % 5 == 3, F.concat(F.lit("+91 ("), F.lpad(s, 5, "0"), F.lit(") 43-210"))).otherwise("").alias("v"))


_BASIC_SQL = "nullif(regexp_replace(trim(regexp_replace(lower(v), '\\s+', ' ', 'g')), '^(-?\\d+)\\.0+$', '\\1'), '')"


@query(f"SELECT c_custkey, {_BASIC_SQL} AS basic FROM (SELECT c_custkey, {_RAW} AS v FROM customer)")
def normalise_basic(spark, d):
    return _raw(spark, d).select("c_custkey", V.basic(F.col("v")).alias("basic"))


@query(f"SELECT c_custkey, nullif(trim(regexp_replace(regexp_replace({_BASIC_SQL}, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '') AS alnum FROM (SELECT c_custkey, {_RAW} AS v FROM customer)")
def normalise_alnum(spark, d):
    return _raw(spark, d).select("c_custkey", V.alnum(F.col("v")).alias("alnum"))


@query(f"SELECT c_custkey, CASE WHEN regexp_matches(s, '^\\d+$') THEN coalesce(nullif(ltrim(s, '0'), ''), '0') ELSE b END AS ident FROM (SELECT c_custkey, b, regexp_replace(b, '^[a-z]+[-_ ]?', '') AS s FROM (SELECT c_custkey, {_BASIC_SQL} AS b FROM (SELECT c_custkey, {_RAW} AS v FROM customer)))")
def normalise_identifier(spark, d):
    return _raw(spark, d).select("c_custkey", V.identifier(F.col("v")).alias("ident"))


@query(f"SELECT c_custkey, CASE WHEN length(x) >= 6 THEN right(x, 10) END AS digits FROM (SELECT c_custkey, regexp_replace(v, '\\D', '', 'g') AS x FROM (SELECT c_custkey, {_RAW} AS v FROM customer))")
def normalise_digits(spark, d):
    return _raw(spark, d).select("c_custkey", V.digits(F.col("v")).alias("digits"))


_CITY = "['Bangalore', 'New York City', 'NYC, NY', 'Kings County', 'Pune', 'San Francisco, California'][(c_custkey % 6 + 1)::INT]"
_CITY_OUT = "['bengaluru', 'new york', 'new york', 'kings', 'pune', 'san francisco'][(c_custkey % 6 + 1)::INT]"


@query(f"SELECT c_custkey, {_CITY_OUT} AS city FROM customer")
def normalise_city(spark, d):
    names = F.array(*[F.lit(x) for x in ("Bangalore", "New York City", "NYC, NY", "Kings County", "Pune", "San Francisco, California")])
    return table(spark, d, "customer").select("c_custkey", V.normalizer("semantic:CITY")(F.element_at(names, (F.col("c_custkey") % 6 + 1).cast("int"))).alias("city"))


@query("SELECT c_custkey, ['jane doe', 'jane doe', 'john van dyke', NULL][(c_custkey % 4 + 1)::INT] AS person FROM customer")
def normalise_person(spark, d):
    names = F.array(*[F.lit(x) for x in ("Doe, Dr. Jane", "  Mrs Jané   Doe ", "John van-Dyke", "")])
    return table(spark, d, "customer").select("c_custkey", V.person_name(F.element_at(names, (F.col("c_custkey") % 4 + 1).cast("int"))).alias("person"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS day FROM orders")
def parse_dates_mixed(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    layouts = ["yyyy-MM-dd", "d/M/yyyy", "d MMM yyyy", "dd.MM.yyyy", "yyyy-MM-dd'T'HH:mm:ss"]
    text = F.lit("not a date")
    for i, p in enumerate(layouts):
        text = F.when(k % 6 == i, F.date_format(t, p)).otherwise(text)
    return table(spark, d, "orders").select(k, V.parse_date(text, dayfirst=True).cast("string").alias("day"))


_AMT = "['₹' || a, 'USD ' || a, a || ' EUR', a, 'Rs. ' || a || ' only', 'n/a'][(o_orderkey % 6 + 1)::INT]"


@query("""WITH x AS (SELECT o_orderkey, o_totalprice::DECIMAL(18, 2)::DOUBLE AS a, ['INR', 'USD', 'EUR', 'USD', 'INR', NULL][(o_orderkey % 6 + 1)::INT] AS code, [0.0117, 1.0, 1.08, 1.0, 0.0117, NULL][(o_orderkey % 6 + 1)::INT]::DOUBLE AS rate FROM orders)
SELECT o_orderkey, code, CASE WHEN code IS NOT NULL THEN a END AS amount, CASE WHEN code <> 'INR' THEN round(a * rate, 4) END AS usd FROM x""")
def parse_currency(spark, d):
    k, a = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    forms = [F.concat(F.lit("₹"), a), F.concat(F.lit("USD "), a), F.concat(a, F.lit(" EUR")), a, F.concat(F.lit("Rs. "), a, F.lit(" only")), F.lit("n/a")]
    text = F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))
    o = table(spark, d, "orders").select(k, text.alias("t"), F.when(k % 6 == 3, "USD").alias("fallback"))
    o = o.withColumns({"amount": V.currency_amount(F.col("t")), "code": V.currency_code(F.col("t"), F.col("fallback"))})
    return o.select("o_orderkey", "code", "amount", F.when(F.col("code") != "INR", V.to_base(F.col("amount"), F.col("code"))).alias("usd"))


@query("SELECT o_orderkey, round(o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 1.27::DOUBLE WHEN 1 THEN 1.08::DOUBLE END, 4) AS o_totalprice, o_totalprice AS raw FROM orders")
def transform_columns(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k, "o_totalprice", F.when(k % 3 == 0, "gbp").when(k % 3 == 1, "EUR").otherwise("XXX").alias("ccy"))
    out = apply_transforms(o, [Transform("o_totalprice", "convert_currency", code_column="ccy")])
    return out.select("o_orderkey", "o_totalprice", F.col("o_totalprice_raw").alias("raw"))


# -- entity resolution --------------------------------------------------------------------------------------------------------

_FIRST = ("anna", "bela", "carl", "dora", "emil", "fred", "gina", "hugo", "ines", "jane", "karl", "lena", "mona", "nils", "olga", "paul", "rita", "saul", "tina", "ugo")
_LAST = ("adams", "baker", "clark", "davis", "evans", "frank", "ghosh", "hills", "irwin", "jones", "klein", "lopez", "meyer", "novak", "owens", "patel", "quinn", "rossi", "singh", "turner")


def people(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers as person records of two systems: rid, dataset, name, email, phone, amount."""
    def pick(words, c):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (c % len(words) + 1).cast("int"))

    def frame(df, key, dataset, prefix):
        k = F.col(key)
        return df.select(F.concat(F.lit(prefix), F.lpad(k.cast("string"), 9, "0")).alias("rid"), F.lit(dataset).alias("dataset"), F.concat(pick(_FIRST, k), F.lit(" "), pick(_LAST, F.floor(k / 3))).alias("name"),
                         F.when(k % 4 != 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@x.org"))).alias("email"), F.when(k % 5 != 0, F.concat(F.lit("+1 555 "), F.lpad((k % 700).cast("string"), 7, "0"))).alias("phone"), (k % 50).cast("double").alias("amount"))
    return frame(table(spark, d, "customer"), "c_custkey", "crm", "c").unionByName(frame(table(spark, d, "supplier"), "s_suppkey", "erp", "s"))


def _people_sql() -> str:
    def one(t, key, ds, prefix):
        first, last = (f"[{', '.join(repr(w) for w in ws)}]" for ws in (_FIRST, _LAST))
        return f"SELECT '{prefix}' || lpad({key}::VARCHAR, 9, '0') AS rid, '{ds}' AS dataset, {first}[({key} % 20 + 1)::INT] AS fn, {last}[(({key} // 3) % 20 + 1)::INT] AS ln, CASE WHEN {key} % 4 <> 0 THEN 'u' || {key} || '@x.org' END AS email, CASE WHEN {key} % 5 <> 0 THEN '1555' || lpad(({key} % 700)::VARCHAR, 7, '0') END AS phone, ({key} % 50)::DOUBLE AS amount FROM {t}"
    return f"people AS ({one('customer', 'c_custkey', 'crm', 'c')} UNION ALL {one('supplier', 's_suppkey', 'erp', 's')})"


_FIELDS = [MatchField("name", "NAME"), MatchField("email", "EMAIL"), MatchField("phone", "PHONE", "digits"), MatchField("amount", "NUMERIC")]
_PLAIN = _FIELDS[1:]


@query(f"WITH {_people_sql()} SELECT DISTINCT x.rid AS a, y.rid AS b FROM people x JOIN people y ON x.rid < y.rid AND x.dataset <> y.dataset AND (x.email = y.email OR right(x.phone, 10) = right(y.phone, 10))")
def block_standard(spark, d):
    r = people(spark, d)
    return resolution._pairs(resolution.standard_blocks(r, _FIELDS), ())


@query(f"""WITH {_people_sql()}, k AS (SELECT *, ln || '|' || left(fn, 1) AS b0 FROM people), n AS (SELECT b0, count(*) AS n FROM k GROUP BY b0),
s AS (SELECT k.rid, k.dataset, CASE WHEN n.n > 3 THEN b0 || '|' || fn ELSE b0 END AS b FROM k JOIN n USING (b0)) SELECT DISTINCT x.rid AS a, y.rid AS b FROM s x JOIN s y ON x.b = y.b AND x.rid < y.rid AND x.dataset <> y.dataset""")
def block_token(spark, d):
    return resolution._pairs(resolution.token_blocks(people(spark, d), _FIELDS[0], [], 3), ())


@query(f"""WITH {_people_sql()}, o AS (SELECT rid, dataset, row_number() OVER (ORDER BY ln || ' ' || fn, rid) AS r FROM people)
SELECT DISTINCT least(x.rid, y.rid) AS a, greatest(x.rid, y.rid) AS b FROM o x JOIN o y ON y.r BETWEEN x.r + 1 AND x.r + 4 AND x.dataset <> y.dataset""")
def block_sorted_neighbourhood(spark, d):
    return resolution.sorted_neighbourhood(people(spark, d), _FIELDS[0], 5)


@query(f"""WITH {_people_sql()}, p AS (SELECT count(*) AS n FROM people x JOIN people y ON x.email = y.email AND x.dataset < y.dataset), c AS (SELECT count(*) FILTER (dataset = 'crm') AS a, count(*) FILTER (dataset = 'erp') AS b FROM people)
SELECT a + b AS records, a * b AS admissible_pairs, n AS candidate_pairs, round(1 - n / (a * b), 6) AS reduction_ratio FROM p, c""")
def blocking_reduction(spark, d):
    r = people(spark, d)
    pairs = resolution._pairs(resolution.standard_blocks(r, [_FIELDS[1]]), ())
    return resolution.blocking_statistics(r, pairs)


def _levels(spark, d):
    r = people(spark, d)
    pairs = resolution._pairs(resolution.standard_blocks(r, [_FIELDS[1], _FIELDS[2]]), ())
    return resolution.compared(r, pairs, _PLAIN)


_LEVELS_SQL = f"""{_people_sql()}, lv AS (SELECT x.rid AS a, y.rid AS b,
 CASE WHEN x.email IS NULL OR y.email IS NULL THEN 'null' WHEN x.email = y.email THEN 'exact' ELSE 'different' END AS email,
 CASE WHEN x.phone IS NULL OR y.phone IS NULL THEN 'null' WHEN right(x.phone, 10) = right(y.phone, 10) THEN 'exact' WHEN right(x.phone, 7) = right(y.phone, 7) THEN 'high' ELSE 'different' END AS phone,
 CASE WHEN x.amount = y.amount THEN 'exact' WHEN abs(x.amount - y.amount) <= 0.001 * greatest(x.amount, y.amount) THEN 'high' WHEN abs(x.amount - y.amount) <= 0.05 * greatest(x.amount, y.amount) THEN 'medium' ELSE 'different' END AS amount
 FROM people x JOIN people y ON x.rid < y.rid AND x.dataset <> y.dataset AND (x.email = y.email OR right(x.phone, 10) = right(y.phone, 10)))"""


@query(f"WITH {_LEVELS_SQL} SELECT * FROM lv")
def compare_levels(spark, d):
    return _levels(spark, d)


@query(f"WITH {_LEVELS_SQL} SELECT email, phone, amount, count(*) AS n FROM lv GROUP BY ALL")
def pattern_counts(spark, d):
    return resolution.pattern_counts(_levels(spark, d), ["email", "phone", "amount"])


_M = {"exact": 0.8, "high": 0.1, "medium": 0.06, "different": 0.04}
_U = {"exact": 0.01, "high": 0.02, "medium": 0.07, "different": 0.9}
_LLR_SQL = " + ".join(f"CASE {f} " + " ".join(f"WHEN '{v}' THEN log2({_M[v]} / {_U[v]})" for v in _M) + " ELSE 0 END" for f in ("email", "phone", "amount"))


@query(f"WITH {_LEVELS_SQL}, w AS (SELECT a, b, log2(0.01 / 0.99) + {_LLR_SQL} AS weight FROM lv) SELECT a, b, round(weight, 6) AS weight, round(1 / (1 + pow(2.0, -weight)), 6) AS p FROM w")
def fellegi_sunter_scores(spark, d):
    names = ["email", "phone", "amount"]
    model = resolution.FSModel(names, {f: _M for f in names}, {f: _U for f in names}, 0.01)
    return resolution.scored(_levels(spark, d), model).select("a", "b", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"))


@query(f"WITH {_people_sql()}, c AS (SELECT email AS value, count(*) AS n FROM people WHERE email IS NOT NULL GROUP BY 1) SELECT value, n, round(n / sum(n) OVER (), 9) AS frequency FROM c")
def term_frequencies(spark, d):
    out = resolution.term_frequencies(people(spark, d), _FIELDS[1])
    return out.select("value", "n", F.round("frequency", 9).alias("frequency"))


@query("WITH p AS (SELECT event_id AS a, event_id + 1 AS b, ((event_id * 37) % 997 + 1) / 1000.0::DOUBLE AS p FROM events) SELECT a, b, p FROM p WHERE p > 0.01 AND p < 0.999 ORDER BY abs(p - 0.5), a, b LIMIT 50")
def review_queue_top(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("a"), (F.col("event_id") + 1).alias("b"), (((F.col("event_id") * 37) % 997 + 1) / F.lit(1000.0)).alias("p"))
    return resolution.review_queue(e, 50).select("a", "b", "p")


@query()
def entity_resolution(spark, d):
    """Block, compare, fit, score and cluster customers against suppliers."""
    return resolution.resolve(people(spark, d), _FIELDS).entities


@query("SELECT 'e' || lpad(event_id::VARCHAR, 12, '0') AS node, min('e' || lpad(event_id::VARCHAR, 12, '0')) OVER (PARTITION BY user_id, event_type) AS cluster FROM events")
def correlation_clustering(spark, d):
    """All events: those of a user and type belong together, those of a user and another type apart."""
    e = table(spark, d, "events").select(F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("node"), "user_id", "event_type")
    a, b = e.toDF("a", "user_id", "ta"), e.toDF("b", "user_id", "tb")
    pairs = a.join(b, "user_id").where("a < b").select("a", "b", F.when(F.col("ta") == F.col("tb"), 0.95).otherwise(0.05).alias("p"))
    return correlation_clusters(e.select("node"), pairs, 0.5)


def _scored_events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("a"), (F.col("event_id") + 1).alias("b"), (((F.col("event_id") * 37) % 997 + 1) / F.lit(1000.0)).alias("p"))


_SCORED_SQL = "p AS (SELECT event_id AS a, event_id + 1 AS b, ((event_id * 37) % 997 + 1) / 1000.0::DOUBLE AS p FROM events)"


@query(f"WITH {_SCORED_SQL} SELECT a, b, p FROM p ORDER BY p DESC, a, b LIMIT 2000")
def strongest_pairs(spark, d):
    return resolution.strongest_pairs(_scored_events(spark, d))


@query(f"WITH {_SCORED_SQL} SELECT a, b, p FROM p WHERE p > 0.01 AND p < 0.999 ORDER BY md5('7|' || a || '|' || b) LIMIT 40")
def random_review(spark, d):
    return resolution.random_review(_scored_events(spark, d), 40)


# Persons whom two systems describe: every customer in one, every third also in the other, with another city for every sixth.
def persons(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k = F.col("c_custkey")
    letters = F.translate(F.lpad(k.cast("string"), 9, "0"), "0123456789", "abcdefghij")
    name = F.concat(F.initcap(F.translate(F.reverse(letters), "abcdefghij", "klmnopqrst")), F.lit(" "), F.initcap(letters))
    base = table(spark, d, "customer").select(k, name.alias("n"), F.concat(F.lit("u"), k, F.lit("@mail.org")).alias("e"), F.concat(F.lit("+1 555 "), F.lpad(k.cast("string"), 7, "0")).alias("p"),
                                              F.element_at(F.array(*[F.lit(x) for x in ("Pune", "Delhi", "Turin", "Lyon")]), (k % 4 + 1).cast("int")).alias("c"))
    crm = base.select(k.alias("customer_id"), F.col("n").alias("customer_name"), F.col("e").alias("email"), F.col("p").alias("phone"), F.col("c").alias("city"))
    erp = base.where("c_custkey % 3 = 0").select((k + 500_000_000).alias("member_no"), F.upper("n").alias("full_name"), F.col("e").alias("mail"), F.col("p").alias("phone_number"),
                                                 F.when(k % 6 == 0, "Oslo").otherwise(F.col("c")).alias("town"), (k % 9).cast("double").alias("score"))
    return {"crm": crm.withColumn(ROW, F.col("customer_id")), "erp": erp.withColumn(ROW, F.col("member_no") - 500_000_000)}


@query("""WITH r AS (SELECT c_custkey AS k, 'crm:' || lpad(c_custkey::VARCHAR, 12, '0') AS rid, c_custkey FROM customer UNION ALL SELECT c_custkey, 'erp:' || lpad(c_custkey::VARCHAR, 12, '0'), c_custkey FROM customer WHERE c_custkey % 3 = 0)
SELECT rid, 'crm:' || lpad(k::VARCHAR, 12, '0') AS first FROM r""")
def resolve_persons(spark, d):
    """Blocking, comparison, estimation, scoring and clustering of two systems whose persons are well apart."""
    both = persons(spark, d)
    x = both["crm"].select(F.concat(F.lit("crm:"), F.lpad(F.col(ROW).cast("string"), 12, "0")).alias("rid"), F.lit("crm").alias("dataset"), F.col("customer_name").alias("name"), "email", "phone")
    y = both["erp"].select(F.concat(F.lit("erp:"), F.lpad(F.col(ROW).cast("string"), 12, "0")).alias("rid"), F.lit("erp").alias("dataset"), F.col("full_name").alias("name"), F.col("mail").alias("email"), F.col("phone_number").alias("phone"))
    found = resolution.resolve(x.unionByName(y), _FIELDS[:3]).entities
    firsts = found.groupBy("entity_id").agg(F.min("node").alias("first"))
    return found.join(firsts, "entity_id").select(F.col("node").alias("rid"), "first")


@query("""SELECT c_custkey AS customer_id, (CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS records, ['Pune', 'Delhi', 'Turin', 'Lyon'][(c_custkey % 4 + 1)::INT] AS city, c_custkey % 6 = 0 AND c_custkey % 3 = 0 AS has_conflict,
CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 9)::DOUBLE END AS score, CASE WHEN c_custkey % 3 = 0 THEN '["crm","erp"]' ELSE '["crm"]' END AS sources FROM customer""")
def merged_entities(spark, d):
    """A merge whose plan resolves two systems into entities, fuses them and attaches them to the anchor's rows."""
    from weft.plans.entity_groups import EntityGroup, GroupField
    from weft.plans.planner import MergePlan, executed

    both = persons(spark, d)
    fields = [GroupField("name", "NAME", "basic", {"crm": "customer_name", "erp": "full_name"}), GroupField("mail", "EMAIL", "basic", {"crm": "email", "erp": "mail"}),
              GroupField("phone_no", "PHONE", "digits", {"crm": "phone", "erp": "phone_number"}), GroupField("place", "CITY", "basic", {"crm": "city", "erp": "town"})]
    plan = MergePlan("crm", [], {}, [EntityGroup("G1", ["crm", "erp"], fields)])
    out = executed(plan, both, {n: profile.profile(df.drop(ROW), n) for n, df in both.items()}).unified
    return out.select("customer_id", F.col("_entity_record_count").alias("records"), F.col("place").alias("city"), F.col("_has_conflict").alias("has_conflict"), "score", F.col("_entity_sources").alias("sources"))


# -- fusion and history -------------------------------------------------------------------------------------------------------


def members(spark: SparkSession, d: str) -> DataFrame:
    """Events as records of five sources about a user."""
    order = F.create_map(*[F.lit(x) for kv in (("view", 0), ("click", 1), ("purchase", 2), ("signup", 3), ("error", 4)) for x in kv])
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("dataset"), F.col("event_id").alias("row"), F.element_at(order, F.col("event_type")).alias("priority"),
                                            "ts", ((F.col("event_id") % 10) / 10.0).alias("confidence"), F.concat(F.lit("T"), (F.col("event_id") % 5).cast("string")).alias("tier"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("parity"))


def _candidates(spark, d):
    return fusion.candidate_values(members(spark, d), {"tier": "tier", "parity": "parity"})


_CAND_SQL = """m AS (SELECT user_id::VARCHAR AS entity_id, event_type AS dataset, event_id AS row, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS priority, ts, (event_id % 10) / 10.0::DOUBLE AS confidence, 'T' || (event_id % 5) AS tier, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM events),
c AS (SELECT * EXCLUDE (tier, parity), 'tier' AS attribute, tier AS value, lower(tier) AS norm FROM m UNION ALL SELECT * EXCLUDE (tier, parity), 'parity', parity, parity FROM m),
g AS (SELECT entity_id, attribute, count(DISTINCT norm) AS n_values, count(*) AS n_candidates, arg_min(value, (priority, dataset, row)) AS first FROM c GROUP BY ALL)"""


def _fuse_sql(pick: str) -> str:
    return f"WITH {_CAND_SQL}, b AS ({pick}) SELECT g.entity_id, g.attribute, CASE WHEN n_values > 1 THEN b.v ELSE first END AS resolved, n_values, n_candidates, n_values > 1 AS conflict FROM g JOIN b USING (entity_id, attribute)"


def _vote_sql(weight: str) -> str:
    return f"SELECT entity_id, attribute, value AS v FROM (SELECT entity_id, attribute, norm, {weight} AS w, min((priority, dataset, row)) AS k, arg_min(value, (priority, dataset, row)) AS value FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity_id, attribute ORDER BY w DESC, k) = 1"


@query(_fuse_sql(_vote_sql("count(*)")))
def fuse_majority_vote(spark, d):
    return fusion.resolved_values(_candidates(spark, d), "majority_vote")


@query(_fuse_sql("SELECT entity_id, attribute, arg_min(value, (priority, dataset, row)) AS v FROM c GROUP BY ALL"))
def fuse_prefer_source(spark, d):
    return fusion.resolved_values(_candidates(spark, d), "prefer_source")


@query(_fuse_sql("SELECT entity_id, attribute, arg_max(value, (ts, -priority)) AS v FROM c GROUP BY ALL"))
def fuse_prefer_latest(spark, d):
    return fusion.resolved_values(_candidates(spark, d), "prefer_latest")


@query(_fuse_sql("SELECT entity_id, attribute, arg_min(value, (priority, dataset, row)) AS v FROM c GROUP BY ALL"))
def fuse_prefer_non_null(spark, d):
    return fusion.resolved_values(_candidates(spark, d), "prefer_non_null")


@query(_fuse_sql("SELECT entity_id, attribute, arg_min(value, (-confidence, priority, dataset, row)) AS v FROM c GROUP BY ALL"))
def fuse_highest_confidence(spark, d):
    return fusion.resolved_values(_candidates(spark, d), "highest_confidence")


@query(_fuse_sql("SELECT entity_id, attribute, '[' || string_agg('\"' || v || '\"', ',' ORDER BY k) || ']' AS v FROM (SELECT entity_id, attribute, norm, min((priority, dataset, row)) AS k, arg_min(value, (priority, dataset, row)) AS v FROM c GROUP BY ALL) GROUP BY ALL"))
def fuse_keep_all(spark, d):
    return fusion.resolved_values(_candidates(spark, d), "keep_all")


@query(_fuse_sql("SELECT DISTINCT entity_id, attribute, NULL::VARCHAR AS v FROM c"))
def fuse_manual_review(spark, d):
    return fusion.resolved_values(_candidates(spark, d), "manual_review")


def _accuracy_sql(rounds: int) -> str:
    steps = ["a0 AS (SELECT DISTINCT dataset, 0.8::DOUBLE AS accuracy FROM c)"]
    for i in range(rounds):
        steps += [f"v{i} AS (SELECT entity_id, attribute, norm, round(sum(ln(least(greatest(accuracy, 0.01), 0.99) / (1 - least(greatest(accuracy, 0.01), 0.99)))), 9) AS w FROM c JOIN a{i} USING (dataset) GROUP BY ALL)",
                  f"w{i} AS (SELECT entity_id, attribute, norm AS win FROM v{i} QUALIFY row_number() OVER (PARTITION BY entity_id, attribute ORDER BY w DESC, norm) = 1)",
                  f"a{i + 1} AS (SELECT dataset, (count(*) FILTER (norm = win) + 1) / (count(*) + 2)::DOUBLE AS accuracy FROM c JOIN w{i} USING (entity_id, attribute) GROUP BY dataset)"]
    return ", ".join(steps)


@query(_fuse_sql(_vote_sql("round(sum(ln(least(greatest(accuracy, 0.01), 0.99) / (1 - least(greatest(accuracy, 0.01), 0.99)))), 9)").replace("FROM c GROUP", "FROM c JOIN a3 USING (dataset) GROUP")).replace(_CAND_SQL, f"{_CAND_SQL}, {_accuracy_sql(3)}"))
def fuse_source_accuracy(spark, d):
    c = _candidates(spark, d)
    return fusion.resolved_values(c, "source_accuracy_vote", fusion.source_accuracy(c, 3))


@query(f"""WITH {_CAND_SQL}, b AS ({_vote_sql('count(*)')}), r AS (SELECT entity_id, attribute, CASE WHEN n_values > 1 THEN b.v ELSE first END AS resolved, n_values FROM g JOIN b USING (entity_id, attribute) WHERE n_candidates > 1)
SELECT entity_id, attribute, arg_min(c.dataset, (c.priority, c.dataset, c.row)) AS source_dataset, arg_min(c.row, (c.priority, c.dataset, c.row)) AS source_row, CASE WHEN max(n_values) > 1 THEN 'majority_vote' ELSE 'agreement' END AS strategy
FROM c JOIN r USING (entity_id, attribute) WHERE c.value = r.resolved GROUP BY entity_id, attribute""")
def cell_provenance(spark, d):
    return fusion.cell_provenance(_candidates(spark, d), "majority_vote").drop("reason")


@query(f"WITH {_CAND_SQL} SELECT entity_id, attribute, n_candidates FROM g WHERE n_values > 1")
def conflict_report(spark, d):
    return fusion.conflicts(_candidates(spark, d), "majority_vote").select("entity_id", "attribute", F.size("candidates").cast("long").alias("n_candidates"))


@query(f"WITH {_CAND_SQL} SELECT attribute, count(*) AS conflicts FROM g WHERE n_values > 1 GROUP BY 1")
def conflicts_by_attribute(spark, d):
    return fusion.resolved_values(_candidates(spark, d), "majority_vote").where("conflict").groupBy("attribute").agg(F.count("*").alias("conflicts"))


_TIER_SQL = f"{_fuse_sql(_vote_sql('count(*)'))}"


@query(f"WITH r AS ({_TIER_SQL}), x AS (SELECT user_id::VARCHAR AS entity_id, count(*) AS n FROM events GROUP BY 1) SELECT x.entity_id, n AS _entity_record_count, max(resolved) FILTER (attribute = 'tier') AS tier, max(resolved) FILTER (attribute = 'parity') AS parity, bool_or(conflict) AS _has_conflict FROM x JOIN r USING (entity_id) GROUP BY ALL")
def entity_table(spark, d):
    out = fusion.entity_records(_candidates(spark, d), members(spark, d), ["tier", "parity"], "majority_vote")
    return out.select("entity_id", "_entity_record_count", "tier", "parity", "_has_conflict")


def _history(spark, d):
    m = members(spark, d)
    return fusion.history(m.select("entity_id", F.lit("event_type").alias("attribute"), F.col("dataset").alias("value"), F.col("dataset").alias("norm"), F.when(F.col("row") % 50 != 0, F.col("ts")).alias("ts"), "priority", "dataset"))


_HIST_SQL = """v AS (SELECT user_id::VARCHAR AS entity_id, event_type AS value, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS priority FROM events),
mo AS (SELECT entity_id, ts, arg_min(value, (priority, value)) AS value FROM v WHERE ts IS NOT NULL GROUP BY ALL), ch AS (SELECT *, (lag(value) OVER w IS DISTINCT FROM value)::INT AS c FROM mo WINDOW w AS (PARTITION BY entity_id ORDER BY ts)),
ru AS (SELECT *, sum(c) OVER (PARTITION BY entity_id ORDER BY ts) AS run FROM ch), sp AS (SELECT entity_id, run, min(ts) AS valid_from, min(value) AS value, count(*) AS support FROM ru GROUP BY ALL),
h AS (SELECT entity_id, value, valid_from, lead(valid_from) OVER (PARTITION BY entity_id ORDER BY valid_from) AS valid_to, support FROM sp)"""


@query(f"WITH {_HIST_SQL} SELECT entity_id, value, epoch_us(valid_from) AS valid_from, epoch_us(valid_to) AS valid_to, support, valid_to IS NULL AS current FROM h UNION ALL SELECT entity_id, value, NULL, NULL, count(*), false FROM v WHERE ts IS NULL GROUP BY entity_id, value")
def history_intervals(spark, d):
    h = _history(spark, d)
    return h.select("entity_id", "value", F.unix_micros(F.col("valid_from").cast("timestamp")).alias("valid_from"), F.unix_micros(F.col("valid_to").cast("timestamp")).alias("valid_to"), "support", "current")


@query(f"WITH {_HIST_SQL} SELECT entity_id, value FROM h WHERE valid_from <= TIMESTAMP '2024-01-15 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 00:00:00')")
def history_as_of(spark, d):
    return fusion.history_at(_history(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("entity_id", "value")


@query(f"WITH {_HIST_SQL} SELECT entity_id, count(*) AS intervals FROM h GROUP BY 1 HAVING count(*) > 1")
def history_changes(spark, d):
    return fusion.changed_attributes(_history(spark, d)).select("entity_id", "intervals")


@query("SELECT 0::BIGINT AS violations")
def history_check(spark, d):
    return fusion.history_violations(_history(spark, d)).agg(F.count("*").alias("violations"))


# -- validation ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_STAR_SQL} SELECT (SELECT count(*) FROM lineitem) AS rows_in, count(*) AS rows_out, count(DISTINCT _record_id) AS ids FROM s")
def validate_row_conservation(spark, d):
    n = table(spark, d, "lineitem").agg(F.count("*").alias("rows_in"))
    return n.join(star(spark, d).agg(F.count("*").alias("rows_out"), F.count_distinct("_record_id").alias("ids")))  # one row each


@query("SELECT 'x' AS \"column\", count(*) FILTER (o_orderkey % 6 = 0) AS source_nulls, count(*) FILTER (o_orderkey % 6 = 0) AS output_nulls FROM orders UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus IS NULL), count(*) FILTER (o_orderstatus IS NULL) FROM orders")
def root_values_preserved(spark, d):
    o = table(spark, d, "orders").withColumn("x", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")))
    out = joins.lookup(o, numbered(table(spark, d, "customer"), "c_custkey"), "o_custkey", "c_custkey", "customer")
    return validation.null_counts(o, out, {"x": "x", "o_orderstatus": "o_orderstatus"})


# -- discovery ----------------------------------------------------------------------------------------------------------------


def session(spark: SparkSession, d: str, *names: str):
    from weft.plans.session import Session

    s = Session(spark)
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
    for n in names:
        df = table(spark, d, n)
        s.add_frame(n, numbered(df, keys[n]) if n in keys else joins.with_row_numbers(df, ["l_orderkey", "l_linenumber"]))
    return s


@query("""SELECT * FROM (VALUES ('nation', 'region', 'LOOKUP', 'n_regionkey=r_regionkey'), ('customer', 'nation', 'LOOKUP', 'c_nationkey=n_nationkey'), ('supplier', 'nation', 'LOOKUP', 's_nationkey=n_nationkey'),
('orders', 'customer', 'LOOKUP', 'o_custkey=c_custkey')) AS t(left_dataset, right_dataset, kind, keys)""")
def discover_relationships(spark, d):
    """Relationships among the star's tables from values and names alone: those that the tables' design has."""
    s = session(spark, d, "region", "nation", "customer", "supplier", "orders")
    rows = [(r.left, r.right, r.kind, ", ".join(f"{a}={b}" for a, b in r.keys)) for r in s.discover()]
    return spark.createDataFrame(rows, "left_dataset string, right_dataset string, kind string, keys string")


_PROFILED = {"customer": (("c_custkey", "integer", "ID"), ("c_name", "string", "NAME"), ("c_mktsegment", "string", "CATEGORY"), ("c_nationkey", "integer", "NUMERIC"), ("c_acctbal", "float", "NUMERIC")),
             "orders": (("o_orderkey", "integer", "ID"), ("o_custkey", "integer", "NUMERIC"), ("o_orderstatus", "string", "CATEGORY"), ("o_totalprice", "float", "NUMERIC"),
                        ("o_orderdate", "datetime", "DATETIME"), ("o_orderpriority", "string", "CATEGORY"))}


@query(" UNION ALL ".join(f"""SELECT '{t}' AS dataset, '{c}' AS "column", '{logical}' AS logical, '{kind}' AS semantic, n AS distinct_values,
CASE WHEN n <= 1 THEN 'constant' WHEN n / m >= 0.98 THEN 'unique' WHEN n / m >= 0.5 THEN 'high' WHEN n <= 60 OR n / m < 0.05 THEN 'low' ELSE 'medium' END AS cardinality FROM (SELECT count(DISTINCT {c}) AS n, count({c})::DOUBLE AS m FROM {t})"""
                          for t, cols in _PROFILED.items() for c, logical, kind in cols))
def column_profiles(spark, d):
    rows = [(c.dataset, c.name, c.logical, c.semantic, c.distinct, c.cardinality) for n in _PROFILED for c in profile.profile(table(spark, d, n), n).columns.values()]
    return spark.createDataFrame(rows, "dataset string, column string, logical string, semantic string, distinct_values long, cardinality string")


@query("""SELECT 'orders:' || o_orderkey AS _record_id, o_orderkey, c_name AS customer, n_name AS nation, r_name AS region, c_custkey AS _src_customer_row, c_custkey IS NOT NULL AS _match_customer, r_regionkey IS NOT NULL AS _match_region
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def planned_merge(spark, d):
    """Discovery, plan and execution end to end: the unified table of orders, customers, nations and regions."""
    from weft.plans.planner import execute

    s = session(spark, d, "region", "nation", "customer", "orders")
    plan = s.make_plan()
    out = execute(plan, s.frames, s.profiles)
    return out.select("_record_id", "o_orderkey", F.col("customer_c_name").alias("customer"), F.col("customer_nation_n_name").alias("nation"), F.col("customer_nation_region_r_name").alias("region"),
                      "_src_customer_row", "_match_customer", "_match_region")
