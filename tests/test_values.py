import datetime

from pyspark.sql import functions as F

from weft import config
from weft.functions import values as V
from weft.functions.similarity import jaro_winkler, name_level, string_level, token_set_ratio


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalisers(spark):
    assert column(spark, ["  Ärzte   Straße ", "12.0", "-3.00", "", None, "NaN", "A\tB"], V.basic) == ["arzte straße", "12", "-3", None, None, "nan", "a b"]
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (2.0,)], "v double").select(V.basic(F.col("v"))).collect()] == [None, "2"]  # no number, and a name
    assert column(spark, ["CUST-00123", "123", "c 0", "ab12cd", "x_9", None], V.identifier) == ["123", "123", "0", "ab12cd", "9", None]
    assert column(spark, ["+91-98765-43210", "12345", "9876543210"], V.digits) == ["9876543210", None, "9876543210"]
    assert column(spark, ["Bangalore", "Bombay", "Delhi"], V.domain("indian_cities")) == ["bengaluru", "mumbai", "delhi"]
    assert column(spark, ["New York County", "Queens County"], V.domain("nyc_boroughs")) == ["manhattan", "queens"]
    assert column(spark, ["NYC", "Poona"], V.normalizer("semantic:CITY")) == ["new york", "pune"]
    assert column(spark, ["Doe, Jane", "Dr. Jane Doe", "jane-doe"], V.person_name) == ["jane doe"] * 3


def test_registry(spark):
    V.register_normalizer("shout", lambda c: F.upper(c))
    assert column(spark, ["a"], V.normalizer("shout")) == ["A"]
    assert column(spark, ["CA", "ca", "TX"], V.mapped({"ca": "california"})) == ["california", "california", "tx"]


def test_dates(spark):
    day = datetime.date
    got = column(spark, ["2024-01-05", "05/02/2024", "23/03/2024", "5 Jan 2024", "Jan 5, 2024", "20240105", "2024-01-05T10:11:12Z", "31/31/2024", None], lambda c: V.parse_date(c, True))
    assert got == [day(2024, 1, 5), day(2024, 2, 5), day(2024, 3, 23), day(2024, 1, 5), day(2024, 1, 5), day(2024, 1, 5), day(2024, 1, 5), None, None]
    assert column(spark, ["05/02/2024"], V.parse_date) == [day(2024, 5, 2)]
    df = spark.createDataFrame([("05/02/2024",), ("23/03/2024",)], "v string")
    assert df.agg(V.is_dayfirst(F.col("v"))).first()[0] and not df.limit(1).agg(V.is_dayfirst(F.col("v"))).first()[0]


def test_every_layout_is_read_where_its_shape_says_so(spark):
    moment = datetime.datetime(2024, 3, 5, 7, 8, 9)
    every = sorted({*V.layouts(True), *V.layouts(False)})
    df = spark.createDataFrame([(moment,)], "m timestamp_ntz").select(*[F.date_format("m", p).alias(f"c{i}") for i, p in enumerate(every)])
    direct = df.select(*[F.coalesce(*[F.try_to_timestamp(F.col(f"c{i}"), F.lit(p)) for p in V.layouts(True)]).cast("timestamp_ntz").alias(f"c{i}") for i in range(len(every))]).first()
    routed = df.select(*[V.parse_timestamp(F.col(f"c{i}"), True).alias(f"c{i}") for i in range(len(every))]).first()
    assert direct == routed and all(x is not None for x in routed)


def test_currency(spark):
    df = spark.createDataFrame([("₹1,200.50",), ("USD 45.00",), ("45.00 EUR",), ("Rs. 5",), ("7",), ("free",)], "v string")
    got = df.select(V.currency_amount(F.col("v")), V.currency_code(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(1200.5, "INR"), (45.0, "USD"), (45.0, "EUR"), (5.0, "INR"), (7.0, None), (None, None)]
    assert spark.range(1).select(V.to_base(F.lit(100.0), F.lit("INR")), V.to_base(F.lit(1.0), F.lit("XXX"))).first()[:] == (1.17, None)


def test_shapes(spark):
    assert column(spark, ["AB-1234", "abc Def", "2024-01-05", "", "Customer#000001"], V.value_shape) == ["A-9", "a Aa", "9-9-9", "", "Aa#9"]


def test_similarity():
    assert abs(jaro_winkler("martha", "marhta") - 0.9611) < 1e-3 and jaro_winkler("abc", "xyz") == 0 and jaro_winkler("a", "a") == 1
    assert token_set_ratio("new york city", "new york") == 1.0
    assert [name_level(a, b) for a, b in (("jane doe", "jane doe"), ("jane doe", "doe jane"), ("j doe", "jane doe"), ("jane doe", "mark roe"), (None, "x"))] == ["exact", "high", "high", "different", "null"]
    assert string_level("acme", "acme") == "exact" and string_level("acme corporation", "acme corporatio") == "high" and string_level("acme", "zeta") == "different"


def test_settings_merge_deeply():
    s = config.settings(matching={"weights": {"name": 0.5}})
    assert s["matching"]["weights"]["name"] == 0.5 and s["matching"]["weights"]["pattern"] == 0.10 and config.DEFAULTS["matching"]["weights"]["name"] == 0.20
