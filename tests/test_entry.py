import __spark_entry__ as e


def test_entry_and_registry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_lookup(spark, tmp_path, sf_dir):
    from weft.streaming.lookup import stream_lookup

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    orders.limit(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(orders.schema).parquet(str(tmp_path / "in"))
    out = stream_lookup(stream, spark.read.parquet(f"{sf_dir}/customer.parquet"), "o_custkey", "c_custkey", "customer", {"c_name": "customer_name"})
    q = out.writeStream.format("memory").queryName("looked_up").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM looked_up WHERE _match_customer").first()[0] == 50
