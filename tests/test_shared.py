from pyspark.sql import functions as F

from corpusmill import shared


def test_heavy_join_equals_a_left_join(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 700).alias("k"))
    left = left.unionByName(spark.createDataFrame([(9999, None)], "id long, k long"))
    right = left.where("k <> 5 AND k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))
    for most in (1, 100, 10_000):
        got = shared.heavy_join(left, right, ["k"], "size", most).select("id", "k", "size", "least")
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", "left").select("id", "k", "size", "least").collect()))
    assert shared.heavy_join(left.limit(0), right.limit(0), ["k"], "size").count() == 0


def test_written_tables_are_read_back(spark):
    df = spark.range(10).withColumn("x", F.array(F.col("id")))
    again = shared.written(df, "numbers")
    assert again.dtypes == df.dtypes and sorted(again.collect()) == sorted(df.collect())
    assert "Parquet" in again._jdf.queryExecution().toString() or "parquet" in again._jdf.queryExecution().toString()


def test_small_is_checked(spark, monkeypatch):
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 5)
    assert hinted(shared.small(spark.range(5))) and not hinted(shared.small(spark.range(6)))


def test_tables_that_nothing_reads_go(spark):
    import os

    from corpusmill.shared import scratch, written

    def there(table):
        return os.path.exists(table._written_at.removeprefix("file://"))

    with scratch() as keep_outer:
        with scratch() as keep:
            a, b = written(spark.range(3), "a"), written(spark.range(4), "b")
            keep(b, None)
        assert not there(a) and there(b) and b.count() == 4
        c = written(spark.range(5), "c")
        keep_outer(c)
    assert not there(b) and there(c) and there(written(spark.range(1), "d"))


def test_small_is_by_rows_and_bytes(spark, monkeypatch):
    from corpusmill import shared

    df = spark.range(100).selectExpr("id", "repeat('x', 100) AS text", "array(repeat('y', 50)) AS list")
    assert "broadcast" in shared.small(df)._jdf.queryExecution().toString() and shared.small(df.limit(0)).count() == 0
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 15_000)
    assert "broadcast" not in shared.small(df)._jdf.queryExecution().toString()
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 99)
    assert "broadcast" not in shared.small(df)._jdf.queryExecution().toString()
