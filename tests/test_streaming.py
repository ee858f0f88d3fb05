"""Streams over several micro-batches give what one batch gives."""
from pyspark.sql import functions as F

from tickloom.streaming import jobs as X


def slices(spark, tiny, tmp_path):
    """The events in four files, in time order, with file times in the same order."""
    import os
    d = spark.read.parquet(f"{tiny}/events.parquet").select("event_id", "ts", F.col("event_type").alias("exchange"), "value",
                                                            F.lit("s").alias("symbol"), F.lit(1.0).alias("quantity"),
                                                            F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"))
    pdf = d.orderBy("ts").toPandas()
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        part = pdf.iloc[i * 250:(i + 1) * 250]
        out = folder / f"part-{i}.parquet"
        part.assign(ts=part.ts.astype("datetime64[us]")).to_parquet(out)
        os.utime(out, (1_700_000_000 + i, 1_700_000_000 + i))
    return d, str(folder)


def test_dedupe_and_replay(spark, tiny, tmp_path):
    _, folder = slices(spark, tiny, tmp_path)
    batch = spark.read.parquet(folder).select("event_id", "value")
    write = X.idempotent_writer(str(tmp_path / "sink"), ["event_id"])
    write(batch.unionByName(batch), 0)
    write(batch.unionByName(batch), 0)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 1000


def test_silent_venues_are_reported(spark, tmp_path):
    rows = [("a", 10), ("a", 20), ("b", 30), ("a", 70), ("b", 190), ("a", 400)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "exchange string, s long").select("exchange", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(folder)
    s = X.stream_source(spark, folder, spark.read.parquet(folder).schema)
    out = str(tmp_path / "out")
    X.run_once(X.stream_health(s.withWatermark("ts", "30 seconds"), "1 minute", least=2, expected=["a", "b", "c"]), out)
    got = {(r["exchange"], int(r["bucket"].timestamp()) // 60): (r["rows"], r["low_rate"], r["silent"]) for r in spark.read.parquet(out).collect()}
    assert got[("a", 0)] == (2, False, False) and got[("b", 0)] == (1, True, False) and got[("c", 0)] == (0, True, True)
    assert got[("b", 1)] == (0, True, True) and got[("a", 3)] == (0, True, True) and ("a", 2) not in got
