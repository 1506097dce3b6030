import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from brightloom.operators import drift as dr
from brightloom.sources.tables import table
from brightloom.streaming import drift as sd, telemetry as st

EDGES = (5.0, 25.0, 100.0)


@pytest.fixture(scope="module")
def stream_folder(spark, small):
    """Events in four files by time, plus a late sentinel that closes the last window."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events = table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").write.mode("overwrite").parquet(folder)
    last = events.agg(F.max("ts")).first()[0]
    sentinel = events.limit(1).withColumn("ts", F.lit(last + dt.timedelta(days=40))).withColumn("event_type", F.lit("sentinel"))
    sentinel.coalesce(1).write.mode("append").parquet(folder)
    return folder, events


def run(stream, spark, name, **options):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return spark.table(name)


def test_histogram_stream_equals_batch(spark, stream_folder):
    folder, events = stream_folder
    stream = spark.readStream.schema(events.schema).parquet(folder)
    got = run(st.windowed_histogram(stream, "ts", "event_type", "value", EDGES, "1 day", "40 days"), spark, "hist")
    want = st.windowed_histogram(events, "ts", "event_type", "value", EDGES, "1 day")
    assert got.count() > 0
    closed = got.agg(F.max("window_start")).first()[0]
    want = want.where(F.col("window_start") <= closed)
    assert got.where("event_type <> 'sentinel'").exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_rates(spark, stream_folder):
    _, events = stream_folder
    rates = st.request_rate(events, "ts", "event_type", width="1 day")
    assert rates.agg(F.sum("requests")).first()[0] == events.count()


def test_late_rows_are_dropped(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    t = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, k string, v double"
    day = lambda n, k="a": [(t + dt.timedelta(days=n), k, 1.0)]
    # The late filter uses the watermark of the batch before, hence the extra day in between.
    for rows in (day(0), day(2), day(3), day(0, "late"), day(6)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = run(st.windowed_histogram(stream, "ts", "k", "v", EDGES, "1 hour", "10 minutes"), spark, "late").collect()
    assert all(r["k"] != "late" for r in rows) and len(rows) == 3


def test_drift_stream_equals_batch_and_is_idempotent(spark, stream_folder):
    folder, events = stream_folder
    cut = dt.datetime(2024, 1, 11)
    profile = sd.frozen_profile(events.where(F.col("ts") < cut), ["value"])
    stream = spark.readStream.schema(events.schema).parquet(folder).where(F.col("ts") >= F.lit(cut))
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/verdicts"
    write = sd.write_verdicts(profile, out)
    bins = sd.windowed_bins(stream, "ts", ["value"], profile, "1 day", "40 days")
    twice = lambda batch, i: (write(batch, i), write(batch, i))
    q = bins.writeStream.outputMode("append").foreachBatch(twice).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {str(r["window_start"])[:10]: r["psi"] for r in spark.read.parquet(out).collect()}
    ref = dr.feature_counts(events.where(F.col("ts") < cut), ["value"], "double")
    day = events.where(F.col("ts") >= cut).withColumn("w", F.to_date("ts").cast("string"))
    want = {r["window"]: r["psi"] for r in dr.psi_numeric(ref, dr.feature_counts(day, ["value"], "double", "w")).collect()}
    assert got and all(want[w] == pytest.approx(p) for w, p in got.items() if w in want)
    assert len(set(want) & set(got)) >= len(want) - 1
