"""Offline defaults and failures of providers."""

import pandas as pd
from pyspark.sql import functions as F

from shelfmark.operators import providers, state
from shelfmark.streaming.ingest import ingest, windowed_counts


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def test_embedding(spark):
    df = spark.createDataFrame([("nitrile gloves",), ("nitrile glove",), ("arm trainer",), (None,)], "v string")
    a, b, c, none = [r.e for r in df.select(providers.embed(F.col("v")).alias("e")).collect()]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert none is None and abs(dot(a, a) - 1) < 1e-5 and dot(a, b) > dot(a, c)

    def broken(texts):
        raise ValueError("down")

    assert [r.e for r in df.select(providers.embed(F.col("v"), broken).alias("e")).collect()] == [None] * 4


def test_packs_by_provider(spark):
    df = spark.createDataFrame([("10 cases",), ("10 cases",), ("Slate-Blue",), ("100/Box",)], "x string")

    def ten(pdf):
        return pdf.assign(pack_size=10, pack_unit="each", units_per_pack=1, unit_of_measure="case")

    got = sorted((r.x, r.pack.pack_size, r.pack.parse_method) for r in providers.parse_packs(df, "x", ten).filter("pack.pack_size IS NOT NULL").collect())
    assert got == [("10 cases", 10, "llm"), ("10 cases", 10, "llm"), ("100/Box", 100, "regex")]


def test_replies(spark):
    text = '```json\n[{"description": "arm", "action": "confirm", "confirmed_name": "Arm X"}]\n```'
    got = one(spark, text, providers.parse_reply)
    assert (got[0].description, got[0].action, got[0].confirmed_name, got[0].updated_reason) == ("arm", "confirm", "Arm X", None)
    assert one(spark, '{"decision": "match"}', providers.decided) == "match" and one(spark, "broken", providers.decided) == "no_match"


def test_requested_items(spark):
    got = one(spark, "Hello,\n- 12 boxes of nitrile gloves, medium\n* 2 arm trainers\n- simulator\nbye", providers.requested_items)
    assert [(x.description, x.quantity, x.unit, x.size) for x in got] == [("nitrile gloves, medium", 12, "boxes", "medium"), ("arm trainers", 2, None, None), ("simulator", None, None, None)]


def test_queue(spark):
    urls = spark.createDataFrame([("a",), ("a",), ("b",)], "url string")
    queue = state.enqueue(spark.createDataFrame([(1, "b", "fetching", 1)], "run_id int, url string, status string, attempts int"), urls, F.lit(1))
    assert [(r.url, r.status) for r in queue.collect()] == [("a", "pending")]
    done = spark.createDataFrame([("a", "done", "2000-01-01")], "url string, status string, at string")
    r = state.mark(queue, done).first()
    assert (r.status, r.attempts, r.finished_at) == ("done", 1, "2000-01-01")
    df = spark.createDataFrame([("running", "finish"), ("running", "signal"), ("interrupted", "resume"), ("failed", "resume")], "s string, e string")
    assert [r[0] for r in df.select(state.next_status(F.col("s"), F.col("e"))).collect()] == ["completed", "interrupted", "running", "failed"]


def test_ingest_of_two_files(spark, tmp_path):
    source = str(tmp_path / "in")
    for rows in ([("s", 1, "h1", "2000-01-01"), ("s", 2, "h2", "2000-01-01")], [("s", 1, "x", "2000-01-02"), ("s", 3, "h3", "2000-01-02")]):
        df = spark.createDataFrame(rows, "source string, url int, content_hash string, seen string").select("source", "url", "content_hash", F.col("seen").cast("timestamp").alias("seen_at"))
        df.coalesce(1).write.mode("append").parquet(source)
    q = ingest(spark, source, spark.read.parquet(source).schema, str(tmp_path / "state"), str(tmp_path / "check"), ["source", "url"])
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "state" / f"v{q.lastProgress['batchId']}"))
    assert sorted(r.url for r in got.collect()) == [1, 2, 3]


def test_windows(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = str(tmp_path / "events")
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(source)
    counts = windowed_counts(spark.readStream.schema(schema).parquet(source), "ts", "event_type", "1 day")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(source).count()
    assert isinstance(spark.table("windows").limit(1).toPandas(), pd.DataFrame)
