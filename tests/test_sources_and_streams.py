import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import cache, ratelimit
from millrace.operators.quality import Expectation
from millrace.plans import medallion
from millrace.sources import files, gateway, sinks
from millrace.streaming import pipelines

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


# --- sources and sinks


def test_gateway(spark):
    spark.range(250).createOrReplaceTempView("numbers")
    assert gateway.run(spark, "SELECT * FROM numbers", 100).total_rows == 250
    assert gateway.run(spark, "select * from numbers where id < :n", 100, parameters={"n": 3}).total_rows == 3
    assert gateway.query(spark, "WITH q AS (SELECT 1 AS a) SELECT * FROM q").count() == 1
    for bad in ("DROP TABLE t", "", "  ", "INSERT INTO t VALUES (1)"):
        with pytest.raises(gateway.Refused):
            gateway.query(spark, bad)
    assert "Physical Plan" in gateway.explain(spark, "SELECT 1")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one  \ntwo\t\n\nfour")
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    (tmp_path / "a.json").write_text('{"x": 1}\n{"x": 2}\n')
    assert [r.value for r in files.read_file(spark, str(tmp_path / "a.txt"), "text", 2).collect()] == ["one", "two"]
    assert files.read_file(spark, str(tmp_path / "a.csv"), "csv").dtypes == [("x", "string"), ("y", "string")]
    assert files.read_file(spark, str(tmp_path / "a.json"), "json", 1).count() == 1
    with pytest.raises(ValueError):
        files.read_file(spark, "x", "xml")


def test_catalog(spark):
    spark.sql("DROP TABLE IF EXISTS wide_demo")
    spark.sql("CREATE TABLE wide_demo (a INT COMMENT 'first', b STRING, c INT, d INT, e INT, f INT) USING parquet")
    try:
        spark.sql("INSERT INTO wide_demo VALUES (1, 'x', 1, 1, 1, 1)")
        assert [(r.col_name, r.comment) for r in files.describe(spark, "wide_demo").collect()][0] == ("a", "first")
        info = files.table_info(spark, "wide_demo")
        assert info["rows"] == 1 and info["properties"]["Provider"].lower() == "parquet" and info["sample"][0]["b"] == "x"
        assert {r.table_name: r.columns for r in files.schema_context(spark, "default").collect()}["wide_demo"] == "a: int, b: string, c: int, d: int, e: int..."
        assert [r.table_name for r in files.search_tables(spark, "IDE_DE").collect()] == ["wide_demo"]
        sinks.append_chunks(spark.createDataFrame([("c1", "text", [1.0])], "id string, content string, embedding array<double>"), "chunk_demo_index")
        assert spark.table("chunk_demo").columns == ["id", "content"]
    finally:
        spark.sql("DROP TABLE IF EXISTS wide_demo")
        spark.sql("DROP TABLE IF EXISTS chunk_demo")


def test_table_rewrites(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    sinks.append(spark.range(5), a)
    sinks.append(spark.range(5, 6), a)
    sinks.delete(spark, a, b, spark.createDataFrame([(1,), (1,), (99,)], "id long"), "id")
    assert sorted(r.id for r in spark.read.parquet(b).collect()) == [0, 2, 3, 4, 5]
    sinks.truncate(spark, a, c)
    assert spark.read.parquet(c).count() == 0 and spark.read.parquet(c).columns == ["id"]
    assert sinks.clustered(spark.range(100), ["id"], 4).rdd.getNumPartitions() <= 4


def test_audit_and_observation(spark, tmp_path):
    df = spark.createDataFrame([("p", None, "u", 1)], "prompt string, response string, user_id string, ts int")
    sinks.audit_log(df, str(tmp_path / "log"), prompt="prompt", response="response", user="user_id", ts="ts")
    line = json.loads("".join(f.read_text() for f in (tmp_path / "log").glob("*.json")))
    assert line["prompt_length"] == 1 and line["response_length"] == 0 and len(line["prompt_hash"]) == 16 and "prompt" not in line
    rows, seen = sinks.with_run_metrics(df, "run", n=F.count(F.lit(1)))
    rows.collect()
    assert seen.get == {"n": 1}


# --- streams equal batches


@pytest.fixture
def folder(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).drop("props")
    path = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.json(path)
    return path


def run(stream, name, tmp_path, mode="append", spark=None):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def rows(df, *names):
    return sorted(tuple(str(r[n]) for n in names) for r in df.collect())


def test_windows_stream_as_in_batch(spark, folder, tmp_path):
    stream = files.json_stream(spark, folder, EVENTS)
    batch = spark.read.schema(EVENTS).json(folder)
    got = run(pipelines.tumbling(stream, "ts", "1 hour", ["event_type"]), "tumbled", tmp_path, "update", spark)
    assert rows(got, "window_start", "event_type", "n") == rows(pipelines.tumbling(batch, "ts", "1 hour", ["event_type"]), "window_start", "event_type", "n")
    got = run(pipelines.sliding(stream, "ts", "2 hours", "1 hour", ["event_type"]), "slid", tmp_path, "update", spark)
    assert rows(got, "window_start", "event_type", "n") == rows(pipelines.sliding(batch, "ts", "2 hours", "1 hour", ["event_type"]), "window_start", "event_type", "n")
    got = run(pipelines.sessions(stream, "ts", "30 minutes", ["user_id"]), "sessions", tmp_path, "complete", spark)
    assert rows(got, "session_start", "user_id", "n") == rows(pipelines.sessions(batch, "ts", "30 minutes", ["user_id"]), "session_start", "user_id", "n")


def test_medallion_stream(spark, folder, tmp_path):
    stream = medallion.bronze(files.json_stream(spark, folder, EVENTS).unionByName(files.json_stream(spark, folder, EVENTS)))
    checks = [Expectation("v", "value", "in_range", "low", {"min": 5})]
    q = pipelines.append_to(medallion.silver(stream, ["event_id"], checks, "ts"), str(tmp_path / "silver"), str(tmp_path / "cp"))
    q.awaitTermination(180)
    silver = spark.read.parquet(str(tmp_path / "silver"))
    want = spark.read.schema(EVENTS).json(folder).filter("value >= 5")
    assert silver.count() == want.count() and {"ingested_at", "source_file"} <= set(silver.columns)
    assert rows(medallion.gold(silver, ["event_type"], "value"), "event_type", "count") == rows(medallion.gold(want, ["event_type"], "value"), "event_type", "count")
    with pytest.raises(ValueError):
        medallion.silver(stream, ["event_id"], checks)


def test_limits_and_cache_stream_as_in_batch(spark, folder, tmp_path):
    stream, batch = files.json_stream(spark, folder, EVENTS), spark.read.schema(EVENTS).json(folder)
    few = ratelimit.Limits(1, 2, 5, 1)
    got = run(pipelines.limits(stream, "user_id", "ts", "event_id", few), "limited", tmp_path, "append", spark)
    assert rows(got, "user_id", "event_id", "stopped_by") == rows(ratelimit.decisions(batch, "user_id", "ts", "event_id", few), "user_id", "event_id", "stopped_by")
    got = run(pipelines.cached(stream, "user_id", "ts", "event_id", 21_600), "cached", tmp_path, "append", spark)
    assert rows(got, "user_id", "event_id", "hit") == rows(cache.replay(batch, ["user_id"], "ts", "event_id", 21_600), "user_id", "event_id", "hit")


def test_map_dedup_and_batches(spark, folder, tmp_path):
    stream = files.json_stream(spark, folder, EVENTS)
    got = run(pipelines.answered(stream, "event_type"), "answered", tmp_path, "append", spark)
    assert got.filter("ai_response IS NULL").count() == 0
    got = run(pipelines.deduplicated(stream.unionByName(stream), ["event_id"], "ts"), "dedup", tmp_path, "append", spark)
    assert got.count() == got.select("event_id").distinct().count() == spark.read.json(folder).count()
    seen = []
    pipelines.upsert_each(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "cp_each")).awaitTermination(120)
    assert sum(seen) == spark.read.json(folder).count()


def test_late_rows_are_dropped(spark, tmp_path):
    path = tmp_path / "late"
    path.mkdir()
    at = lambda m: (datetime(2025, 1, 1) + timedelta(minutes=m)).isoformat()
    put = lambda name, minutes: (path / name).write_text("\n".join(json.dumps({"event_id": m, "ts": at(m), "user_id": 1, "event_type": "a", "value": 1.0}) for m in minutes))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(path))
    for k, minutes in enumerate(([0, 5], [200], [201], [1], [400], [401])):  # the watermark takes hold a batch later
        put(f"{k}.json", minutes)
        time.sleep(1.1)
    got = run(pipelines.tumbling(stream, "ts", "60 minutes", []), "late_rows", tmp_path, "append", spark)
    assert [r.n for r in got.orderBy("window_start").collect()][0] == 2


def test_workers_find_the_package(spark):
    import os
    from pathlib import Path

    from millrace.session import ship

    root = str(Path(__file__).resolve().parents[1])
    assert root in ship(spark).sparkContext.environment["PYTHONPATH"].split(os.pathsep)
