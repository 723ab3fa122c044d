"""File sources and sinks on a temporary folder, and the windows on a stream."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import files
from millrace.streaming.windows import sessions, tumbling


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "k long, v string")
    files.write_jsonl(df, str(tmp_path / "a.jsonl"))
    assert sorted(map(tuple, files.read_any(spark, str(tmp_path / "a.jsonl"), "k long, v string").collect())) == [(1, "é"), (2, None)]
    with pytest.raises(Exception):
        files.write_jsonl(df, str(tmp_path / "a.jsonl"))
    with pytest.raises(ValueError):
        files.read_any(spark, "x.xlsx")


def test_series_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿date,value\n2020-01-01,1.5\n2020-02-01,.\n2020-03-01,NaN\n", encoding="utf-8")
    df = files.read_series_csv(spark, str(tmp_path / "s.csv"))
    assert [r.value for r in df.orderBy("date").select(files.finite_number(F.col("value")).alias("value")).collect()] == [1.5, None, None]
    (tmp_path / "bad.csv").write_text("date,value\n2020-01-01,inf\n")
    with pytest.raises(Exception):
        files.read_series_csv(spark, str(tmp_path / "bad.csv")).select(files.finite_number(F.col("value"))).collect()


def test_split_discovery_and_fingerprints(spark, tmp_path):
    for name in ("a_train.jsonl", "a_validation.jsonl"):
        (tmp_path / name).write_text('{"k": 1}\n\n{"k": 2}\n')
    split = files.read_split(spark, str(tmp_path), "k long")
    assert {n: df.count() for n, df in split.items()} == {"train": 2, "validation": 2}
    first = files.tree_fingerprint(spark, str(tmp_path))
    assert first == files.tree_fingerprint(spark, str(tmp_path)) and len(first) == 64
    (tmp_path / "b_train.jsonl").write_text("{}\n")
    with pytest.raises(ValueError):
        files.exactly_one(spark, f"{tmp_path}/*train*.jsonl")
    got = files.with_provenance(spark.read.json(str(tmp_path / "a_train.jsonl"))).first()
    assert got.file_name == "a_train.jsonl"


def test_publish_once(spark, tmp_path):
    df = spark.range(5)
    files.publish(df, str(tmp_path), "out")
    assert spark.read.json(str(tmp_path / "out.manifest")).first().rows == 5
    with pytest.raises(Exception):
        files.publish(df, str(tmp_path), "out")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = tumbling(stream, "1 day").writeStream.format("memory").queryName("millrace_windows").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = {(r.start, r.event_type): r.n for r in spark.table("millrace_windows").collect()}
    finally:
        q.stop()
    assert {(k[0].date(), k[1]): n for k, n in got.items()} == {(r.start.date(), r.event_type): r.n for r in tumbling(events, "1 day").collect()}
    assert sessions(events, "30 minutes").agg(F.sum("n")).first()[0] == events.count()
