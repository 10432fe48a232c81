"""Sources, sinks, streams and the session helpers."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from lectern import session
from lectern.plans import reports
from lectern.sources import files
from lectern.streaming import ingest


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿id,region,note\n1,NA,"a, ""b"""\n2,EU,\n', encoding="utf-8")
    rows = files.read_csv(spark, str(p), ["id", "region", "note", "more"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "NA", 'a, "b"', None), ("2", "EU", "", None)]
    assert files.read_csv(spark, str(tmp_path / "none.csv"), ["id"]).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "none.csv"), ["id"], strict=True)
    files.write_csv(spark.createDataFrame([(1, "x,y", None)], "a int, b string, c string"), str(tmp_path / "out"), ["b", "a", "c", "d"])
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part*"))
    assert text == 'b,a,c,d\n"x,y",1,,\n'


def test_jsonl(spark, tmp_path):
    (tmp_path / "shard_01.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "shard_02.jsonl").write_text('{"a": 3}\nbroken\n')
    one, two = str(tmp_path / "shard_01.jsonl"), str(tmp_path / "shard_02.jsonl")
    assert sorted(r.a for r in files.read_jsonl(spark, one, "a int").collect()) == [1, 2]
    assert files.read_jsonl(spark, two, "a int", bad="drop").collect() == [(3,)]
    kept = files.read_jsonl(spark, two, "a int", bad="keep").cache()
    assert kept.where("_corrupt is not null").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, two, "a int").collect()
    (tmp_path / "shard_02.jsonl").write_text('{"a": 3}\n')
    assert {(r.a, r.shard) for r in files.read_shards(spark, str(tmp_path), "a int").collect()} == {(1, 1), (2, 1), (3, 2)}
    for c in ("base", "hot"):
        (tmp_path / "cond" / c).mkdir(parents=True)
        (tmp_path / "cond" / c / "x.jsonl").write_text('{"a": 7}\n')
    assert {(r.a, r.condition) for r in files.read_conditions(spark, str(tmp_path / "cond"), "a int").collect()} == {(7, "base"), (7, "hot")}
    (tmp_path / "d.json").write_text(json.dumps({"x": {"y": [1, 2]}}, indent=2))
    assert files.read_json(spark, str(tmp_path / "d.json")).first().x.y == [1, 2]


def test_archive(spark, tmp_path):
    for where, name, data in (("NA/us1", "t1.html", '<meta charset="latin-1"><p>caf\xe9'.encode("latin-1")), ("NA/us1", "t2.pdf", b"%PDF"), ("_skip/us1", "t3.html", b"x")):
        (tmp_path / where).mkdir(parents=True, exist_ok=True)
        (tmp_path / where / name).write_bytes(data)
    (tmp_path / "NA/us1/t1.json").write_text('{"url": "https://a.example"}')
    raw = files.read_archive(spark, str(tmp_path))
    assert {(r.region, r.institution_id, r.stem, r.extension) for r in raw.collect()} == {("NA", "us1", "t1", "html"), ("NA", "us1", "t2", "pdf")}
    side = files.read_sidecars(spark, str(tmp_path), "url string")
    joined = files.decode_pages(raw).join(side, "stem", "left").where("extension = 'html'").first()
    assert joined.html.endswith("café") and joined.url == "https://a.example"
    pdf = files.pdf_text(raw.where("extension = 'pdf'").select("stem", "content")).first()
    assert pdf.text == "" and pdf.warning


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, s string")
    files.write_shards(df, str(tmp_path / "s"), F.col("id") % 2)
    assert {(r.id, r.shard) for r in spark.read.json(str(tmp_path / "s")).collect()} == {(1, 1), (2, 0), (3, 1)}
    wide = files.union_columns(df, spark.createDataFrame([(4, True, 1.5)], "id int, z boolean, b double"))
    assert wide.columns == ["id", "s", "b", "z"] and wide.count() == 4
    a, b = files.manifest(df, "id").first(), files.manifest(df.orderBy(F.desc("id")), "id").first()
    assert a == b and a.n_rows == 3 and files.manifest(df.limit(0), "id").first().n_rows == 0
    files.write_lines(spark.createDataFrame([(1, "two"), (0, "one")], "line_no int, line string"), str(tmp_path / "l"))
    assert "".join(f.read_text() for f in (tmp_path / "l").glob("part*")) == "one\ntwo\n"


#: Published aggregate tables, typed anew.
REGIONAL = [("T7", "NA", 60, 49, "LA", 40, 5, "1.05e-7"), ("T8", "EA", 45, 28, "EU", 55, 18, "0.003")]


def test_markdown(spark):
    df = spark.createDataFrame(REGIONAL, "theme string, a string, n_a int, x_a int, b string, n_b int, x_b int, p string")
    shown = df.select("theme", reports.percent("x_a", "n_a").alias("first"), reports.percent("x_b", "n_b").alias("second"), "p")
    lines = [r.line for r in reports.markdown(shown, [F.col("theme")]).orderBy("line_no").collect()]
    assert lines == [
        "| theme | first         | second        | p       |",
        "| ----- | ------------- | ------------- | ------- |",
        "| T7    | 49/60 (81.7%) | 5/40 (12.5%)  | 1.05e-7 |",
        "| T8    | 28/45 (62.2%) | 18/55 (32.7%) | 0.003   |",
    ]


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return q


def test_new_documents_once(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    schema = "sha256 string, ingested_at timestamp"
    for k, rows in enumerate([[("a", t), ("a", t), (None, t)], [("b", t), ("a", t + dt.timedelta(days=1))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(ingest.new_documents(stream), "new_docs")
    assert sorted(r.sha256 for r in spark.table("new_docs").collect()) == ["a", "b"]
    ingest.append_ledger(ingest.new_documents(stream), str(tmp_path / "ledger"), str(tmp_path / "ck")).start().awaitTermination(60)
    ingest.append_ledger(ingest.new_documents(stream), str(tmp_path / "ledger"), str(tmp_path / "ck")).start().awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2


def test_windows(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), "u") for m in (0, 1, 2, 30, 31, 200)]
    spark.createDataFrame(rows, "ts timestamp, user string").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, user string").parquet(str(tmp_path / "e"))
    drain(ingest.tumbling(stream, "ts", "10 minutes", "1 minute", "user"), "tumble", "complete")
    assert sorted(r.n for r in spark.table("tumble").collect()) == [1, 2, 3]
    drain(ingest.sliding(stream, "ts", "10 minutes", "5 minutes", "1 minute"), "slide", "complete")
    assert sum(r.n for r in spark.table("slide").collect()) == 12
    drain(ingest.sessions(stream, "ts", "5 minutes", "1 minute", "user"), "sess", "complete")
    assert sorted(r.n for r in spark.table("sess").collect()) == [1, 2, 3]


def test_pace(spark, tmp_path):
    assert ingest.next_wait(0.0, 429) == (3.0, 3.0) and ingest.next_wait(40.0, 503) == (60.0, 60.0) and ingest.next_wait(40.0, 200) == (0.0, 3.0) and ingest.next_wait(12.0, 404) == (12.0, 12.0)
    t = dt.datetime(2026, 1, 1)
    rows = [("a", t + dt.timedelta(seconds=k), s) for k, s in enumerate([429, 429, 200, 500])]
    spark.createDataFrame(rows, "host string, ts timestamp, status int").coalesce(1).write.parquet(str(tmp_path / "p"))
    drain(ingest.paced(spark.readStream.schema("host string, ts timestamp, status int").parquet(str(tmp_path / "p"))), "pace")
    assert [r.wait_s for r in spark.table("pace").orderBy("ts").collect()] == [3.0, 6.0, 3.0, 3.0]


def test_stage_cuts_lineage(spark):
    df = session.stage(spark.range(5).withColumn("x", F.rand(1)), "t")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().toString()
    assert re.search("lectern", df.inputFiles()[0])


def lines(df, first):
    return [r.line for r in reports.markdown(df, [F.col(first)]).orderBy("line_no").collect()]


def test_published_tables(spark):
    drift = spark.createDataFrame([("T7", "64", "8", "0.125", "64", "31", "0.484", "35.9", "2.14e-5")], "theme string, mid_2023_n string, mid_2023_events string, mid_2023_prevalence string, late_2025_n string, late_2025_events string, late_2025_prevalence string, shift_pp string, p_value string")
    assert lines(reports.temporal_table(drift), "theme")[2] == "| T7    | 12.5% (8/64) | 48.4% (31/64) | +35.9 pp | 2.14e-5 |"
    regional = spark.createDataFrame([("T7", "NA", "60", "49", "0.8167", "LA", "40", "5", "0.125", "1.05e-7")], "theme string, region_a string, n_a string, events_a string, prevalence_a string, region_b string, n_b string, events_b string, prevalence_b string, p_value string")
    assert lines(reports.regional_table(regional), "theme")[2] == "| T7    | NA 49/60 (81.7%) | LA 5/40 (12.5%) | 1.05e-7 |"
    icc = spark.createDataFrame([("country", "0.142", "0.08", "0.22", "<0.001")], "model_component string, value string, ci_low string, ci_high string, p_value string")
    assert lines(reports.icc_table(icc), "component")[2] == "| country   | 0.142 | [0.08, 0.22] | <0.001 |"
    kappa = spark.createDataFrame([("agreement", "0.83", "0.89", "0.85", "0.92")], "metric string, baseline_value string, current_value string, ci_low string, ci_high string")
    assert lines(reports.measurement_table(kappa), "metric")[2] == "| agreement | 0.83     | 0.89    | [0.85, 0.92] |"


def test_column_drift(spark):
    assert files.column_drift(spark.createDataFrame([(1, 2)], "a int, z int"), ["a", "b"]) == (["b"], ["z"])
