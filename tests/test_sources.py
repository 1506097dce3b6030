import json
import tempfile

import pytest
from pyspark.sql import functions as F

from brightloom.sources import artifacts, documents, records


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write(path, text):
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_documents(spark, folder):
    write(f"{folder}/a.txt", " plain text \n")
    write(f"{folder}/sub/b.md", "pre\n# H1\nbody\n# H2\n\n")
    write(f"{folder}/empty.txt", "  \n")
    write(f"{folder}/c.csv", "no")
    rows = documents.load_documents(spark, folder).orderBy("path", "section_no").collect()
    assert [(r["source"], r["section"], r["text"]) for r in rows] == [("a.txt", None, "plain text"), ("b.md", None, "pre"), ("b.md", "H1", "body")]
    with pytest.raises(Exception):
        documents.load_documents(spark, f"{folder}/missing").collect()


def test_corpus(spark, folder):
    path = write(f"{folder}/c.json", json.dumps({"documents": [{"id": "d1", "title": "T", "url": "u", "body": "B"}]}, indent=1))
    assert documents.load_corpus(spark, path).first().asDict() == {"id": "d1", "title": "T", "url": "u", "body": "B"}


def test_examples_round_trip(spark, folder):
    row = {"id": "1", "category": "c", "instruction": 'say "hi",\nthen go', "response": "r", "meta": {"k": "v"}}
    path = write(f"{folder}/x.jsonl", json.dumps(row) + "\n\n" + json.dumps({**row, "id": ""}) + "\n{broken\n")
    good, bad = records.load_examples(spark, path)
    assert [r["id"] for r in good.collect()] == ["1"] and good.first()["meta"] == {"k": "v"}
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["invalid JSON", "missing required field(s) id"]
    with pytest.raises(records.BadRecords):
        records.require_clean(bad)
    for name in ("out.jsonl", "out.csv"):
        records.save_examples(good, f"{folder}/{name}")
        back, rejected = records.load_examples(spark, f"{folder}/{name}")
        assert rejected.count() == 0 and back.first()["instruction"] == row["instruction"]
    with pytest.raises(ValueError):
        records.load_examples(spark, f"{folder}/x.xml")


def test_predictions(spark, folder):
    full = {k: "v" for k in records.PREDICTION_FIELDS}
    part = {k: v for k, v in full.items() if k != "reference"}
    path = write(f"{folder}/p.jsonl", json.dumps(full) + "\n" + json.dumps(part) + "\n")
    good, bad = records.load_predictions(spark, path)
    assert good.count() == 1 and "reference" in bad.first()["reason"]
    with pytest.raises(records.BadRecords):
        records.load_predictions(spark, write(f"{folder}/e.jsonl", "\n"))


def test_cases(spark, folder):
    df = spark.createDataFrame([("1", "q", ["a"], "x", None)], records.CASE_SCHEMA)
    records.save_cases(df, f"{folder}/cases")
    assert "reference_trajectory" not in spark.read.text(f"{folder}/cases").first()["value"]
    assert records.load_cases(spark, f"{folder}/cases").collect() == df.collect()


def test_series(spark, folder):
    days = [f"2024-01-{d:02d}" for d in range(1, 32)] + [f"2024-02-{d:02d}" for d in range(1, 30)]
    write(f"{folder}/good.csv", " Date ,VALUE\n" + "".join(f"{d},1.5\n" for d in days))
    write(f"{folder}/dup.csv", " Date ,VALUE\n" + "".join(f"{d},1\n" for d in days) + "2024-01-01,2\n")
    write(f"{folder}/short.csv", " Date ,VALUE\n2024-01-01,1\n2024-01-03,2\n")
    good, bad = records.load_series(spark, folder)
    assert good.select("series_id").distinct().collect()[0][0] == "good" and good.count() == 60
    assert {r["series_id"]: r["reason"] for r in bad.collect()} == {"dup": "duplicate dates", "short": "fewer than 60 daily observations"}
    with pytest.raises(ValueError, match="missing"):
        records.load_series(spark, write(f"{folder}/x/bad.csv", "day,value\n1,2\n"))


def test_index(spark, folder):
    artifacts.save_index(spark.createDataFrame([(1, [0.0, 1.0])], "id int, vector array<double>"), f"{folder}/ix")
    assert artifacts.load_index(spark, f"{folder}/ix", 2).count() == 1
    with pytest.raises(ValueError, match="dimension 2"):
        artifacts.load_index(spark, f"{folder}/ix", 3)


def test_audit_and_reports(spark, folder):
    event = spark.range(1).select(
        F.current_timestamp().alias("timestamp"), F.lit("promote").alias("event"), F.lit("m").alias("model"),
        F.lit(1).cast("long").alias("version"), F.create_map(F.lit("auc"), F.lit(0.8)).alias("metrics"), F.lit("first").alias("reason"),
    )
    for _ in range(2):
        artifacts.append_audit(event, f"{folder}/audit")
    log = artifacts.read_audit(spark, f"{folder}/audit")
    assert log.count() == 2 and log.first()["metrics"] == {"auc": 0.8} and log.first()["run_id"] is None
    artifacts.write_report(spark.range(3), f"{folder}/r", "csv")
    assert spark.read.csv(f"{folder}/r", header=True).count() == 3
