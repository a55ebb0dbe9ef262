"""Streams over small files, and analysis results as JSON."""

import base64
import json

import numpy as np
from pyspark.sql import functions as F

from lumenlake.operators.pairs import exact_pairs, similar_pairs
from lumenlake.sources import scratch
from lumenlake.sources.analyses import parse_analyses
from lumenlake.streaming import analyses, jobs

PHOTO = "id string, sha256 string, phash string, dhash string, width int, height int, uploaded_at string"


def photo(k, sha, flips=0):
    return (f"p{k}", sha, f"{(1 << flips) - 1:016x}", "0" * 16, 400, 300, f"2024-01-0{k}")


def drain(writer, checkpoint):
    writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def test_uploads_meet_earlier_batches_and_their_own(spark, tmp_path):
    rows = [photo(1, "a"), photo(2, "b", 3), photo(3, "a"), photo(4, "c", 10), photo(5, "d", 40), photo(6, "b", 3)]
    every = spark.createDataFrame(rows, PHOTO)
    for part in (rows[:1], rows[1:4], rows[4:]):  # three files, one a batch
        spark.createDataFrame(part, PHOTO).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(PHOTO).json(str(tmp_path / "in"))
        drain(jobs.stream_uploads(stream, str(tmp_path / "out")), tmp_path / "checkpoint")
    assert not any("upload" in p for p in scratch._HELD)  # every batch has cleared its own tables
    want = exact_pairs(every).unionByName(similar_pairs(every))
    key = lambda df: sorted(tuple(r) for r in df.select("photo_a", "photo_b", "kind", "similarity").collect())
    found = jobs.stored(spark, str(tmp_path / "out"), "matches")
    assert key(found) == key(want) and found.count() > 6
    assert jobs.stored(spark, str(tmp_path / "out"), "photos").count() == 6
    best = {r["photo_a"]: r["photo_b"] for r in jobs.stored(spark, str(tmp_path / "out"), "best").collect()}
    assert best["p3"] == "p1" and best["p6"] == "p2"


def test_each_content_is_new_once(spark, tmp_path):
    rows = spark.createDataFrame([("1", "x", "2024-01-01 00:00:00"), ("2", "x", "2024-01-01 00:01:00"), ("3", "y", "2024-01-01 00:02:00")], "id string, sha256 string, at string")
    rows.select("id", "sha256", F.to_timestamp("at").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_new_files(spark.readStream.schema("id string, sha256 string, at timestamp").parquet(str(tmp_path / "in")), "at")
    drain(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "checkpoint")
    assert sorted(r["sha256"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]


def packed(*numbers):
    return base64.b64encode(np.array(numbers, dtype="<f4").tobytes()).decode()


def analysis(**changes):
    base = {"version": 6, "clip": packed(0.6, 0.8), "faces": [{"box": [0, 0, 0.5, 0.5], "embedding": packed(1, 0, 0)}], "sharpness": 3.5, "words": [{"text": "HOTEL", "box": [0.1, 0.1, 0.2, 0.1], "line": 0}, {"text": "", "box": [9]}, {"text": "Paradise", "box": [0.4, 0.1, 0.2, 0.1]}], "flatness": 7, "jpeg_quality": 300, "camera": True, "qr_codes": [{"text": "QR-1", "box": [0, 0, 1, 1]}], "core_hash": "0123456789abcdef"}
    return json.dumps(base | changes)


def test_analyses_are_checked(spark, tmp_path):
    rows = [
        ("good", analysis()),
        ("json", "{not"),
        ("null", None),
        ("old", analysis(version=5)),
        ("short", analysis(clip=packed(1))),
        ("nan", analysis(clip=packed(1, float("nan")))),
        ("face", analysis(faces=[{"box": [0, 0, 1, 1], "embedding": packed(1)}])),
        ("box", analysis(words=[{"text": "x", "box": [0, 0, 2, 0]}])),
        ("core", analysis(core_hash="xyz")),
        ("plain", analysis(faces=[], words=[], qr_codes=[], jpeg_quality=None, core_hash="")),
    ]
    df = spark.createDataFrame(rows, "id string, json string")
    good, bad = parse_analyses(df, size=2, face_size=3)
    got = {r["id"]: r for r in good.collect()}
    assert sorted(got) == ["good", "plain"]
    g = got["good"]
    assert (g["ocr_text"], g["ocr_search"], g["flatness"], g["jpeg_quality"]) == ("HOTEL Paradise", "hotelparadiseqr1", 1.0, 100)
    assert got["plain"]["jpeg_quality"] is None and got["plain"]["qr_codes"] is None and got["plain"]["ocr_text"] == ""
    assert {r["id"]: r["reason"] for r in bad.collect()} == {"json": "json", "null": "json", "old": "version", "short": "vector", "nan": "vector", "face": "vector", "box": "box", "core": "core_hash"}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, json string").parquet(str(tmp_path / "in"))
    drain(analyses.stream_analyses(stream, str(tmp_path / "out"), size=2, face_size=3), tmp_path / "checkpoint")
    assert analyses.latest_analyses(spark, str(tmp_path / "out")).count() == 2
    assert jobs.stored(spark, str(tmp_path / "out"), "rejects").count() == 8
