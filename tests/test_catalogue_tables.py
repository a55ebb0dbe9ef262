"""Catalogue tables with fixed schemas, written and read back."""

import pytest

from lumenlake.sources.catalogue import TABLES, Catalogue, conform, schema


def test_round_trip_and_older_files(spark, tmp_path):
    photos = spark.createDataFrame([("p1", "a.jpg", 5, "x")], "id string, filename string, size int, other string")
    made = {n: spark.createDataFrame([], schema(n)) for n in TABLES} | {"photos": photos}
    Catalogue(made).save(str(tmp_path / "new"))
    back = Catalogue.load(spark, str(tmp_path / "new")).tables
    assert set(back) == set(TABLES) and all(back[n].schema == schema(n) for n in TABLES)
    row = back["photos"].first()
    assert (row["id"], row["size"], row["receipt_fix"], row["clip"]) == ("p1", 5, None, None)
    photos.drop("size", "other").write.parquet(str(tmp_path / "old/photos"))
    old = spark.read.schema(schema("photos")).parquet(str(tmp_path / "old/photos"))
    assert old.first()["size"] is None and old.first()["filename"] == "a.jpg"


def test_values_that_do_not_fit(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        conform(spark.createDataFrame([("p1", "many")], "id string, size string"), "photos").collect()
