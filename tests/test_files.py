"""Folder listings and billing files."""

from lumenlake.operators.spending import cost_report, storage_usage
from lumenlake.sources.files import read_billing, read_listing


def test_usage_of_a_folder(spark, tmp_path):
    for name, size in (("originals/a", 10), ("originals/deep/er/b", 5), ("thumbnails/a.jpg", 3), ("empty/x", 0)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    listing = read_listing(spark, str(tmp_path))
    assert {(r["path"], r["length"]) for r in listing.collect()} == {("originals/a", 10), ("originals/deep/er/b", 5), ("thumbnails/a.jpg", 3)}
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString()
    assert {(r["part"], r["bytes"]) for r in storage_usage(listing).collect()} == {("originals", 15), ("thumbnails", 3)}


def test_billing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('service,cost,currency\nStorage,0.12345,EUR\n,1.5,\n"App, web",2,USD\nStorage,abc,USD\nStorage,NaN,USD\n')
    (tmp_path / "b.csv").write_text("service,cost,currency\nStorage,0.2,EUR\nx,1,USD,more\n")
    good, bad = read_billing(spark, str(tmp_path))
    assert sorted(tuple(r) for r in good.collect()) == [("App, web", 2.0, "USD"), ("Other", 1.5, "USD"), ("Storage", 0.1235, "EUR"), ("Storage", 0.2, "EUR")]
    assert sorted(r["reason"] for r in bad.collect()) == ["broken", "cost", "cost"]
    assert {(r["service"], r["cost"]) for r in cost_report(good).collect()} == {("App, web", 2.0), ("Other", 1.5), ("Storage", 0.3235), (None, 3.82)}
