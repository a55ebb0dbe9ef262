"""People, albums, search and corrections on small tables."""

import numpy as np
from pyspark.sql import functions as F

from lumenlake.operators import albums as A
from lumenlake.operators.edits import normalise_fixes
from lumenlake.operators.groups import meme_groups
from lumenlake.operators.subjects import assign_people, carry_over_people

FACE = "id string, photo_id string, person_id string, embedding array<double>"
PERSON = "id string, name string, created_at string, manual boolean"


def turn(*degrees):
    return [float(np.cos(np.radians(degrees[0]))), float(np.sin(np.radians(degrees[0])))]


def people_of(spark, new, known, people, t=0.95):
    faces = [spark.createDataFrame([(i, p, w, turn(d)) for i, p, w, d in rows], FACE) for rows in (new, known)]
    return {r["id"]: r["person_id"] for r in assign_people(*faces, spark.createDataFrame(people, PERSON), t).collect()}


def test_faces_become_people(spark):
    got = people_of(spark, [("n1", "p1", None, 0), ("n2", "p2", None, 10), ("n3", "p3", None, 90)], [], [])
    assert got == {"n1": "new-n1", "n2": "new-n1", "n3": "new-n3"}


def test_named_person_takes_the_other_in(spark):
    known = [("k1", "q1", "a", 0), ("k2", "q2", "b", 30)]
    got = people_of(spark, [("n1", "p1", None, 13)], known, [("a", None, "1", False), ("b", "Asha", "2", None)])
    assert got == {"n1": "b", "k1": "b"}


def test_handmade_person_is_left_alone(spark):
    known = [("k1", "q1", "a", 0), ("k2", "q2", "b", 30)]
    got = people_of(spark, [("n1", "p1", None, 13)], known, [("a", None, "1", True), ("b", "Asha", "2", None)])
    assert got == {"n1": "a"}


def test_faces_of_one_photo_are_never_compared(spark):
    assert people_of(spark, [("n1", "p1", None, 0), ("n2", "p1", None, 1)], [], []) == {"n1": "new-n1", "n2": "new-n2"}


def test_carry_over(spark):
    old = spark.createDataFrame([("o1", "p1", "a", turn(0)), ("o2", "p1", None, turn(90)), ("o3", "p2", "b", turn(0))], FACE)
    new = spark.createDataFrame([("n1", "p1", None, turn(5)), ("n2", "p1", None, turn(88)), ("n3", "p2", None, turn(60))], FACE)
    assert [tuple(r) for r in carry_over_people(new, old).collect()] == [("n1", "a")]


def photos(spark, rows):
    columns = "id string, filename string, content_type string, width int, height int, uploaded_at string, taken_at string, flatness double, ocr_text string, ocr_words array<struct<text:string,box:array<double>,line:int>>, jpeg_quality int, camera boolean, clip array<double>"
    base = dict(filename="a.jpg", content_type="image/jpeg", width=3000, height=2000, uploaded_at="1", taken_at=None, flatness=0.0, ocr_text=None, ocr_words=None, jpeg_quality=95, camera=True, clip=[0.0, 0.0, 1.0])
    names = [c.split()[0] for c in columns.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], columns)


def test_albums_by_rule(spark):
    top, low = ("A", [0.1, 0.05, 0.5, 0.1], 0), ("B", [0.1, 0.9, 0.5, 0.08], 1)
    rows = [
        dict(id="shot", filename="Screenshot_1.png", content_type="image/png", ocr_text="w " * 30),
        dict(id="doc", ocr_text="TOTAL 14.21  CASH 20.00"),
        dict(id="meme", ocr_words=[top, low]),
        dict(id="fwd", filename="IMG-20251024-WA0007.jpg"),
        dict(id="small", camera=False, jpeg_quality=60, width=1000, height=900),
        dict(id="unknown", camera=None, jpeg_quality=60, width=1000, height=900),
        dict(id="pet", clip=[1.0, 0.0, 0.0]),
        dict(id="wild", clip=[0.0, 1.0, 0.0]),
        dict(id="novector", filename="Screenshot_2.png", clip=None),
    ]
    faces = spark.createDataFrame([("f1", "pet"), ("f2", "pet"), ("f3", "novector")], "id string, photo_id string")
    none = np.zeros(3)
    got = A.auto_albums(photos(spark, rows), faces, {"pets": np.array([0.9, 0.5, 0]), "animals": np.array([0.5, 0.9, 0])}, none, none, none).collect()
    assert {(r["album"], r["id"]) for r in got} == {("screenshots", "shot"), ("documents", "doc"), ("memes", "meme"), ("forwarded", "fwd"), ("forwarded", "small"), ("pets", "pet"), ("animals", "wild"), ("people", "pet"), ("people", "novector")}


def test_search_finds_nothing_that_is_not_there(spark):
    rows = [("a", [0.2, 0.1], "MENU: pizza"), ("b", [0.9, 0.0], None), ("c", None, "pizza")]
    df = spark.createDataFrame(rows, "id string, clip array<double>, ocr_text string")
    generic = np.array([0.5, 0.5])
    got = A.smart_search(df, [("x", "menu with pizza", np.array([0.6, 0.5])), ("none", "tractor", np.array([0.4, 0.4]))], generic).collect()
    assert {(r["query"], r["id"]) for r in got} == {("x", "a"), ("x", "b")}
    assert abs(next(r["score"] for r in got if r["id"] == "a") - (0.02 + 0.05)) < 1e-9


def test_album_names(spark):
    shot = spark.createDataFrame([("1", "WELCOME TO GOA 1", "2025-05-01T10:00:00"), ("2", "WELCOME TO GOA 2", "2025-05-03T10:00:00"), ("3", None, None)], "id string, ocr_text string, taken_at string")
    chosen = spark.createDataFrame([("x", "1"), ("x", "2"), ("x", "2"), ("x", "3"), ("x", "gone")], "album_id string, photo_id string")
    auto = spark.createDataFrame([("beach", "1"), ("beach", "2"), ("people", "3")], "album string, id string")
    got = A.suggest_album_names(chosen, shot, auto, {"beach": "Beach"}).first()["names"]
    assert got == ["Goa", "Beach", "May 2025"]


def test_words_of_a_photo_are_found_once(spark, monkeypatch):
    """However many selections hold it; and a selection that is counted in parts has the same names."""
    rows = [(f"{k:02}", f"Harbour {'LIGHT' if k % 2 else 'light'} number {'abcdefghij'[k % 10] * 3}", "2025-05-01T10:00:00") for k in range(40)]
    shot = spark.createDataFrame(rows, "id string, ocr_text string, taken_at string")
    chosen = spark.createDataFrame([(f"a{a}", f"{k:02}") for a in range(5) for k in range(a, 40, a + 1)], "album_id string, photo_id string")
    auto = spark.createDataFrame([], "album string, id string")
    made = A.suggest_album_names(chosen, shot, auto)
    assert "ocr_text" not in made._jdf.queryExecution().executedPlan().toString()
    want = {(r["album_id"], *r["names"]) for r in made.collect()}
    monkeypatch.setattr(A, "PHOTOS_A_TASK", 3)
    assert {(r["album_id"], *r["names"]) for r in A.suggest_album_names(chosen, shot, auto).collect()} == want
    assert ("a0", "Harbour", "Light", "May 2025") in want


def test_words_of_selections_are_counted_where_they_are_dealt(spark, monkeypatch):
    """Against plain counting; no row for each word of each photo of a selection, and the same in parts, in many tasks and in small steps."""
    import random

    import pyarrow as pa

    rng, stock = random.Random(5), [w + v for w in ("harbour", "Light", "TOWER", "ferry") for v in ("", "a", "ab", "abc")]
    texts = {f"{k:02}": [rng.choice([str.lower, str.upper, str.title])(rng.choice(stock)) for _ in range(rng.randrange(8))] for k in range(30)}
    chosen = {f"a{a:02}": rng.sample(sorted(texts), rng.choice([1, 2, 3, 5, 30])) for a in range(60)}
    want = {}
    for album, held in chosen.items():
        seen = {}
        for p in sorted(held):
            for w in {w.lower(): w for w in reversed(texts[p])}:
                seen.setdefault(w, []).append((p, min(k for k, x in enumerate(texts[p]) if x.lower() == w)))
        best = sorted((-len(at), at[0], w) for w, at in seen.items() if len(at) >= min(2, len(held)))[:2]
        said = lambda at: [texts[p][k] for p, k in at]
        shown = [next((x for x in said(seen[w]) if x[0].isupper()), said(seen[w])[-1]) for *_, w in best]
        want[album] = [x.title() if x.isupper() else x for x in shown]
    photos = spark.createDataFrame([(p, " ".join(t), None) for p, t in texts.items()], "id string, ocr_text string, taken_at string")
    rows, auto = spark.createDataFrame([(a, p) for a, held in chosen.items() for p in held], "album_id string, photo_id string"), spark.createDataFrame([], "album string, id string")
    made = A.suggest_album_names(rows, photos, auto)
    assert "explode(words" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r["album_id"]: r["names"] for r in made.collect()} == want
    monkeypatch.setattr(A, "WORDS_A_TASK", 20)
    monkeypatch.setattr(A, "PHOTOS_A_TASK", 4)
    assert {r["album_id"]: r["names"] for r in A.suggest_album_names(rows, photos, auto).collect()} == want
    held = pa.table({"photo": [5, 0, 3], "words": pa.array([[2, 7, 8], [6, 3, 9], [8, 2]], pa.list_(pa.int64()))})
    dealt = pa.table({"album_id": ["x", "y", "x", "x", "y"], "whole": [True, False, True, True, False], "o": [5, 3, 0, 3, 0]})
    got = A.count_words(dealt, held).to_pylist()
    monkeypatch.setattr(A, "STEP", 1)
    assert A.count_words(dealt, held).to_pylist() == got
    assert [tuple(r.values()) for r in got if r["album_id"] == "x"] == [("x", 1, 3, 1, 1, 5), ("x", 4, 3, 2, 2, 7)] and [r["k"] for r in got if r["album_id"] == "y"] == [1, 3, 4]


def test_meme_groups(spark):
    df = spark.createDataFrame([("a", "00000000000000ff"), ("b", "00000000000000fe"), ("c", "ffffffff00000000"), ("d", None)], "id string, core_hash string")
    assert {r["id"] for r in meme_groups(df, df.select("id")).collect()} == {"a", "b"}


def test_corrections(spark):
    rows = [
        ("a", 1, {"shop": "  Tea   House ", "total": "10.129"}),
        ("a", 2, {"total": None}),
        ("b", 1, {"total": "5"}),
        ("b", 2, {"receipt": "false"}),
        ("c", 1, {"receipt": "true", "total": "7"}),
        ("c", 2, {"receipt": None}),
        ("d", 1, {"date": "2026-02-30"}),
        ("d", 2, {"currency": "yen"}),
        ("d", 3, {"total": "-1"}),
        ("e", 1, {"total": "3"}),
        ("e", 2, None),
    ]
    edits = spark.createDataFrame(rows, "id string, moment int, sent map<string,string>")
    fixes, rejects = normalise_fixes(edits, spark.createDataFrame([("a", {"date": "2026-01-01"})], "id string, fix map<string,string>"))
    assert {r["id"]: r["fix"] for r in fixes.collect()} == {"a": {"date": "2026-01-01", "shop": "Tea House", "total": None}, "b": {"receipt": "false"}, "c": {"total": "7.0"}}
    assert [r["reason"] for r in rejects.orderBy("moment").collect()] == ["date", "currency", "total"]
    assert fixes.where(F.map_contains_key("fix", F.lit("currency"))).count() == 0
