"""Inputs that are long in one place: one candidate, one page of elements left open, one text of very many sentences."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenlake.llm import html, secrets, spans


def entropy(word, n=secrets.WINDOW):
    return None if len(word) < n else max(-sum(c / n * math.log2(c / n) for c in Counter(word[k : k + n]).values()) for k in range(len(word) - n + 1))


def test_window_entropy(spark):
    rng = random.Random(1)
    words = ["", "a" * 19, "a" * 20, "a" * 21, secrets.ALPHABET] + ["".join(rng.choices(secrets.ALPHABET[: rng.choice([2, 9, 67])], k=rng.choice([20, 21, 45, 400]))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    for r in df.withColumn("e", secrets.window_entropy(F.col("w"))).collect():
        wanted = entropy(r["w"])
        assert (r["e"] is None) == (wanted is None) and (wanted is None or abs(r["e"] - wanted) < 1e-9), r["w"]


def test_one_long_candidate(spark):
    rng = random.Random(2)
    blob = "".join(rng.choices("ghjkmnpqGHJKMNPQ01234", k=1_000_000))
    dull = "gh" * 100_000
    docs = spark.createDataFrame([(1, f"see {blob} end"), (2, f"see {dull} end")], "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r["spans"] for r in secrets.report(docs).collect()}
    assert found == {1: "entropy:4:1000004", 2: ""}
    assert {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()} == {1: "see [SECRET] end", 2: f"see {dull} end"}
    assert time.time() - began < 90


def test_elements_left_open():
    net = html.Labeller()
    for page, n in (("<b>" * 300_000 + "x", 1), ("<div>x" * 30_000, 30_000), ("<p>" * 200_000 + "x</p>", 1), ("<ul><li>x" * 20_000 + "</ul>" * 20_000, 20_000)):
        began = time.time()
        made = html.blocks(page)
        assert len(made) == n and all(len(s) == n and np.isfinite(s).all() for s in net.scores([made]))
        assert time.time() - began < 30
    assert list(html.blocks("<div class=a><p>x<p class='b c'>y")[1].path) == ["div", ".a", "p", ".b", ".c"]


def test_paths_as_steps_and_as_tuples_score_alike():
    net = html.Labeller(5)
    page = html.blocks("<body><nav><a>x</a></nav><article class='post main'><h2>T</h2><p>one two.<ul><li>three</ul></article><p>z")
    flat = [html.Block(tuple(b.path), b.text, b.linked) for b in page]
    assert np.allclose(net.scores([page])[0], net.scores([flat])[0], atol=1e-6)


def test_pages_of_too_many_marks_teach_nothing():
    page = "<article>" + "<div>word. " * 300
    assert all(np.array_equal(v, html.Labeller().p[k]) for k, v in html.fit([page], marks=1000).p.items())
    assert not all(np.array_equal(v, html.Labeller().p[k]) for k, v in html.fit([page]).p.items())


def test_text_of_formulas_stays():
    page = "<article><p>Let <math><semantics><mi>x</mi><annotation encoding='t'>x squared</annotation></semantics></math> be.</p></article>"
    assert [b.text for b in html.blocks(page)] == ["Let xx squared be."]


def test_places_beyond_32_bits(monkeypatch):
    monkeypatch.setattr(spans, "SPAN", 1 << 28)
    text = " ".join(f"word{k} ends." for k in range(40))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0], pa.int32()), pa.array([text])], ["ident", "row_key", "text"])
    counted, made = spans.marks([batch], spans.RUN, spans.LEAST, spans.WINDOW)
    assert counted.column("place").to_pylist() == [40] and counted.column("h1").null_count == 1
    places = made.column("place").to_numpy()
    assert (places > 0).all() and places.max() > 2**32 and (np.diff(places >> 28) == 1).all()
