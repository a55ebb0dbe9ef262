"""Repeated passages against brute force over shared 50-word spans, at shifted places."""

import random

from lumenlake.llm import passages
from lumenlake.llm import queries as Q
from tests.llm.test_llm import odd_docs


def brute(docs):
    """doc_id -> words of later places of any 50-word span (no sentence runs), by their order in the text."""
    seen, gone = set(), {}
    for d in sorted(docs):
        words = docs[d].lower().split()
        for i in range(len(words) - 49):
            span = tuple(words[i : i + 50])
            if span in seen:
                gone.setdefault(d, set()).update(range(i, i + 50))
            seen.add(span)
    return gone


def made(spark, texts):
    rows = passages.dedup_passages(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()
    return {r["doc_id"]: r for r in rows}


def test_shifted_passages_without_stops(spark):
    rng = random.Random(5)
    fresh = iter(range(10**6))
    new = lambda n: [f"x{next(fresh)}" for _ in range(n)]
    texts = {}
    for k in range(40):
        shared = new(rng.choice([49, 50, 51, 60, 120]))
        for d in (2 * k, 2 * k + 1):
            texts[d] = " ".join(new(rng.randrange(0, 40)) + shared + new(rng.randrange(0, 40)))
    texts[100] = " ".join(new(7) + texts[1].split()[10:] + new(3) + texts[1].split()[:55])
    want, got = brute(texts), made(spark, texts)
    assert any(want.values()) and set(got) == set(texts)
    for d, t in texts.items():
        kept = [w for i, w in enumerate(t.split()) if i not in want.get(d, ())]
        assert got[d]["text"].split() == kept and got[d]["n_removed"] == len(want.get(d, ())), d


def test_passages_inside_sentences_and_short_sentences(spark):
    inner = ". ".join(" ".join(f"s{k}w{i}" for i in range(n)) for k, n in enumerate((18, 19, 18)))
    short = " ".join(f"w{i}!" for i in range(60))
    signs = "".join(chr(0x4E00 + 37 * i) for i in range(60))
    texts = {1: f"One begin {inner} end one. Alpha.", 2: f"A longer start of two {inner} other end.", 3: f"Go! {short} Zeta", 4: f"{short} Omega", 5: f"甲{signs}", 6: f"乙丙{signs}丁", 7: "Aa! bb! cc! dd! ee! ff! Seven.", 8: "Other words. Aa! bb! cc! dd! ee! ff! Eight."}
    got = made(spark, texts)
    assert [got[d]["n_removed"] for d in (1, 3, 5, 7)] == [0, 0, 0, 0]
    assert got[2]["text"] == "A longer start of two other end." and got[2]["n_removed"] == 55
    assert got[4]["text"] == "Omega" and got[6]["text"] == "乙丙丁" and got[8]["text"] == "Other words. Eight."


def test_edges(spark):
    docs = odd_docs(spark)
    rows = passages.dedup_passages(docs).collect()
    by = {(r["doc_id"], r["lang"]): r for r in rows}
    assert len(rows) == docs.count() and by[1, None]["text"] is None and by[4, "de"]["text"] == "" and by[3, "en"]["n_removed"] == 0 and by[5, "en"]["n_removed"] == 0
    assert passages.dedup_passages(docs.limit(0)).count() == 0


def test_query_loses_no_span(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in Q.op3_passage_dedup(spark, sf_dir).collect()}
    want = brute(texts)
    assert want and set(got) == set(texts) and all(got[d]["n_removed"] >= len(w) for d, w in want.items())
    assert not brute({d: r["text"] for d, r in got.items()})
