"""The pipeline against its stages run by brute force on what each stage was given."""

import hashlib

import corpus_pipeline as C
from lumenlake.llm import bpe
from lumenlake.sources import scratch
from tests.llm.test_llm import brute_base, brute_components, brute_fingerprint, odd_docs, reference_encoding


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    good = C.quality_rules(spark, docs, sf_dir)
    assert good.columns == columns
    rows = {r["doc_id"]: r for r in good.collect()}
    low = brute_components({d: brute_fingerprint(r["text"]) for d, r in rows.items()})
    one = C.near_dedup(spark, good, sf_dir)
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(set(low.values()))
    clean = C.decontamination(spark, one, sf_dir)
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]

    def hit(text):
        w = text.lower().split()
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return any(len(s & own) >= 0.8 * len(s) for s in sets)

    want = {d for d in set(low.values()) if not hit(rows[d]["text"])}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == want
    safe = C.secret_scan(spark, clean, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert safe.columns == columns and set(texts) == want
    for d, t in texts.items():
        assert (t == rows[d]["text"]) == (not brute_base(rows[d]["text"])) or "[SECRET]" in t
    known = reference_encoding()
    final = {r["doc_id"]: r for r in C.run(spark, sf_dir).collect()}
    assert set(final) == want
    for d, r in final.items():
        ids = known.encode_ordinary(texts[d])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stages_take_odd_and_empty_tables(spark, sf_dir):
    docs = odd_docs(spark)
    rows = lambda df: sorted(map(repr, df.select("doc_id", "text", "lang", "source").collect()))
    every = rows(docs)
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf_dir)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        if k < 4:
            assert out.columns == docs.columns and all(r["slot"] == "x" for r in out.collect()), name
        if k == 0:  # too few words but in one text
            assert [r["doc_id"] for r in out.collect()] in ([5], [])
        elif k == 1:  # 1 and 2 have no words, 3 stands twice and as 4
            assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 3, 5, 6]
        elif k in (2, 3):
            assert rows(out) == every
        else:
            assert {r["doc_id"]: r["n_tokens"] for r in out.collect()}[1] == 0 and out.count() == 8
    assert bpe.REMEMBERED > 0


def test_one_id_on_two_texts_keeps_both_groups(spark, sf_dir):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    docs = spark.createDataFrame([(1, texts[0], "x"), (1, texts[1], "x"), (2, texts[1], "x"), (3, texts[2], "x"), (3, texts[2], "x")], "doc_id long, text string, _n string")
    out = C.near_dedup(spark, docs, sf_dir)
    assert out.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted([(1, texts[0]), (1, texts[1]), (3, texts[2])])


def test_run_clears_the_tables_of_its_stages(spark, sf_dir):
    before = set(scratch._HELD)
    assert C.run(spark, sf_dir).count() > 0
    assert [p.rsplit("/", 1)[1].split("-")[:2] for p in set(scratch._HELD) - before] == [["pipeline", "3"]]
