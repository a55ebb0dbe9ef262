"""Runs of sentences against brute force: passages at any place, short sentences, the SQL twin, odd tables."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lumenlake.llm import queries as Q
from lumenlake.llm import spans
from tests.llm.test_llm import odd_docs


def words(text):
    return spans.WORD.findall(text or "")


def brute_bounds(text, window=10):
    """First words of the sentences, by the rule as it is told."""
    from hashlib import md5

    low = [w.lower() for w in words(text)]
    rank = ["" if re.search(r"""[.!?。！？]["')\]”’»]*$""", w) else md5(w.encode()).hexdigest()[:15] for w in low]
    closes = {i for i, r in enumerate(rank) if r == ""}
    for s in range(len(rank) - window + 1):
        m = min(rank[s : s + window])
        closes |= {i for i in range(s, s + window) if rank[i] == m}
    return [0, *sorted({i + 1 for i in closes} | {len(rank)})] if rank else [0]


def brute(docs, run=2, least=12):
    """doc_id -> (sentences, covered ones), by comparing words."""
    cuts = {d: brute_bounds(t) for d, t in docs.items()}
    seen, gone = set(), {d: set() for d in docs}
    for d in sorted(docs):
        low, b = [w.lower() for w in words(docs[d])], cuts[d]
        for k in range(len(b) - 1):
            e = next((e for e in range(k + run, len(b)) if b[e] - b[k] >= least), None)
            if e:
                key = tuple(low[b[k] : b[e]])
                if key in seen:
                    gone[d].update(range(k, e))
                seen.add(key)
    return {d: (len(cuts[d]) - 1, gone[d]) for d in docs}


NONE = np.zeros(0, int)


def made(spark, texts):
    return {r["doc_id"]: r for r in spans.dedup_spans(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}


@pytest.mark.parametrize("text", ["", " ", "a", "...", " A b. C?! d\n\ne  f", "x " * 40, "\x0b\x0c. é z", "Pi is 3.14 at a.b.com, v1.2 too. Yes", "甲乙。丙 丁 a" * 9])
def test_sentences_are_the_text(text):
    got = spans.bounds(spans.hashes_of(spans.words_of(text), spans.Hashes())).tolist()
    assert got == brute_bounds(text)
    n = len(spans.bounds(spans.hashes_of(spans.words_of(text), spans.Hashes()))) - 1
    whole, n, gone = spans.cut(text, n, NONE, NONE, spans.Hashes())
    assert whole == text and n == len(got) - 1 and gone == 0
    kept = "".join(spans.cut(text, n, np.array([j for j in range(n) if j != k], int), np.array([j + 1 for j in range(n) if j != k], int), spans.Hashes())[0] for k in range(n))
    assert kept == (text if n else "")


def test_numbers_and_addresses_stay_whole():
    text = "Pi is 3.14 at a.b.com today. Next one!"
    b = spans.bounds(spans.hashes_of(spans.words_of(text), spans.Hashes())).tolist()
    assert b == [0, 6, 8]


def test_running_hashes_are_those_of_the_words():
    h = np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64)
    h[200:260] = h[20:80]
    first, end = np.array([20, 200, 21, 201, 20, 300]), np.array([60, 240, 60, 240, 61, 340])
    got = spans.between(h, first, end, spans.BASE).tolist()
    assert got[0] == got[1] and got[2] == got[3] and len(set(got)) == 4


def test_shifted_passages_against_brute_force(spark):
    rng, fresh = random.Random(5), iter(range(10**6))
    new = lambda n: [f"x{next(fresh)}" + rng.choice(["", "", "", "", "", "", "."]) for _ in range(n)]
    texts = {}
    for k in range(40):
        shared = new(rng.choice([50, 51, 60, 120]))
        for d in (2 * k, 2 * k + 1):
            texts[d] = " ".join(new(rng.randrange(0, 40)) + shared + new(rng.randrange(0, 40)))
    texts[100] = " ".join(new(7) + texts[1].split()[10:] + new(3) + texts[1].split()[:55])
    texts[101] = "start here " + " ".join(f"y{i}" for i in range(60))
    texts[102] = " ".join(new(16)) + " " + " ".join(f"y{i}" for i in range(60))  # the offset does not count
    texts[103] = " ".join(new(5)) + " " + " ".join(f"y{i}" for i in range(60))
    want, got = brute(texts), made(spark, texts)
    for d, t in texts.items():
        assert (got[d]["n_sentences"], got[d]["n_removed"]) == (want[d][0], len(want[d][1])), d
    assert all(got[d]["n_removed"] for d in [*range(1, 80, 2), 100, 102, 103]) and not any(got[d]["n_removed"] for d in [*range(0, 80, 2), 101])


def test_every_repeated_50_words_lose_some(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in Q.op3_substring_dedup(spark, sf_dir).collect()}
    want = brute(texts)
    assert {d: (r["n_sentences"], r["n_removed"]) for d, r in rows.items()} == {d: (n, len(g)) for d, (n, g) in want.items()}
    seen, found = set(), 0
    for d in sorted(texts):
        low, b = [w.lower() for w in words(texts[d])], brute_bounds(texts[d])
        lost = {i for k in want[d][1] for i in range(b[k], b[k + 1])}
        for i in range(len(low) - 49):
            span = tuple(low[i : i + 50])
            if span in seen:
                found += 1
                assert lost & set(range(i, i + 50)), (d, i)
            seen.add(span)
    assert found > 100


def test_short_sentences_and_other_scripts(spark):
    short = " ".join(f"w{i}!" for i in range(60))
    signs = "".join(chr(0x4E00 + 37 * i) for i in range(60))
    inner = ". ".join(" ".join(f"s{k}w{i}" for i in range(n)) for k, n in enumerate((18, 19, 18)))
    texts = {1: f"Go! {short} Zeta", 2: f"{short} Omega", 3: f"甲{signs}", 4: f"乙丙{signs}丁", 5: f"One begin {inner} end one.", 6: f"A longer start of two {inner} other end."}
    got = made(spark, texts)
    assert [got[d]["n_removed"] for d in (1, 3, 5)] == [0, 0, 0]
    assert got[2]["text"] == "Omega" and got[2]["n_removed"] == 60 and got[4]["n_removed"] > 3 and got[6]["n_removed"] > 3


def test_equal_ids_null_ids_and_clashing_names(spark):
    text = "One two three four five six. Seven eight nine ten eleven twelve thirteen."
    rows = [(1, text, "a"), (1, "Other words stand here. And no more.", "b"), (None, text, "c"), (None, text, "c"), (None, "Alone here.", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    for name in ("ident", "_key", "covered", "made", "_made", "row_key", "h1", "n_sentences", "N_Removed"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    out = spans.dedup_spans(docs)
    assert out.columns == [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")] + ["n_sentences", "n_removed"]
    got = Counter((r["doc_id"], r["text"], r["key"], r["made"], r["n_removed"]) for r in out.collect())
    assert got == Counter([(None, text, "c", "x", 0), (None, text, "c", "x", 0), (None, "Alone here.", "d", "x", 0), (1, "", "a", "x", 2), (1, "Other words stand here. And no more.", "b", "x", 0)])


def test_sql_twin_takes_odd_texts(spark):
    docs = [(k, t) for k, t in enumerate([None, "", " \n", "one two", "甲乙。丙 丁 a" * 9, " lead  in\tstays. " * 3, "a.b! " * 30, 'He said: "Stop." Then (he left.) And more words go on here now.' * 2])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in ("text", "n_sentences", "n_removed")) for r in spans.dedup_spans(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert got == {d: (t, n, g) for d, t, n, g in con.execute(Q.ORACLES["op3_substring_dedup"]).fetchall()}


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    assert spans.dedup_spans(docs).count() == 8 and spans.dedup_spans(docs.limit(0)).count() == 0
