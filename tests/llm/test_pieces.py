"""op13: encoding and decoding against the sentencepiece library, and the digests of every row."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from lumenlake.llm import pieces
from lumenlake.llm.queries import PIECE_MODEL

PATH = public_tokenizers.path(PIECE_MODEL)
EDGES = ["", " ", "   ", "  a", "a  ", "▁", "▁ x", "\n", "\n\n a\n b ", "é𝕏𝕏", "<s></s><0x41><unk>", "\0a", "a" * 3000, "ab" * 2000, " " * 3000, "日本語" * 400, "ก" * 100, "🙂👩‍👩‍👧", "�"]


@pytest.fixture(scope="module")
def both():
    return pieces.Codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(3)
    vocabulary = list(pieces.codec(PATH).pieces.ids)
    yield from EDGES
    for _ in range(1500):
        yield "".join(rng.choice("aeinrst  helo\n▁") for _ in range(rng.randint(1, 60)))
        yield "".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 20)))
        yield "".join(chr(rng.choice([rng.randint(1, 300), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x10FFFF)])) for _ in range(20))


def test_same_as_the_library(both):
    own, library = both
    for text in texts():
        ids = library.encode(text)
        assert own.encode(text) == ids, text[:80]
        assert own.pieces.decode(ids) == library.decode(ids), text[:80]


def test_decode_of_any_ids(both):
    own, library = both
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(259, 31_999), 259]) for _ in range(rng.randint(0, 12))]
        assert own.pieces.decode(ids) == library.decode(ids), ids


def test_backtracking_is_merging(both):
    vocabulary, rng = both[0].pieces, random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice("▁theindorag") for _ in range(rng.randint(1, 40)))
        assert vocabulary.tokens(text) == vocabulary.merge(text)


def test_generations_of_memory(both, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    own, text = pieces.Codec(PATH), "one two three four five one two six seven one"
    assert own.encode(text) == own.encode(text) == both[1].encode(text)
    assert len(own.known) <= 3 and len(own.old) <= 3


def test_digests(spark, both):
    rows = [(k, t, "x", "y") for k, t in enumerate(EDGES)] + [(None, "a b", "x", "y"), (7, None, None, None), (7, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, d string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for k, t, *_ in rows:
        ids = both[1].encode(t or "")
        wanted.append((k, len(ids), sha(",".join(map(str, ids))), sha(both[1].decode(ids))))
    found = [tuple(r) for r in pieces.digests(docs, PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert pieces.digests(docs.limit(0), PATH).count() == 0


def test_ids_and_back(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*EDGES, None])], "doc_id long, text string")
    made = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in made)
