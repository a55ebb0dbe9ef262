"""SentencePiece encoding and decoding of merge-type models, by backtracking over longest matches."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments in each of the two generations that a worker remembers; the older one is dropped as a whole,
#: so memory is bounded for any corpus and frequent words stay.
REMEMBERED = 250_000
#: Longest segment that is remembered, and answers about pairs of tokens kept at a time.
SHORT, PAIRS = 64, 1_000_000


class Pieces:
    """The vocabulary of a merge-type model with byte fallback: what may be merged, and how tokens follow each other.

    Tokens are strings here. A token that merging its own characters does not give can never be in an
    encoding (merges inside a token never depend on what lies outside), so it is left out of the matches.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [(model.is_unknown(i) or model.is_control(i), model.is_byte(i), model.is_unused(i)) for i in range(model.get_piece_size())]
        if not sum(k[1] for k in kinds) == 256 or any(k[2] for k in kinds):
            raise ValueError("only models with byte fallback and without unused pieces are read")
        self.ids = {model.id_to_piece(i): i for i, k in enumerate(kinds) if not any(k)}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i, k in enumerate(kinds) if k[1]}
        self.piece = {i: p for p, i in self.ids.items()}
        self.byte_of = {i: b for b, i in self.byte.items()}
        # a character inside a piece is a token for merging, even where the vocabulary has it not alone
        self.alphabet = {c for p in self.ids for c in p}
        self.valid: dict[tuple[str, str], bool] = {}
        found = ahocorasick.Automaton()
        for token in self.alphabet | {p for p in self.ids if len(p) > 1 and self.merge(p) == [p]}:
            found.add_word(token, token)
        found.make_automaton()
        self.found = found
        self.shorter: dict[str, str | None] = {}
        for token in found.keys():
            k = len(token) - 1
            while k and not found.exists(token[:k]):
                k -= 1
            self.shorter[token] = token[:k] or None
        # no piece goes on after a space mark or holds a line end: texts may be cut there
        cuts = "\n" not in self.alphabet and not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.segment = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if cuts else r"(?s:.+)")

    def merge(self, text: str) -> list[str]:
        """Merge the adjacent pair of the highest score (the leftmost of equal ones) until no pair is a piece. For short texts."""
        parts, score, none = list(text), self.score, -1e30
        near = [score.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while near and (best := max(near)) > none:
            k = near.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            near.pop(k)
            if k < len(near):
                near[k] = score.get(parts[k] + parts[k + 1], none)
            if k:
                near[k - 1] = score.get(parts[k - 1] + parts[k], none)
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether the characters of both tokens, merged anew, give these two tokens."""
        made = self.valid.get((a, b))
        if made is None:
            if len(self.valid) >= PAIRS:
                self.valid.clear()
            made = self.valid[a, b] = self.merge(a + b) == [a, b]
        return made

    def tokens(self, text: str) -> list[str]:
        """The merged tokens of a text of characters of the alphabet.

        A sequence in which every two neighbours may follow each other is the one that merging gives. From each
        place the longest match is tried, then its shorter prefixes; where none fits, the place is marked as
        failed in a bit field and the token before it is shortened. Every place fails once at most.
        """
        longest: list[str] = [""] * len(text)
        for end, token in self.found.iter(text):  # by end: the last match kept for a start is its longest
            longest[end + 1 - len(token)] = token
        failed, at, out, token = bytearray(len(text) + 1), 0, [], longest[0]
        follows, shorter = self.follows, self.shorter
        while True:
            last = out[-1] if out else None
            while token is not None and (failed[at + len(token)] or (last is not None and not follows(last, token))):
                token = shorter[token]
            if token is None:
                failed[at] = 1
                token = out.pop()
                at -= len(token)
                continue
            out.append(token)
            at += len(token)
            if at == len(text):
                return out
            token = longest[at]

    def encode(self, segment: str) -> list[int]:
        """Ids of a segment; what the vocabulary lacks becomes its UTF-8 bytes, and nothing merges across characters of no piece."""
        ids, runs, alphabet = [], [], self.alphabet
        if alphabet.issuperset(segment):
            runs = [segment]
        else:
            begin = 0
            for k, c in enumerate(segment):
                if c not in alphabet:
                    runs += [segment[begin:k]] * (k > begin) + [c]
                    begin = k + 1
            runs += [segment[begin:]] * (begin < len(segment))
        for run in runs:
            for token in self.tokens(run) if run[0] in alphabet else [run]:
                i = self.ids.get(token)
                ids += [i] if i is not None else [self.byte[b] for b in token.encode("utf-8")]
        return ids

    def decode(self, ids: list[int]) -> str:
        """Pieces one after another, runs of bytes as UTF-8 (a byte that is none becomes U+FFFD), space marks as spaces, without the one in front."""
        out, data = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                data.append(self.byte_of[i])
                continue
            if data:
                out.append(_utf8(data))
                data.clear()
            out.append(self.piece.get(i, ""))
        text = "".join(out) + _utf8(data)
        return (text[1:] if ids and text[:1] == SPACE and ids[0] not in self.byte_of else text).replace(SPACE, " ")


def _utf8(data: bytearray) -> str:
    """UTF-8 with one U+FFFD for every byte that belongs to no character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        return data[: e.start].decode("utf-8") + "�" + _utf8(data[e.start + 1 :])


class Codec:
    """Encoder and decoder of one worker, with what it remembers of segments."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.known: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def segment(self, segment: str) -> tuple[int, str, str]:
        """Of one segment: the number of ids, the ids comma-joined, and what they decode to inside a text."""
        made = self.old.get(segment)
        if made is None:
            ids = self.pieces.encode(segment)
            # a leading mark stands for the space that decoding drops in front
            made = (len(ids), ",".join(map(str, ids)), self.pieces.decode([self.pieces.ids[SPACE], *ids]) if SPACE in self.pieces.ids else "")
        if len(segment) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known, self.old = {}, self.known
            self.known[segment] = made
        return made

    def segments(self, text: str) -> list[tuple[int, str, str]]:
        if not text:
            return []
        known, segment = self.known, self.segment
        return [known.get(s) or segment(s) for s in self.pieces.segment.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.segments(text) for i in ids.split(",")]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, out: str = "ids") -> DataFrame:
    """docs with `out`, the token ids of each whole text; null and empty texts have none. Map-only, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([np.array(c.encode(t or ""), dtype=np.int32) for t in texts], dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, "array<int>")(F.col("text").cast("string")))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with `out`, the text of the ids; null for null, empty for none. Ids of no piece (controls, unknown numbers) add nothing."""

    def run(rows: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([None if r is None else c.pieces.decode(r.tolist()) for r in rows], dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, "string")(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs.

    Null texts are empty ones (no tokens; the digests are of the empty string). Repeated rows are kept, a null
    doc_id stays null, other columns are not looked at. The ids never leave the worker: one Arrow pass.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(path), []
        for t in texts:
            made = c.segments(t or "")
            said = hashlib.sha256(",".join([m[1] for m in made]).encode()).hexdigest()
            rows.append((sum(m[0] for m in made), said, hashlib.sha256("".join([m[2] for m in made])[1:].encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pandas_udf(run, kind)(F.col("text").cast("string")).alias("d"))
    return made.select("doc_id", "d.*")
