"""Secret scans: fixed patterns and sliding-window entropy, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.names import fresh, quoted

#: Base patterns (fixed values), and the shortest accepted length of the group after them.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
#: A candidate for the entropy scan, and the alphabet of its characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Least entropy in bits a character of a window, by the character class of the candidate. A class that
#: is not listed (letters of one case, digits alone) holds words and numbers, never secrets.
THRESHOLDS = (
    (r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F-]+$", 3.0),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", 3.6),
    (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$|^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", 3.5),
    (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$", 3.7),
)
#: Candidates that are never secrets: UUIDs, placeholders, counted-out alphabets, dates.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|your[-_]|dummy|xxxx",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[-_T]",
)

Span = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(a: Column, zero: Column, fold, size: int) -> Column:
    """fold over each `size` neighbours of a."""
    ks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int"))
    return F.when(F.size(a) > 0, F.transform(ks, lambda k: F.aggregate(F.slice(a, k * size + 1, size), zero, fold))).otherwise(F.slice(a, 1, 0))


def _running(a: Column, fold, size: int = 64) -> Column:
    """For each element of an int array the fold of all before it, from 0.

    A tree of folds over 64, 4096 and 262,144 elements: about 130 steps an element, however many there are.
    """
    zero = F.lit(0)

    def before(v: Column, i: Column) -> Column:
        out, whole, levels = zero, i, []
        for name in ("l0", "l1", "l2"):
            up = F.floor(whole / size).cast("int")
            levels.append((name, up * size + 1, whole - up * size))
            whole = up
        levels.append(("l3", F.lit(1), whole))
        for name, start, n in levels:
            out = fold(out, F.aggregate(F.slice(v[name], start, n), zero, fold))
        return out

    def grow(v: Column, names: tuple[str, ...]) -> Column:
        """One more level above the last, until there are four."""
        if len(names) == 4:
            return F.transform(v["l0"], lambda _, i: before(v, i))
        more = F.struct(*[v[k].alias(k) for k in names], _blocks(v[names[-1]], zero, fold, size).alias(f"l{len(names)}"))
        return _let(more, lambda u: grow(u, (*names, f"l{len(names)}")))

    return _let(F.struct(a.alias("l0")), lambda v: grow(v, ("l0",)))


def _add(s: Column, x: Column) -> Column:
    return s + x


def _most(s: Column, x: Column) -> Column:
    return F.greatest(s, x)


def _found(text: Column, pattern: str, kind: int, accept=None) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points.

    The text is split at the matches; a match starts after the pieces and matches before it.
    """

    def spans(v: Column) -> Column:
        both = F.transform(v["hits"], lambda h, i: F.length(F.get(v["pieces"], i)) + F.length(h))

        def span(h: Column, i: Column, at: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(v["pieces"], i))
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(h)).alias("end"), h.alias("hit"))

        return _let(_running(both, _add), lambda at: F.transform(v["hits"], lambda h, i: span(h, i, at)))

    made = _let(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits")), spans)
    if accept is not None:
        made = F.filter(made, lambda s: accept(s["hit"]))
    return F.transform(made, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


#: Counts of characters kept in one number, and the bits of each: windows are of 62 characters at most.
A_CELL, BITS = 8, 6


def window_entropy(word: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits a character) of any `window` characters of word; null if it is shorter.

    The word becomes an array of characters once. Counts are kept by character, eight in a number; a step adds the
    character that enters and takes the one that leaves, and the sum of n log n changes by those two terms alone, so
    a step costs the same wherever it is.
    """
    term = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    cost = lambda n: F.element_at(term, n + 1)
    cell = lambda c: F.shiftright(c, 3)
    shift = lambda c: c.bitwiseAND(F.lit(A_CELL - 1)) * BITS
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))
    count = lambda counts, c: F.call_function("shiftright", F.element_at(counts, cell(c) + 1), shift(c)).bitwiseAND(F.lit(2**BITS - 1)).cast("int")
    zero = F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // A_CELL))
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))

    def most(codes: Column) -> Column:
        def enter(state: Column, new: Column) -> Column:
            have = count(state["counts"], new)
            counts = F.transform(state["counts"], lambda c, i: c + F.when(i == cell(new), one(new)).otherwise(0))
            return F.struct(counts.alias("counts"), (state["sum"] + cost(have + 1) - cost(have)).alias("sum"), state["least"].alias("least"))

        def move(state: Column, k: Column) -> Column:
            new, old = F.element_at(codes, k), F.element_at(codes, k - window)
            have, had = count(state["counts"], new), count(state["counts"], old)
            counts = F.transform(state["counts"], lambda c, i: c + F.when(i == cell(new), one(new)).otherwise(0) - F.when(i == cell(old), one(old)).otherwise(0))
            total = F.when(new == old, state["sum"]).otherwise(state["sum"] + cost(have + 1) - cost(have) + cost(had - 1) - cost(had))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.least(state["least"], total).alias("least"))

        first = F.aggregate(F.slice(codes, 1, window), start, enter, lambda s: s.withField("least", s["sum"]))
        rest = F.filter(F.sequence(F.lit(window), F.size(codes)), lambda k: k > window)
        return F.aggregate(rest, first, move, lambda s: F.lit(math.log2(window)) - s["least"] / window)

    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.when(F.length(word) >= window, _let(codes, most))


def _suspicious(word: Column) -> Column:
    limit = F.lit(None).cast("double")
    for pattern, least in reversed(THRESHOLDS):
        limit = F.when(word.rlike(pattern), F.lit(least)).otherwise(limit)
    allowed = word.rlike("|".join(f"(?:{p})" for p in ALLOWED))
    return F.coalesce(F.when(~allowed & limit.isNotNull(), window_entropy(word) >= limit), F.lit(False))


def _uncovered(spans: Column) -> Column:
    """Sorted spans without the entropy ones that a base span holds: a base span before it ends no earlier."""

    def kept(v: Column) -> Column:
        return F.when(F.size(v) > 0, uncovered(v)).otherwise(v)

    def uncovered(v: Column) -> Column:
        ends = F.transform(v, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0))
        return _let(_running(ends, _most), lambda most: F.filter(v, lambda s, i: (s["kind"] < 3) | (F.get(most, i) < s["end"])))

    return _let(spans, kept)


def scan(docs: DataFrame, to: str = "secret_spans") -> DataFrame:
    """All columns of docs and `to`, an array of (start, kind, end) sorted by start, then kind; an own column `to` is replaced.

    kind numbers KINDS; positions are code points, ends exclusive. An assignment span is the whole match.
    Entropy spans that a base span covers are left out; base spans always stay. A null or empty text has none;
    repeated rows are scanned alike. Map-only. Cheap tests of the whole text stand before each pattern, so most
    rows never meet it; the work grows with the length of a text and its hits, not with their square.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lower = F.lower(text)
    hint = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        hint = hint | F.contains(lower, F.lit(word))
    none = F.array().cast(Span)
    assign = F.when(hint, _found(text, ASSIGN, 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 12)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _found(text, ACCESS, 1)).otherwise(none)
    digits = F.when(text.rlike(HEX), _found(text, HEX, 2)).otherwise(none)
    other = F.when(text.rlike(CANDIDATE), _found(text, CANDIDATE, 3, _suspicious)).otherwise(none)
    return docs.withColumn(to, _uncovered(F.array_sort(F.concat(assign, access, digits, other))))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, the digest of the base spans and all spans, for every row of docs.

    A null or empty text has no spans (digest of the empty string); null ids and repeated rows keep their row.
    """
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.filter("secret_spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        written(F.col("secret_spans")).alias("spans"),
        count(3).alias("n_entropy"),
    )


def _cut(blocks: Column, start: Column, end: Column, size: int) -> Column:
    """Code points start..end of a text held in blocks of `size`."""
    first = F.floor(start / size).cast("int")
    held = F.array_join(F.slice(blocks, first + 1, F.floor(end / size).cast("int") - first + 1), "")
    return F.substr(held, start - first * size + 1, end - start)


def redact(docs: DataFrame, mark: str = "[SECRET]", block: int = 4096) -> DataFrame:
    """docs with every secret span of text replaced by a mark (overlapping spans by one); all other columns unchanged.

    Null and empty texts and texts without secrets stay as they are; repeated rows are changed alike. The text is
    held in blocks, so that a span far into it costs no more than one near its start.
    """
    (spans,) = fresh(docs, "spans")
    text = F.col("text").cast("string")

    def clean(v: Column) -> Column:
        ends = F.transform(v["spans"], lambda s: s["end"])

        def joined(most: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                at = F.get(most, i)
                return F.when(s["start"] >= at, F.concat(_cut(v["blocks"], at, s["start"], block), F.lit(mark))).otherwise(F.lit(""))

            last = F.array_max(ends)
            return F.concat(F.array_join(F.transform(v["spans"], piece), ""), _cut(v["blocks"], last, v["n"], block))

        return _let(_running(ends, _most), joined)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), 0)
    changed = _let(F.struct(F.col(spans).alias("spans"), blocks.alias("blocks"), F.length(text).alias("n")), clean)
    out = F.when(F.size(spans) > 0, changed).otherwise(text).alias("text")
    return scan(docs, spans).select(*[out if c.lower() == "text" else F.col(quoted(c)) for c in docs.columns])
