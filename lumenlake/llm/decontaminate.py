"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

A test item with n distinct shingles is contained in a document at `share` or more only if the document
lacks at most n - ceil(share * n) of them, so at least one of any n - ceil(share * n) + 1 is there. The
MinHash sketch of an item is that many of its smallest shingle hashes. Items are partitioned by size
(powers of two of n) and the sketch length is set by the largest size of the partition, so a candidate is
never missed however long the document is. (A sketch of the documents could not do that: a short item is a
few thousandths of a long one.) Candidates are verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.names import fresh, quoted
from lumenlake.sources.scratch import materialise

SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a table that is sent to every task, about 64 bytes each; larger ones are joined by a shuffle.
ROOM = 500_000


def words(text: Column) -> Column:
    """Lower-cased runs of anything but ASCII white space."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE, -1), lambda w: w != "")


def _windows(w: Column, n: Column | int, join) -> Column:
    """join(first index) over all n-word windows; none of a shorter sequence."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), join))


def shingles(w: Column, n: Column | int) -> Column:
    """The distinct n-word windows, as text."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.array_distinct(F.coalesce(_windows(w, n, lambda i: F.array_join(F.slice(w, i, n), " ")), F.array().cast("array<string>")))


def shingle_hashes(w: Column, n: int) -> Column:
    """The hashes of all n-word windows, repeats included."""
    hashes = _windows(w, n, lambda i: F.xxhash64(*[F.get(w, i - 1 + k) for k in range(n)]))
    return F.coalesce(hashes, F.array().cast("array<long>"))


def _of_sizes(w: Column, sizes: list[int], each) -> Column:
    """each(n) for all sizes in one array."""
    return F.concat(*[each(n) for n in sizes])


def _sent(side: DataFrame) -> DataFrame:
    """A written side of a join: to every task below ROOM rows, else by a shuffle."""
    return F.broadcast(side) if side.count() <= ROOM else side.hint("merge")


def sketches(items: DataFrame, sizes: list[int], share: float) -> DataFrame:
    """item_key, hash: the MinHash sketch of each item (item_key, w, m), its length set by the item's size partition."""
    own = F.lit(None).cast("array<long>")
    for n in sizes:
        own = F.when(F.col("m") == n, shingle_hashes(F.col("w"), n)).otherwise(own)
    sized = items.withColumn("h", F.array_sort(F.array_distinct(own))).where(F.size("h") > 0)
    top = F.pow(F.lit(2), F.ceil(F.log2(F.size("h")))).cast("int")  # the largest size of the partition
    length = F.least(F.size("h"), top - F.ceil(F.lit(share) * top - 1e-9).cast("int") + 1)
    return sized.select("item_key", F.explode(F.slice("h", F.lit(1), length)).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, share: float = 0.8, n: int = 5) -> DataFrame:
    """doc_key, doc_id, item_id, n_shingles, n_shared, containment: every pair at `share` or more.

    doc_key is a hash of (doc_id, text), so that rows with one id and different texts stay apart; equal
    rows give one pair. Null or empty texts and items match nothing. An item of m < n words is one shingle of m
    words, found wherever a document has them in a row; so a very short item hits many documents. Candidate
    documents are found in one scan, which hands on their texts; no other text is shuffled while the sketch
    has at most ROOM rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = materialise(items.select("item_id", F.xxhash64("item_id", "w").alias("item_key"), "w", F.least(F.size("w"), F.lit(n)).alias("m")).distinct(), "decon-items")
    sizes = sorted(r["m"] for r in items.select("m").distinct().collect())  # n numbers at most
    if not sizes:
        return docs.limit(0).select("doc_key", "doc_id", *[F.lit(None).cast(k).alias(c) for c, k in (("item_id", "long"), ("n_shingles", "long"), ("n_shared", "long"), ("containment", "double"))])
    sketch = materialise(sketches(items, sizes, share).distinct(), "decon-sketch")
    small = sketch.count() <= ROOM  # a larger one is joined by a shuffle, in which no text takes part
    seen = docs.withColumn("w", words(F.col("text"))).select("doc_key", "doc_id", (F.col("text") if small else F.lit(None)).alias("text"), F.explode(F.array_distinct(_of_sizes(F.col("w"), sizes, lambda k: shingle_hashes(F.col("w"), k)))).alias("hash"))
    found = seen.join(_sent(sketch), "hash").groupBy("doc_key", "doc_id").agg(F.first("text").alias("text"), F.collect_set("item_key").alias("items"))
    if not small:
        found = found.drop("text").hint("merge").join(docs.groupBy("doc_key").agg(F.first("text").alias("text")), "doc_key")
    found = materialise(found, "decon-candidates")
    pairs = found.select("doc_key", "doc_id", F.explode("items").alias("item_key"))
    parts = materialise(items.select("item_key", "item_id", F.explode(shingles(F.col("w"), F.col("m"))).alias("s")), "decon-shingles")
    size = parts.groupBy("item_key", "item_id").agg(F.count("*").alias("n_shingles"))
    own = found.withColumn("w", words(F.col("text"))).select("doc_key", "doc_id", F.explode(F.array_distinct(_of_sizes(F.col("w"), sizes, lambda k: shingles(F.col("w"), k)))).alias("s"))
    shared = own.join(_sent(parts), "s").groupBy("doc_key", "doc_id", "item_key").agg(F.count("*").alias("n_shared"))
    exact = shared.join(_sent(materialise(size, "decon-sizes")), "item_key").where(F.col("n_shared") >= F.lit(share) * F.col("n_shingles") - 1e-9)
    exact = exact.alias("e").join(pairs.hint("merge").alias("p"), F.expr("e.doc_key = p.doc_key AND e.item_key = p.item_key AND e.doc_id <=> p.doc_id"), "left_semi")
    return exact.select("doc_key", "doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, share: float = 0.8, n: int = 5) -> DataFrame:
    """The rows of docs that contain no test item; all columns, repeated rows, null ids and null texts are kept."""
    key, ident = fresh(docs, "key", "ident")
    hits = contained(docs, items, share, n).select(F.col("doc_key").alias(key), F.coalesce("doc_id", F.lit(-1)).alias(ident)).distinct()
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.withColumns({key: F.xxhash64(doc_id, F.coalesce(F.col("text").cast("string"), F.lit(""))), ident: F.coalesce(doc_id, F.lit(-1))})
    return keyed.join(_sent(materialise(hits, "decon-hits")), [key, ident], "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
