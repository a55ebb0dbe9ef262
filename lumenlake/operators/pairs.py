"""Exact and similar pairs of photos."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.hashes import aspect_difference, hash_distance
from lumenlake.operators.near_hashes import near_pairs


def already_stored(fingerprints: DataFrame, photos: DataFrame) -> DataFrame:
    """sha256, filename of the first upload with that content, for each distinct fingerprint that is stored."""
    wanted = fingerprints.select(F.lower("sha256").alias("sha256")).distinct()
    first = photos.groupBy("sha256").agg(F.min_by("filename", F.struct("uploaded_at", "id")).alias("filename"))
    return wanted.join(first, "sha256")


def exact_pairs(photos: DataFrame) -> DataFrame:
    """photo_a (newer), photo_b (older): every pair of equal content. The result itself is quadratic in a group of copies."""
    a = photos.select("sha256", F.col("id").alias("photo_a"), F.struct("uploaded_at", "id").alias("ka"))
    b = photos.select("sha256", F.col("id").alias("photo_b"), F.struct("uploaded_at", "id").alias("kb"))
    return a.join(b, "sha256").where("ka > kb").select("photo_a", "photo_b", F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"))


def exact_stars(photos: DataFrame) -> DataFrame:
    """The same components with one edge a copy: each to the first upload of its content."""
    first = photos.groupBy("sha256").agg(F.min_by("id", F.struct("uploaded_at", "id")).alias("photo_b"))
    return photos.join(first, "sha256").where("id <> photo_b").select(F.col("id").alias("photo_a"), "photo_b", F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"))


def similar_pairs(photos: DataFrame, phash: int = 10, dhash: int = 12, aspect: float = 0.15) -> DataFrame:
    """photo_a (newer), photo_b (older), similarity: unequal content, like hashes and shape.

    Photos are folded to distinct (content, hashes, size) first, so copies do not multiply candidates; hashes meet by bands
    of pHash bits and by shape together.
    """
    cols = ["sha256", "phash", "dhash", "width", "height"]
    bucket = F.floor(F.log(F.col("width") / F.col("height")) / -math.log(1 - aspect)).cast("int")
    kinds = photos.select(*cols).distinct().withColumn("shape", bucket)
    nodes = kinds.select(F.col("phash").alias("h"), "shape").where("h is not null and shape is not null").distinct()
    near = near_pairs(nodes, phash, "shape")
    own = nodes.select(F.col("h").alias("a"), F.col("h").alias("b"), F.lit(0).alias("d"), F.col("shape").alias("shape_a"), F.col("shape").alias("shape_b"))
    way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), "d", F.col(f"shape_{x}").alias("shape_a"), F.col(f"shape_{y}").alias("shape_b"))
    near = near.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).select("w.*").unionByName(own)
    left, right = (kinds.select(*[F.col(c).alias(f"{c}_{k}") for c in cols], F.col("shape").alias(f"shape_{e}")) for k, e in ((1, "a"), (2, "b")))
    near = near.withColumnsRenamed({"a": "phash_1", "b": "phash_2"})
    joined = left.join(near, ["phash_1", "shape_a"]).join(right, ["phash_2", "shape_b"])
    joined = joined.where(F.col("sha256_1") != F.col("sha256_2")).withColumn("e", hash_distance(F.col("dhash_1"), F.col("dhash_2")))
    ok = joined.where((F.col("e") <= dhash) & (aspect_difference(F.col("width_1"), F.col("height_1"), F.col("width_2"), F.col("height_2")) <= aspect))
    score = F.least(F.lit(0.99), F.round(1 - (F.col("d") + F.col("e")) / 128, 3))
    ok = ok.select(*[F.col(f"{c}_{k}") for c in cols for k in (1, 2)], score.alias("similarity"))
    a = photos.select(F.col("id").alias("photo_a"), *[F.col(c).alias(f"{c}_1") for c in cols], F.struct("uploaded_at", "id").alias("ka"))
    b = photos.select(F.col("id").alias("photo_b"), *[F.col(c).alias(f"{c}_2") for c in cols], F.struct("uploaded_at", "id").alias("kb"))
    out = ok.join(a, [f"{c}_1" for c in cols]).join(b, [f"{c}_2" for c in cols]).where("ka > kb")
    return out.select("photo_a", "photo_b", F.lit("similar").alias("kind"), "similarity")


def best_match(matches: DataFrame, photos: DataFrame) -> DataFrame:
    """photo_a, its best photo_b and similarity; on ties the earliest upload, then id."""
    older = photos.select(F.col("id").alias("photo_b"), "uploaded_at")
    rank = F.struct(-F.col("similarity"), "uploaded_at", "photo_b")
    return matches.join(older, "photo_b").groupBy("photo_a").agg(F.min_by(F.struct("photo_b", "similarity"), rank).alias("m")).select("photo_a", "m.photo_b", "m.similarity")
