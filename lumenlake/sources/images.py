"""Image files as tables: bytes with checks, and pixels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.images import webp_size

MAX_BYTES = 25 * 1024 * 1024
#: Kind of an image by its first bytes in hexadecimal (fixed values).
MAGIC = (("image/jpeg", "^FFD8FF"), ("image/png", "^89504E470D0A1A0A"), ("image/gif", "^474946383[79]61"), ("image/bmp", "^424D"), ("image/webp", "^52494646.{8}57454250"))


def content_type(content: Column) -> Column:
    head, out = F.hex(F.substring(content, 1, 12)), F.lit(None).cast("string")
    for kind, pattern in MAGIC:
        out = F.when(head.rlike(pattern), kind).otherwise(out)
    return out


def clean_name(path: Column) -> Column:
    """The file's own name, without control characters, 255 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\p{Cc}", ""), 1, 255)


def read_image_files(spark: SparkSession, path: str, most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(ok, rejects): path, filename, size, sha256, content_type, content; rejects: path, size, reason (too large, unsupported).

    The size test is pushed down to the file listing, so that too large files are never read. Spark leaves empty files out of both.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    held = files.where(F.col("length") <= most).withColumn("content_type", content_type(F.col("content")))
    ok = held.where("content_type is not null").select("path", clean_name(F.col("path")).alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content_type", "content")
    bad = files.where(F.col("length") > most).select("path", F.col("length").alias("size"), F.lit("too large").alias("reason"))
    return ok, bad.unionByName(held.where("content_type is null").select("path", F.col("length").alias("size"), F.lit("unsupported").alias("reason")))


def read_pixels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ok, rejects): path, width, height, channels, pixels (blue, green, red bytes by row); rejects: path, content_type, size, width, height, reason.

    Every file that is not empty is in one of both. Rejects are files that are no images, WEBP (Spark has no decoder; width and
    height are those of the header) and images that do not decode; the files are read once more for them.
    """
    image = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    rows = image.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").toDF("path", "width", "height", "channels", "pixels")
    fits = F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.col("channels") > 0), F.lit(False))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), "content")

    def header(parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([webp_size(bytes(p)) or (None, None) for p in parts], columns=["width", "height"]).astype("Int32")

    one = lambda path: F.regexp_replace(path, "^file:/+", "file:/")  # noqa: E731  both readers write local paths in a way of their own
    bad = files.withColumn("path", one("path")).join(rows.where(fits).select(one("path").alias("path")), "path", "left_anti")
    bad = bad.withColumn("content_type", content_type(F.col("content"))).withColumn("at", F.pandas_udf(header, "width int, height int")("content"))
    reason = F.when(F.col("content_type").isNull(), "unsupported").when(F.col("content_type") == "image/webp", "no decoder").otherwise("does not decode")
    return rows.where(fits).withColumn("path", one("path")), bad.select("path", "content_type", "size", "at.width", "at.height", reason.alias("reason"))
