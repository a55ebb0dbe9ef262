"""Folder listings and billing files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BILLING = "service string, cost string, currency string, _broken string"


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and length of every file that is not empty; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    return files.select(F.substring(F.col("path"), len(whole) + 2, 1 << 30).alias("path"), "length")


def read_billing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of CSV files with the columns service, cost, currency.

    good: cost to four places, `Other` for rows without a service, USD for those without a currency. bad: the line and
    its reason: not three fields (broken), or a cost that is no finite number (cost).
    """
    # without column pruning: a line is broken whichever columns are asked for
    rows = spark.read.schema(BILLING).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("columnPruning", False).csv(path)
    rows = rows.withColumn("_cost", F.col("cost").try_cast("double"))
    fine = F.coalesce(~F.isnan("_cost") & (F.abs("_cost") < float("inf")), F.lit(False))
    reason = F.when(F.col("_broken").isNotNull(), "broken").when(~fine, "cost")
    filled = lambda c, other: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit(other)).alias(c)
    good = rows.where(reason.isNull()).select(filled("service", "Other"), F.round("_cost", 4).alias("cost"), filled("currency", "USD"))
    line = F.coalesce("_broken", F.concat_ws(",", "service", "cost", "currency"))
    return good, rows.where(reason.isNotNull()).select(line.alias("line"), reason.alias("reason"))
