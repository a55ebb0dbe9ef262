"""Streams of uploads, shots, heartbeats and analyses.

Sinks write one folder a micro-batch, replaced as a whole, so that a batch that is run again after a lost
executor or a restart gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumenlake.functions.hashes import whole
from lumenlake.operators.near_hashes import Bands, entries
from lumenlake.operators.pairs import best_match, exact_pairs, similar_pairs
from lumenlake.sources.scratch import materialise, scope


def _write(df: DataFrame, root: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch}")


def stored(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame:
    """A table that a sink wrote; `before`: only the batches below that number."""
    df = spark.read.parquet(f"{root}/{name}")
    return (df if before is None else df.where(F.col("batch_id") < before)).drop("batch_id")


def near_candidates(batch: DataFrame, catalogue: DataFrame, distance: int = 10) -> DataFrame:
    """phash values of the catalogue that may lie within `distance` bits of one of the batch: some 16-bit band is near.

    The batch, being small, flips all bits that a band may differ in; the catalogue sends each band as it is.
    """
    bands, names = Bands(Bands.of(4, distance).bands, 0, distance // 4), ("band", "key")
    probe = entries(batch.select("phash").distinct(), whole(F.col("phash")), bands, bands.probe, names).select(*names).distinct()
    return entries(catalogue.select("phash").distinct(), whole(F.col("phash")), bands, 0, names).join(probe, [*names], "left_semi").select("phash").distinct()


def compare_batch(batch: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Exact and similar pairs with an end in the batch; only catalogue rows of the same content or a near hash take part."""
    own = batch.select(F.col("id").alias("photo_a"))
    same = catalogue.join(batch.select("sha256").distinct(), "sha256", "left_semi").select(*batch.columns)
    near = catalogue.join(near_candidates(batch, catalogue), "phash", "left_semi").select(*batch.columns)
    pairs = exact_pairs(batch.unionByName(same)).unionByName(similar_pairs(batch.unionByName(near)))
    here = own.select("photo_a", F.lit(True).alias("_a"))
    there = own.select(F.col("photo_a").alias("photo_b"), F.lit(True).alias("_b"))
    return pairs.join(here, "photo_a", "left").join(there, "photo_b", "left").where("_a or _b").select("photo_a", "photo_b", "kind", "similarity")


def stream_uploads(stream: DataFrame, root: str) -> DataStreamWriter:
    """Photos (id, sha256, phash, dhash, width, height, uploaded_at, ...) into root/photos, with root/matches and root/best.

    Every batch is compared with all batches before it and with itself. The caller sets the checkpoint and
    the trigger, and starts it; root belongs to one checkpoint.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scope():
            rows = materialise(batch, "upload")
            catalogue = stored(spark, root, "photos", number) if number else rows.limit(0)
            matches = materialise(compare_batch(rows, catalogue), "upload-matches")
            _write(matches, root, "matches", number)
            _write(best_match(matches, catalogue.select("id", "uploaded_at").unionByName(rows.select("id", "uploaded_at"))), root, "best", number)
            _write(rows, root, "photos", number)

    return stream.writeStream.foreachBatch(add)


def stream_new_files(stream: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """The first upload of each content within the watermark; what is stored already is left out later by an anti-join."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["sha256"])


def stream_bursts(stream: DataFrame, time: str = "taken_at", gap: str = "10 seconds", late: str = "10 minutes", key: str | None = None) -> DataFrame:
    """Runs of shots no further apart than `gap`, of two or more: start, shots, the sharpest one's id. Later shots than the watermark are dropped."""
    session = F.session_window(time, gap)
    groups = [session, *([F.col(key)] if key else [])]
    made = stream.withWatermark(time, late).groupBy(*groups).agg(F.count("*").alias("shots"), F.max_by("id", F.struct("sharpness", "id")).alias("sharpest"))
    return made.where("shots > 1").select(*([key] if key else []), F.col("session_window.start").alias("start"), "shots", "sharpest")


def stream_liveness(heartbeats: DataFrame) -> DataFrame:
    """name, last_seen of every worker (update or complete mode)."""
    return heartbeats.groupBy("name").agg(F.max("last_seen").alias("last_seen"))


def stream_status(stream: DataFrame) -> DataFrame:
    """Running number of photos by status (waiting holds those in processing)."""
    status = F.coalesce("ai_status", F.lit("waiting"))
    return stream.groupBy(F.when(status == "processing", "waiting").otherwise(status).alias("status")).agg(F.count("*").alias("n"))


def stream_freed_bytes(deletions: DataFrame) -> DataFrame:
    """Running bytes of files deleted as duplicates."""
    return deletions.groupBy().agg(F.coalesce(F.sum(F.when(F.col("duplicate"), F.col("size"))), F.lit(0)).alias("freed_bytes"))


def stream_upload_counts(stream: DataFrame, time: str, late: str = "1 hour", length: str = "1 hour") -> DataFrame:
    """start, uploads, bytes in windows of `length`."""
    made = stream.withWatermark(time, late).groupBy(F.window(time, length)).agg(F.count("*").alias("uploads"), F.sum("size").alias("bytes"))
    return made.select(F.col("window.start").alias("start"), "uploads", "bytes")
