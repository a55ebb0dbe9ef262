"""Bursts of shots and the clean-up list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.sources.scratch import materialise

#: Shots that one range of time is made for.
A_RANGE = 100_000


def bursts(shots: DataFrame, seconds: int = 10, similarity: float = 0.8, ranges: int | None = None) -> DataFrame:
    """burst (id of its first shot), id: runs of shots at most `seconds` apart, each like the one before.

    shots: id, sha256, taken (timestamp), vector. The first shot of each content counts. Shots are dealt into ranges of
    time and id, so that any number in one second is several tasks; a task scans its range once, in order, and gives
    its first and last shot. Runs go on from range to range over those ends, which are as few as the ranges.
    """
    spark, kind = shots.sparkSession, dict(shots.dtypes)["id"]
    first = shots.where("taken is not null and vector is not null").groupBy("sha256").agg(F.min_by(F.struct("id", "taken", "vector"), F.struct("taken", "id")).alias("s")).select("s.*")
    rows = materialise(first.select("id", F.col("taken").cast("timestamp").cast("double").alias("at"), F.col("vector").cast("array<double>").alias("vector")), "burst-shots")
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // A_RANGE))
    ends = f"first struct<id:{kind},at:double,vector:array<double>>, last struct<id:{kind},at:double,vector:array<double>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with the shot that opened its run, if that is known in this range; then the ends of the range."""
        part, opened, begin, last = TaskContext.get().partitionId(), None, None, None
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at, vectors = batch.column("id"), batch.column("at").to_numpy(), [v.values.to_numpy(zero_copy_only=False) for v in batch.column("vector")]
            starts = []
            for k, (t, v) in enumerate(zip(at, vectors, strict=True)):
                if last is None:
                    begin = (ids[k].as_py(), t, v)  # whether it goes on with the range before is not known here
                elif not follows(last, t, v, seconds, similarity):
                    opened = ids[k].as_py()
                starts.append(opened)
                last = (ids[k].as_py(), t, v)
            end = pa.struct([("id", ids.type), ("at", pa.float64()), ("vector", pa.list_(pa.float64()))])
            schema = pa.schema([("part", pa.int32()), ("id", ids.type), ("start", ids.type), ("first", end), ("last", end)])
            none = pa.nulls(batch.num_rows, end)
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), ids, pa.array(starts, ids.type), none, none], schema=schema)
        if last is not None:
            made = [[dict(zip(("id", "at", "vector"), (e[0], float(e[1]), e[2].tolist()), strict=True))] for e in (begin, last)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.nulls(1, schema.field("id").type), pa.array([opened], schema.field("id").type), *[pa.array(m, schema.field("first").type) for m in made]], schema=schema)

    dealt = rows.repartitionByRange(ranges, "at", "id").sortWithinPartitions("at", "id")
    seen = materialise(dealt.mapInArrow(scan, f"part int, id {kind}, start {kind}, {ends}"), "burst-scan")
    carried, open_, before = [], None, None
    for r in sorted(seen.where("first is not null").select("part", "start", "first", "last").collect(), key=lambda r: r["part"]):  # one a range
        goes_on = before is not None and follows((None, before["at"], np.array(before["vector"])), r["first"]["at"], np.array(r["first"]["vector"]), seconds, similarity)
        carried.append((r["part"], open_ if goes_on else r["first"]["id"]))
        open_, before = r["start"] if r["start"] is not None else carried[-1][1], r["last"]
    carry = F.broadcast(spark.createDataFrame(carried, f"part int, carry {kind}"))
    found = seen.where("first is null").join(carry, "part").select(F.coalesce("start", "carry").alias("burst"), "id")
    sizes = found.groupBy("burst").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(sizes, "burst").select("burst", "id")


def follows(last: tuple, at: float, vector: np.ndarray, seconds: float, similarity: float) -> bool:
    """Whether a shot goes on with the run of the last one (id, at, vector): soon after it and like it."""
    return at - last[1] <= seconds and len(vector) == len(last[2]) and float(vector @ last[2]) >= similarity


def cleanup(photos: DataFrame, groups: DataFrame, burst_rows: DataFrame, auto: DataFrame, blurry: float = 45.0) -> DataFrame:
    """id, reason, keep, ticked, bytes, size: what may go, the first reason of each photo, bytes once a content.

    groups: duplicate_groups; burst_rows: burst, id; auto: album, id. Order of reasons: lower-quality
    copy, blurrier burst shot, very blurry, screenshot, meme, forwarded (the last three unticked).
    """
    base = photos.select("id", "sha256", "size", "sharpness")
    keeper = base.select(F.col("id").alias("group_id"), F.col("sha256").alias("keeper_sha"))
    lower = groups.where("place > 1").join(keeper, "group_id").join(base, "id").where("sha256 <> keeper_sha")
    reasons = [lower.select("id", F.lit(1).alias("rank"), F.lit("Lower-quality copy").alias("reason"), F.col("group_id").alias("keep"))]
    shots = burst_rows.join(base, "id")
    sharp = shots.groupBy("burst").agg(F.min_by("id", F.struct(-F.coalesce("sharpness", F.lit(0.0)), "id")).alias("keep"))
    shots = shots.join(sharp, "burst").where("id <> keep")
    reasons.append(shots.select("id", F.lit(2).alias("rank"), F.lit("Blurrier burst shot").alias("reason"), "keep"))
    none = F.lit(None).cast("string").alias("keep")
    reasons.append(base.where(F.col("sharpness") < blurry).select("id", F.lit(3).alias("rank"), F.lit("Very blurry").alias("reason"), none))
    for k, (album, said) in enumerate((("screenshots", "Screenshot"), ("memes", "Meme"), ("forwarded", "Forwarded image")), 4):
        reasons.append(auto.where(F.col("album") == album).select("id", F.lit(k).alias("rank"), F.lit(said).alias("reason"), none))
    every = reasons[0]
    for r in reasons[1:]:
        every = every.unionByName(r)
    first = every.groupBy("id").agg(F.min(F.struct("rank", "keep", "reason")).alias("r")).join(base, "id")
    counted = first.groupBy("sha256").agg(F.min(F.struct("r.rank", "id")).alias("counted"))  # the one row of a content whose bytes count
    first = first.join(counted, F.equal_null(first["sha256"], counted["sha256"])).drop(counted["sha256"])
    return first.withColumn("bytes", F.when(F.col("id") == F.col("counted.id"), F.col("size")).otherwise(0)).select("id", "r.reason", "r.keep", (F.col("r.rank") < 4).alias("ticked"), "bytes", "size")
