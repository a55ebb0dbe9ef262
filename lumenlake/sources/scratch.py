"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Tables that are still there, by path, and the scopes that are open, the innermost last.
_HELD: dict[str, SparkSession] = {}
_SCOPES: list[list[str]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of this process where that is unset, in local runs alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = _OWN.setdefault("dir", "") or tempfile.mkdtemp(prefix="spark-lumenlake-")
        _OWN["dir"] = folder
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage, survives lost executors and gives the optimiser real sizes.
    """
    return materialise_all([df], label)


def materialise_all(frames: Sequence[DataFrame], label: str) -> DataFrame:
    """One table of the rows of all frames (of one schema), written one after another: shuffle files of each are gone before the next."""
    spark = frames[0].sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _HELD[path] = spark
    if _SCOPES:
        _SCOPES[-1].append(path)
    for k, df in enumerate(frames):
        with _shuffles_go(spark):
            df.write.mode("append" if k else "errorifexists").parquet(path)
    made = spark.read.schema(frames[0].schema).parquet(path)
    made.scratch = path
    return made


def cut(df: DataFrame, slices: int, *keys: Column | str) -> list[DataFrame]:
    """All rows of df in so many frames, by a hash of the keys: rows of equal keys are in one frame."""
    return [df.where(F.pmod(F.xxhash64(*keys), F.lit(slices)) == k) for k in range(slices)] if slices > 1 else [df]


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it is over; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _remove(path: str) -> None:
    spark = _HELD.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialise wrote, once everything made of them is written. Others are left alone."""
    for df in tables:
        _remove(getattr(df, "__dict__", {}).get("scratch", ""))


def keep(df: DataFrame) -> DataFrame:
    """The table, taken out of the scope it was written in: its owner discards it."""
    for held in _SCOPES:
        if df.scratch in held:
            held.remove(df.scratch)
    return df


@contextmanager
def scope() -> Iterator[None]:
    """Tables that are materialised inside go at its end: for work whose results are written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(path)


@atexit.register
def clear() -> None:
    """Remove what is left: tables behind results that are read later belong to the session and end with its process."""
    for path in list(_HELD):
        with suppress(Exception):  # the session's process may be gone
            _remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
