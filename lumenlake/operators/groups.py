"""Groups of copies and of related photos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlake.operators.graph import FEW, connected_components
from lumenlake.operators.near_hashes import near_pairs
from lumenlake.sources.scratch import materialise


def both_ends(matches: DataFrame) -> DataFrame:
    """node, other, kind, similarity for either direction of an edge."""
    a = matches.select(F.col("photo_a").alias("node"), F.col("photo_b").alias("other"), "kind", "similarity")
    return a.unionByName(matches.select(F.col("photo_b").alias("node"), F.col("photo_a").alias("other"), "kind", "similarity"))


def of_two_or_more(member: DataFrame) -> DataFrame:
    """Rows whose component has another row."""
    return member.join(member.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi")


def duplicate_groups(photos: DataFrame, matches: DataFrame) -> DataFrame:
    """group_id (its best copy), id, place, relation, similarity, extra_bytes, sharpest, for every photo with a copy.

    Best copy: most pixels, then bytes, then the earliest upload, then id. relation is keep, exact (the
    content stands earlier in the group) or similar (with its similarity to the kept copy, else its best).
    extra_bytes: all bytes of the group but the kept copy's. sharpest: the group's clearly sharpest photo.
    Rows are ranged by group and order, so that a large group is many sorted cells; no window holds a group's rows.
    """
    edges = matches.where(F.col("kind").isin("exact", "similar"))
    member = connected_components(edges, "photo_a", "photo_b", few=FEW)
    rows = photos.join(member.withColumnRenamed("node", "id"), "id")
    order = [F.col("component"), (F.col("width").cast("long") * F.col("height")).desc(), F.col("size").desc(), F.col("uploaded_at"), F.col("id")]
    rows = rows.select("component", "id", "sha256", "size", "sharpness", "width", "height", "uploaded_at")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = materialise(rows.drop("width", "height", "uploaded_at"), "duplicate-groups").withColumn("cell", F.shiftright("at", 33))
    # a place is the distance from the group's first row in the row's own sorted cell, and the group's rows in cells before
    starts = rows.groupBy("component", "cell").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("component").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("component", "cell", (F.coalesce(earlier, F.lit(0)) + 1 - F.col("start")).alias("shift"))
    clear = F.when(F.col("sharpness") > 0, F.col("sharpness"))
    facts = rows.groupBy("component").agg(
        F.min_by("id", "at").alias("group_id"),
        (F.sum("size") - F.min_by("size", "at")).alias("extra_bytes"),
        F.when((F.count(clear) >= 2) & (F.max(clear) >= 1.15 * F.min(clear)), F.max_by("id", F.struct(F.coalesce(clear, F.lit(-1.0)), -F.col("at")))).alias("clearest"),
    )
    first = rows.groupBy("component", "sha256").agg(F.min_by("id", "at").alias("id")).select("id", F.lit(False).alias("again"))
    facts = materialise(facts, "duplicate-facts")
    kept = rows.select(F.col("id").alias("node"), "component").join(facts.select("component", "group_id"), "component").drop("component")
    direct = F.when(F.col("other") == F.col("group_id"), F.col("similarity"))
    links = both_ends(edges).join(kept, "node").groupBy(F.col("node").alias("id")).agg(F.max("similarity").alias("best"), F.max(direct).alias("direct"))
    rows = rows.join(starts, ["component", "cell"]).withColumn("place", F.col("at") + F.col("shift")).join(facts, "component")
    rows = rows.join(first, "id", "left").join(links, "id", "left").withColumn("again", F.coalesce("again", F.lit(True)))
    relation = F.when(F.col("place") == 1, "keep").when(F.col("again"), "exact").otherwise("similar")
    similarity = F.when((F.col("place") == 1) | F.col("again"), 1.0).otherwise(F.coalesce("direct", "best"))
    return rows.select("group_id", "id", F.col("place").cast("long").alias("place"), relation.alias("relation"), similarity.alias("similarity"), "extra_bytes", F.coalesce(F.col("id") == F.col("clearest"), F.lit(False)).alias("sharpest"))


def duplicate_summary(groups: DataFrame, photos: DataFrame) -> DataFrame:
    """Number of groups, bytes to free, exact copies that can go."""
    per = groups.join(photos.select("id", "sha256"), "id").groupBy("group_id").agg(F.max("extra_bytes").alias("extra"), (F.count("*") - F.count_distinct("sha256")).alias("copies"))
    return per.agg(F.count("*").alias("groups"), F.coalesce(F.sum("extra"), F.lit(0)).alias("extra_bytes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("removable"))


def exact_copies_to_remove(photos: DataFrame) -> DataFrame:
    """Every upload of a content but the first."""
    first = photos.groupBy("sha256").agg(F.min(F.struct("uploaded_at", "id")).alias("first"))
    return photos.select("id", "sha256", "size", "uploaded_at").join(first, "sha256").where(F.struct("uploaded_at", "id") > F.col("first")).select("id", "sha256", "size")


def related_groups(photos: DataFrame, matches: DataFrame, bursts: DataFrame) -> DataFrame:
    """component, id, similarity: groups by `subject` edges; photos of bursts leave after grouping, groups of one go."""
    edges = matches.where("kind = 'subject'")
    member = connected_components(edges, "photo_a", "photo_b", few=FEW).withColumnRenamed("node", "id")
    member = member.join(bursts.select("id").distinct(), "id", "left_anti").join(photos.select("id"), "id", "left_semi")
    best = both_ends(edges).groupBy("node").agg(F.max("similarity").alias("similarity")).withColumnRenamed("node", "id")
    member = of_two_or_more(member)
    return member.join(best, "id").select("component", "id", "similarity")


def meme_groups(photos: DataFrame, memes: DataFrame, distance: int = 10) -> DataFrame:
    """component, id: memes whose core hashes are near, in groups of two or more; equal hashes are one node."""
    own = photos.join(memes.select("id").distinct(), "id", "left_semi").where("core_hash is not null").select("id", F.col("core_hash").alias("h"))
    near = near_pairs(own.select("h").distinct(), distance)
    member = own.join(connected_components(near, few=FEW).withColumnRenamed("node", "h"), "h", "left")
    member = member.select("id", F.coalesce("component", "h").alias("component"))
    return of_two_or_more(member)
