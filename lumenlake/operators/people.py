"""People, their faces and albums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_people(people: DataFrame, faces: DataFrame) -> DataFrame:
    """id, name, photos: people on two photos or more, or made by hand."""
    n = faces.groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("photo_id").alias("photos"))
    return people.join(n, "id").where((F.col("photos") >= 2) | F.coalesce("manual", F.lit(False))).select("id", "name", "photos")


def cover_faces(faces: DataFrame) -> DataFrame:
    """The largest face of each person; on ties the smallest id."""
    return faces.where("person_id is not null").groupBy("person_id").agg(F.min_by("id", F.struct(-(F.col("w") * F.col("h")), "id")).alias("face_id"))


def person_photos(faces: DataFrame, photos: DataFrame, person: str | None = None) -> DataFrame:
    """person_id, photo id, uploaded_at and the focus: the centre of the person's last face there."""
    own = faces.where("person_id is not null") if person is None else faces.where(F.col("person_id") == person)
    last = own.groupBy("person_id", "photo_id").agg(F.max_by(F.struct("x", "y", "w", "h"), "id").alias("f"))
    focus = [F.round(F.col("f.x") + F.col("f.w") / 2, 3).alias("focus_x"), F.round(F.col("f.y") + F.col("f.h") / 2, 3).alias("focus_y")]
    return last.join(photos.select(F.col("id").alias("photo_id"), "uploaded_at"), "photo_id").select("person_id", "photo_id", "uploaded_at", *focus)


def person_details(people: DataFrame, faces: DataFrame, photos: DataFrame, person: str | None = None) -> DataFrame:
    """id, name, cover face, photos (newest first, with the focus on the person) and faces of each person, or of one.

    A person's photos and faces are one row: those of one person are few beside all photos.
    """
    shown = person_photos(faces, photos, person).groupBy(F.col("person_id").alias("id"))
    shown = shown.agg(F.reverse(F.array_sort(F.collect_list(F.struct("uploaded_at", "photo_id", "focus_x", "focus_y")))).alias("photos"))
    own = faces.where("person_id is not null") if person is None else faces.where(F.col("person_id") == person)
    seen = own.groupBy(F.col("person_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("face_id"), "photo_id", "x", "y", "w", "h"))).alias("faces"))
    cover = cover_faces(own).select(F.col("person_id").alias("id"), F.col("face_id").alias("cover"))
    chosen = people if person is None else people.where(F.col("id") == person)
    return chosen.select("id", "name").join(cover, "id", "left").join(shown, "id", "left").join(seen, "id", "left")


def merge_people(people: DataFrame, faces: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """One person of the given ones: the first named by creation, else the oldest; it counts as made by hand."""
    chosen = people.where(F.col("id").isin(*ids))
    keep = F.broadcast(chosen.agg(F.min_by("id", F.struct(F.col("name").isNull(), "created_at", "id")).alias("keep")))  # one row
    faces = faces.crossJoin(keep).withColumn("person_id", F.when(F.col("person_id").isin(*ids), F.coalesce("keep", "person_id")).otherwise(F.col("person_id"))).drop("keep")
    people = people.crossJoin(keep).where(~F.col("id").isin(*ids) | (F.col("id") == F.col("keep")))
    return people.withColumn("manual", F.when(F.col("id") == F.col("keep"), True).otherwise(F.col("manual"))).drop("keep"), faces


def split_person(people: DataFrame, faces: DataFrame, person: str, face_ids: list[str], new_id: str, created_at: str) -> tuple[DataFrame, DataFrame]:
    """The chosen faces of a person become a new one; both count as made by hand; a person without faces goes."""
    move = (F.col("person_id") == person) & F.col("id").isin(*face_ids)
    moved = faces.withColumn("person_id", F.when(move, F.lit(new_id)).otherwise(F.col("person_id")))
    marked = people.withColumn("manual", F.when(F.col("id") == person, True).otherwise(F.col("manual")))
    new = people.sparkSession.createDataFrame([(new_id, None, created_at, True)], "id string, name string, created_at string, manual boolean")
    both = marked.unionByName(new.select(*people.columns))
    used = moved.select(F.col("person_id").alias("id")).dropna().distinct()
    gone = both.where(F.col("id").isin(person, new_id)).join(used, "id", "left_anti").select("id")
    return both.join(gone, "id", "left_anti"), moved


def list_albums(albums: DataFrame, album_photos: DataFrame, photos: DataFrame) -> DataFrame:
    """Albums with photo count, bytes and a cover (the smallest photo id); empty ones stay."""
    held = album_photos.join(photos.select(F.col("id").alias("photo_id"), "size"), "photo_id")
    n = held.groupBy("album_id").agg(F.count("*").alias("photos"), F.sum("size").alias("bytes"), F.min("photo_id").alias("cover"))
    joined = albums.join(n.withColumnRenamed("album_id", "id"), "id", "left")
    return joined.select("id", "name", F.coalesce("photos", F.lit(0)).alias("photos"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "cover")


def auto_album_summary(auto: DataFrame, photos: DataFrame) -> DataFrame:
    """auto: album, id, rank. Count, bytes, and the best ranked photo."""
    joined = auto.join(photos.select("id", "size"), "id")
    return joined.groupBy("album").agg(F.count("*").alias("photos"), F.sum("size").alias("bytes"), F.min_by("id", F.struct("rank", "id")).alias("cover"))
