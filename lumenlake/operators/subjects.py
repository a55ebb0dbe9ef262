"""Same subject, same person: pairs and people from vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.vectors import dot
from lumenlake.operators.graph import FEW, connected_components
from lumenlake.operators.vector_index import close_pairs


def subject_pairs(photos: DataFrame, faces: DataFrame, matches: DataFrame, t: float = 0.82) -> DataFrame:
    """photo_a (newer), photo_b, kind, similarity: photos (id, clip, uploaded_at) of like content, not matched yet, not both with faces."""
    near = close_pairs(photos.select("id", "clip"), t, vector="clip")
    known = matches.select(F.least("photo_a", "photo_b").alias("a"), F.greatest("photo_a", "photo_b").alias("b"))
    faced = faces.select(F.col("photo_id").alias("id"), F.lit(True).alias("faced")).distinct()
    side = photos.select("id", "uploaded_at").join(faced, "id", "left")
    out = near.join(known, ["a", "b"], "left_anti")
    for end in "ab":
        out = out.join(side.select(F.col("id").alias(end), F.col("uploaded_at").alias(f"at_{end}"), F.coalesce("faced", F.lit(False)).alias(f"faced_{end}")), end)
    out = out.where("not (faced_a and faced_b)")
    newer = F.struct("at_a", "a") > F.struct("at_b", "b")
    return out.select(F.when(newer, F.col("a")).otherwise(F.col("b")).alias("photo_a"), F.when(newer, F.col("b")).otherwise(F.col("a")).alias("photo_b"), F.lit("subject").alias("kind"), F.round(F.least("similarity", F.lit(0.99)), 3).alias("similarity"))


def carry_over_people(new_faces: DataFrame, old_faces: DataFrame, t: float = 0.9) -> DataFrame:
    """id, person_id of new faces whose best old face of the same photo is nearer than t and has a person; on ties the smallest old id."""
    old = old_faces.select("photo_id", F.col("id").alias("old"), "person_id", F.col("embedding").alias("e"))
    pair = new_faces.select("id", "photo_id", "embedding").join(old, "photo_id").withColumn("s", dot(F.col("embedding"), F.col("e")))
    best = pair.groupBy("id").agg(F.min_by(F.struct("person_id", "s"), F.struct(-F.col("s"), "old")).alias("b"))
    return best.where((F.col("b.s") > t) & F.col("b.person_id").isNotNull()).select("id", "b.person_id")


def assign_people(new_faces: DataFrame, known_faces: DataFrame, people: DataFrame, t: float = 0.363) -> DataFrame:
    """id, person_id for every new face, and for every known face whose person was folded into another.

    One batch at once: faces (id, photo_id, embedding) of one photo are never compared. A face near a person
    made by hand takes its closest person and folds nothing. Else near faces and persons become one person:
    the best fitting named one, else the best fitting, else a new one with the smallest face id.
    """
    rows = new_faces.select("id", "photo_id", "embedding", F.lit(None).cast("string").alias("person")).unionByName(known_faces.where("person_id is not null").select("id", "photo_id", "embedding", F.col("person_id").alias("person")))
    near = close_pairs(rows, t, vector="embedding", group="photo_id")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    of = rows.select("id", "person")
    both = both.join(of.where("person is null").select(F.col("id").alias("a")), "a", "left_semi").join(of.withColumnRenamed("id", "b"), "b")
    own, folded = link_people(both, new_faces.select("id"), people)
    moved = known_faces.join(folded, "person_id").select("id", F.col("keep").alias("person_id"))
    return own.unionByName(moved)


def link_people(both: DataFrame, new_faces: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, person_id) of every new face (id), and (person_id, keep) of persons that are folded into another.

    both: a (a new face), b (a new face, then with the pair (b, a) too, or a known one), person (of b; null for a new
    face), similarity. people: id, name, manual. Only the faces and persons of these pairs are looked at.
    """
    score = both.where("person is not null").groupBy("a", "person").agg(F.max("similarity").alias("s"))
    score = score.join(people.select(F.col("id").alias("person"), "name", F.coalesce("manual", F.lit(False)).alias("manual")), "person")
    held = score.groupBy("a").agg(F.max("manual").alias("manual"), F.min_by("person", F.struct(-F.col("s"), "person")).alias("closest"))
    fixed = held.where("manual").select(F.col("a").alias("id"), F.col("closest").alias("person_id"))
    free = score.join(fixed.withColumnRenamed("id", "a"), "a", "left_anti")
    face = both.where("person is null").join(fixed.select(F.col("id").alias("a")), "a", "left_anti").join(fixed.select(F.col("id").alias("b")), "b", "left_anti")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    edges = free.select(node("f", F.col("a")).alias("a"), node("p", F.col("person")).alias("b")).unionByName(face.select(node("f", F.col("a")).alias("a"), node("f", F.col("b")).alias("b")))
    member = connected_components(edges, few=FEW)
    best = free.select(node("f", F.col("a")).alias("node"), "person", "s", "name").join(member, "node")
    best = best.groupBy("component").agg(F.min_by("person", F.struct(F.col("name").isNull(), -F.col("s"), "person")).alias("keep"))
    named = member.join(best, "component", "left")
    own = new_faces.select("id").join(fixed.select("id"), "id", "left_anti").join(named.select(F.substring("node", 3, 1 << 30).alias("id"), "component", "keep").where("node like 'f:%'"), "id", "left")
    fresh = own.select("id", F.coalesce("keep", F.concat(F.lit("new-"), F.coalesce(F.substring("component", 3, 1 << 30), "id"))).alias("person_id"))
    folded = named.where("node like 'p:%' and keep is not null").select(F.substring("node", 3, 1 << 30).alias("person_id"), "keep").where("person_id <> keep")
    return fixed.unionByName(fresh), folded
