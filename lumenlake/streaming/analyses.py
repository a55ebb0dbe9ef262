"""The stream of analysis results: like subjects and people, kept up to date batch by batch.

State is a few tables below one root, written by batch number and replaced as a whole: a batch reads lower numbers
alone, so a batch that runs again after a failure gives the same tables. Vectors are in two indexes of which a batch
reads only the leaves that its rows may meet; people change by folding labels, not by components over all faces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumenlake.functions.vectors import decode_vectors
from lumenlake.operators.subjects import carry_over_people, link_people
from lumenlake.operators.vector_index import StoredVectors
from lumenlake.sources.analyses import parse_analyses
from lumenlake.sources.scratch import materialise, scope

BUCKETS = 64
FACE = "id string, photo_id string, x double, y double, w double, h double, embedding array<float>, person_id string"


def _bucket(name: str):
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


class Analyses:
    """The tables of one root as a batch sees them."""

    def __init__(self, spark: SparkSession, root: str, number: int):
        self.spark, self.root, self.number = spark, root, number

    def write(self, df: DataFrame, name: str, by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{name}/batch_id={self.number}")

    def read(self, name: str, schema: str) -> DataFrame:
        """What lower batches wrote, with batch_id."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], f"{schema}, batch_id int")
        return self.spark.read.schema(f"{schema}, batch_id int").parquet(f"{self.root}/{name}").where(F.col("batch_id") < self.number)

    def bucketed(self, name: str, schema: str, ids: DataFrame) -> DataFrame:
        """Rows of the buckets that the ids (id) fall into: the folders of the others are not read."""
        buckets = [r["bucket"] for r in ids.select(_bucket("id").alias("bucket")).distinct().collect()]
        return self.read(name, f"{schema}, bucket int").where(F.col("bucket").isin(buckets)).drop("bucket")

    def folds(self) -> DataFrame:
        return self.read("folds", "person_id string, keep string").drop("batch_id")

    def resolved(self, persons: DataFrame) -> DataFrame:
        """person, now: the person that each of the given ones (person) has been folded into, through any number of folds."""
        folds, now = self.folds(), persons.where("person is not null").select("person", F.col("person").alias("now")).distinct()
        while True:
            now = materialise(now.join(folds, F.col("now") == F.col("person_id"), "left").select("person", F.coalesce("keep", "now").alias("now"), F.col("keep").isNotNull().alias("moved")), "resolved")
            if now.where("moved").isEmpty():
                return now.select("person", "now")
            now = now.select("person", "now")

    def replaced(self) -> DataFrame:
        return self.read("replaced", "id string").groupBy("id").agg(F.max("batch_id").alias("again"))


def _current(rows: DataFrame, replaced: DataFrame, id_: str, batch: str) -> DataFrame:
    """Rows whose photo has not been analysed again since."""
    again = replaced.select(F.col("id").alias("_id"), "again")
    return rows.join(again, (F.col(id_) == F.col("_id")) & (F.col(batch) < F.col("again")), "left_anti")


def _subjects(at: Analyses, good: DataFrame, replaced: DataFrame, matches: DataFrame | None, t: float, again: bool) -> None:
    """New pairs of like subject, as subject_pairs gives them, and the photos' vectors into their index."""
    index = StoredVectors(at.spark, f"{at.root}/photo_vectors", {"uploaded_at": "string", "faced": "boolean", "batch": "int"})
    rows = good.select(F.col("id").alias("key"), F.col("id").alias("g"), F.col("clip").alias("v"), "uploaded_at", (F.size("faces") > 0).alias("faced"), F.lit(at.number).alias("batch"))
    index.open(rows, at.number)
    near = _current(index.meet(rows, t), replaced, "b", "batch")
    mine = rows.select(F.col("key").alias("a"), F.col("uploaded_at").alias("at_a"), F.col("faced").alias("faced_a"))
    near = near.join(mine, "a").where("not (faced_a and faced)")
    ends = near.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "a", "b", "at_a", "uploaded_at", "similarity")
    known = matches.select("photo_a", "photo_b") if matches is not None else None
    if again:  # only a photo that was there before can have such a pair already
        own = at.read("subjects", "photo_a string, photo_b string").select("photo_a", "photo_b")
        known = own if known is None else known.unionByName(own)
    if known is not None:
        ends = ends.join(known.select(F.least("photo_a", "photo_b").alias("low"), F.greatest("photo_a", "photo_b").alias("high")), ["low", "high"], "left_anti")
    newer = F.struct("at_a", "a") > F.struct("uploaded_at", "b")
    one, two = F.when(newer, F.col("a")).otherwise(F.col("b")), F.when(newer, F.col("b")).otherwise(F.col("a"))
    at.write(ends.select(one.alias("photo_a"), two.alias("photo_b"), F.lit("subject").alias("kind"), F.round(F.least("similarity", F.lit(0.99)), 3).alias("similarity")), "subjects")
    index.add()


def _faces(good: DataFrame, number: int) -> DataFrame:
    """id, photo_id, box and embedding of every face of the batch; the id holds the batch, so a face of a later analysis is another."""
    face = good.select(F.col("id").alias("photo_id"), F.posexplode("faces").alias("pos", "f"))
    face = decode_vectors(face.withColumn("embedding", F.unbase64("f.embedding")), "embedding")
    boxes = [F.col("f.box")[k].alias(c) for k, c in enumerate("xywh")]
    return face.select(F.concat_ws(":", "photo_id", F.lit(number), "pos").alias("id"), "photo_id", *boxes, "embedding")


def _people(at: Analyses, good: DataFrame, replaced: DataFrame, people: DataFrame | None, t: float, same: float, again: DataFrame) -> None:
    """A person for every face of the batch, and the persons that it shows to be one."""
    faces = materialise(_faces(good, at.number), "analysis-faces")
    index = StoredVectors(at.spark, f"{at.root}/face_vectors", {"photo": "string", "person": "string", "batch": "int"})
    rows = faces.select(F.col("id").alias("key"), F.col("photo_id").alias("g"), F.col("embedding").alias("v"), F.col("photo_id").alias("photo"), F.lit(None).cast("string").alias("person"), F.lit(at.number).alias("batch"))
    index.open(rows, at.number)
    # people made by hand and faces that go or keep a person take single pairs out; else the groups are all that counts
    plain = people is None and replaced.isEmpty()
    near = materialise(_current(index.meet(rows, t, label="person" if plain else None), replaced, "photo", "batch"), "face-pairs")
    old = at.bucketed("faces", FACE, again).join(again.withColumnRenamed("id", "photo_id"), "photo_id", "left_semi")
    last = old.groupBy("photo_id").agg(F.max("batch_id").alias("batch_id"))  # the analysis before this one
    old = materialise(old.join(last, ["photo_id", "batch_id"]), "faces-before")
    now = at.resolved(near.select("person").unionByName(old.select(F.col("person_id").alias("person"))))
    old = old.join(now.withColumnRenamed("person", "person_id"), "person_id").withColumn("person_id", F.col("now"))
    kept = materialise(carry_over_people(faces, old, same), "faces-kept")
    near = near.join(now, "person", "left").withColumn("person", F.coalesce("now", "person")).select("a", "b", "similarity", "fresh", "person")
    both = near.where("not fresh").unionByName(near.where("fresh")).unionByName(near.where("fresh").select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity", "fresh", "person"))
    both = both.join(kept.select(F.col("id").alias("b"), F.col("person_id").alias("kept")), "b", "left").withColumn("person", F.coalesce("kept", "person"))
    both = materialise(both.join(kept.select(F.col("id").alias("a")), "a", "left_anti").select("a", "b", "person", "similarity"), "face-links")
    named = both.where("person is not null").select(F.col("person").alias("id")).distinct()
    given = people.select("id", "name", "manual") if people is not None else at.spark.createDataFrame([], "id string, name string, manual boolean")
    own, folded = link_people(both, faces.select("id").join(kept.select("id"), "id", "left_anti"), named.join(given, "id", "left"))
    own = materialise(own.unionByName(kept.select("id", "person_id")), "faces-people")
    at.write(folded, "folds")
    at.write(faces.join(own, "id").withColumn("bucket", _bucket("photo_id")), "faces", "bucket")
    index.add(joined=faces.join(own, "id").select(F.col("id").alias("key"), F.col("photo_id").alias("photo"), F.col("person_id").alias("person"), F.lit(at.number).alias("batch")))


def stream_analyses(stream: DataFrame, root: str, version: int = 6, size: int = 512, face_size: int = 128, people: DataFrame | None = None, matches: DataFrame | None = None, subject: float = 0.82, person: float = 0.363, same: float = 0.9) -> DataStreamWriter:
    """Analysis results (id, json and perhaps uploaded_at) into root/analyses, bad ones into root/rejects; pairs of like
    subject into root/subjects; faces with their people into root/faces, and people found to be one into root/folds.

    After any number of batches in any order the pairs are those of subject_pairs over all photos and the groups of
    faces those of assign_people over all faces (see current_faces). people (id, name, manual): given people; matches: pairs
    that are known. A photo that is analysed again gives up its old vector and faces; a face nearer than `same` to
    its best old one keeps that person. Of several good results of one photo in a batch the last in JSON order counts.
    """

    def add(batch: DataFrame, number: int) -> None:
        at = Analyses(batch.sparkSession, root, number)
        with scope():
            rows = materialise(batch, "analyses")
            good, bad = parse_analyses(rows, version, size, face_size)
            at.write(bad, "rejects")
            cols = F.struct(*[c for c in good.columns if c != "id"])
            good = good.groupBy("id").agg(F.max_by(cols, F.to_json(cols)).alias("r")).select("id", "r.*")
            uploaded = rows.groupBy("id").agg(F.max("uploaded_at" if "uploaded_at" in rows.columns else F.lit(None).cast("string")).alias("uploaded_at"))
            good = materialise(good, "analyses-good")
            at.write(good, "analyses")
            good = good.join(uploaded, "id")
            ids = good.select("id")
            again = materialise(at.bucketed("seen", "id string", ids).select("id").distinct().join(ids, "id"), "analysed-again")
            at.write(again, "replaced")
            replaced = materialise(at.replaced().unionByName(again.select("id", F.lit(number).alias("again"))).groupBy("id").agg(F.max("again").alias("again")), "replaced")
            _subjects(at, good, replaced, matches, subject, not again.isEmpty())
            _people(at, good, replaced, people, person, same, again)
            at.write(ids.withColumn("bucket", _bucket("id")), "seen", "bucket")

    return stream.writeStream.foreachBatch(add)


def current_faces(spark: SparkSession, root: str, before: int = 1 << 30) -> DataFrame:
    """The faces of the last analysis of each photo, with the person that each belongs to by now."""
    at = Analyses(spark, root, before)
    faces = _current(at.read("faces", f"{FACE}, bucket int").drop("bucket"), at.replaced(), "photo_id", "batch_id")
    now = at.resolved(faces.select(F.col("person_id").alias("person")))
    return faces.join(now.withColumnRenamed("person", "person_id"), "person_id").withColumn("person_id", F.col("now")).drop("now", "batch_id")


def latest_analyses(spark: SparkSession, root: str) -> DataFrame:
    """The last result of each photo, to be laid over the catalogue with apply_analyses."""
    df = spark.read.parquet(f"{root}/analyses")
    rest = [c for c in df.columns if c not in ("id", "batch_id")]
    return df.groupBy("id").agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select("id", "r.*")
