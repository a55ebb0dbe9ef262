"""Analysis results as JSON text: checked, typed, bad rows kept apart with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.text import squeeze, text_of
from lumenlake.functions.vectors import decode_vectors

BOX = "array<double>"
SCHEMA = (
    f"version int, clip string, faces array<struct<box:{BOX},embedding:string>>, taken_at string, sharpness double, "
    f"words array<struct<text:string,box:{BOX},line:int>>, flatness double, jpeg_quality double, camera boolean, qr_codes array<struct<text:string,box:{BOX}>>, core_hash string, _broken string"
)


def _box_ok(b: Column) -> Column:
    return F.coalesce((F.size(b) == 4) & F.forall(b, lambda x: F.coalesce((x >= 0) & (x <= 1), F.lit(False))), F.lit(False))


def parse_analyses(df: DataFrame, version: int = 6, size: int = 512, face_size: int = 128, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(good, bad) of rows (id, json).

    good: id, clip, faces, taken_at, sharpness, ocr_text, ocr_words, ocr_search, flatness, jpeg_quality, camera,
    qr_codes, core_hash, ai_version, ai_status. The first 500 words (cut to 100 characters, empty ones dropped after
    that) and 20 codes (2000 characters) count; flatness is held in 0..1, quality in 1..100. bad: the row and its reason:
    no JSON, another version, a vector of the wrong length or not finite, a box that is not four fractions, a bad core hash.
    """
    row = df.withColumn("_a", F.from_json(F.col(json), SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    a = F.col("_a")
    words = F.filter(F.slice(F.coalesce(a["words"], F.array()), 1, 500), lambda w: F.coalesce(w["text"], F.lit("")) != "")
    words = F.transform(words, lambda w: F.struct(F.substring(w["text"], 1, 100).alias("text"), w["box"].alias("box"), F.coalesce(w["line"], F.lit(0)).alias("line")))
    codes = F.transform(F.slice(F.coalesce(a["qr_codes"], F.array()), 1, 20), lambda q: F.struct(F.substring(q["text"], 1, 2000).alias("text"), q["box"].alias("box")))
    row = row.withColumn("_words", words).withColumn("_codes", codes)
    row = decode_vectors(row.withColumn("_clip", F.try_to_binary(a["clip"], F.lit("base64"))), "_clip")
    finite = lambda v, n: F.coalesce((F.size(v) == n) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    faces = F.coalesce(a["faces"], F.array())
    boxes = F.concat(F.transform(faces, lambda f: f["box"]), F.transform("_words", lambda w: w["box"]), F.transform("_codes", lambda q: q["box"]))
    core = F.coalesce(a["core_hash"], F.lit(""))
    long_faces = F.forall(faces, lambda f: F.coalesce(F.length(F.try_to_binary(f["embedding"], F.lit("base64"))) == 4 * face_size, F.lit(False)))
    reason = (
        F.when(a.isNull() | a["_broken"].isNotNull(), "json")
        .when(~F.coalesce(a["version"] == version, F.lit(False)), "version")
        .when(~finite(F.col("_clip"), size) | ~long_faces, "vector")
        .when(~F.forall(boxes, _box_ok), "box")
        .when((core != "") & ~core.rlike("^[0-9a-f]{16}$"), "core_hash")
    )
    row = row.withColumn("reason", reason)
    text = text_of(F.col("_words"))
    good = row.where("reason is null").select(
        "id",
        F.col("_clip").alias("clip"),
        faces.alias("faces"),
        a["taken_at"].alias("taken_at"),
        F.coalesce(a["sharpness"], F.lit(0.0)).alias("sharpness"),
        text.alias("ocr_text"),
        F.col("_words").alias("ocr_words"),
        squeeze(F.array_join(F.concat(F.array(text), F.transform("_codes", lambda q: q["text"])), " ")).alias("ocr_search"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(a["flatness"], F.lit(0.0)))).alias("flatness"),
        F.greatest(F.lit(1), F.least(F.lit(100), a["jpeg_quality"].cast("int"))).alias("_q"),
        F.coalesce(a["camera"], F.lit(False)).alias("camera"),
        F.when(F.size("_codes") > 0, F.col("_codes")).alias("qr_codes"),
        F.when(core != "", core).alias("core_hash"),
        a["version"].alias("ai_version"),
        F.lit("done").alias("ai_status"),
        a["jpeg_quality"].isNull().alias("_none"),
    )
    good = good.withColumn("jpeg_quality", F.when(~F.col("_none"), F.col("_q"))).drop("_q", "_none")
    return good, row.where("reason is not null").select(*df.columns, "reason")
