"""Browsing and keeping the catalogue: filters, pages, details, deletions, actions, analysis results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.entities import with_entities
from lumenlake.functions.text import squeeze
from lumenlake.operators.groups import both_ends

SORTS = {
    "newest": ["uploaded_at desc"],
    "oldest": ["uploaded_at"],
    "name": ["lower(filename)"],
    "largest": ["size desc"],
    "smallest": ["size"],
    "taken_new": ["coalesce(taken_at, uploaded_at) desc"],
    "taken_old": ["coalesce(taken_at, uploaded_at)"],
}
PUBLIC_DROPPED = ("phash", "dhash", "clip", "ai_worker", "ocr_search", "core_hash", "flatness")


def photo_date() -> Column:
    return F.substring(F.coalesce("taken_at", "uploaded_at"), 1, 10)


def search_photos(photos: DataFrame, q: str) -> DataFrame:
    """Name or written text holds q; % and _ in q are wildcards."""
    low = q.lower()
    pattern = F.concat(F.lit("%"), F.when(squeeze(F.lit(q)) == "", F.lit(low)).otherwise(squeeze(F.lit(q))), F.lit("%"))
    return photos.where(F.lower("filename").like(f"%{low}%") | F.like(F.col("ocr_search"), pattern))


def matched_ids(matches: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    kept = matches.where(F.col("kind").isin(*kinds))
    return kept.select(F.col("photo_a").alias("id")).union(kept.select("photo_b")).distinct()


def filter_photos(photos: DataFrame, matches: DataFrame, kind: str) -> DataFrame:
    if kind == "duplicates":
        return photos.join(matched_ids(matches, ("exact", "similar")), "id", "left_semi")
    if kind == "text":
        return photos.where("ocr_search is not null and ocr_search <> ''")
    return photos.where("favorite") if kind == "favorites" else photos


def date_range(photos: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Inclusive on the photo date; bounds that are not YYYY-MM-DD are ignored."""
    import re

    for bound, keep in ((start, photo_date() >= F.lit(start)), (end, photo_date() <= F.lit(end))):
        if bound and re.fullmatch(r"\d{4}-\d{2}-\d{2}", bound):
            photos = photos.where(keep)
    return photos


def in_album(photos: DataFrame, album_photos: DataFrame, album: str) -> DataFrame:
    return photos.join(album_photos.where(F.col("album_id") == album).select(F.col("photo_id").alias("id")), "id", "left_semi")


def sort_photos(photos: DataFrame, key: str) -> DataFrame:
    return photos.orderBy(*[F.expr(k.removesuffix(" desc")).desc() if k.endswith(" desc") else F.expr(k) for k in SORTS.get(key, SORTS["newest"])], "id")


def page(df: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return df.offset(max(0, offset)).limit(min(200, max(1, limit)))


def list_photos(photos: DataFrame, matches: DataFrame, album_photos: DataFrame, q="", kind="", start=None, end=None, album=None, sort="newest", offset=0, limit=50):
    """(total, page) of a browse request."""
    found = filter_photos(search_photos(photos, q) if q else photos, matches, kind)
    found = date_range(found, start, end)
    found = in_album(found, album_photos, album) if album else found
    return found.agg(F.count("*").alias("total")), page(sort_photos(found, sort), offset, limit)


def with_match_badge(photos: DataFrame, matches: DataFrame) -> DataFrame:
    ends = both_ends(matches.where("kind in ('exact', 'similar')")).groupBy("node").agg(F.max(F.col("kind") == "exact").alias("exact"))
    joined = photos.join(ends.withColumnRenamed("node", "id"), "id", "left")
    return joined.withColumn("match", F.when(F.col("exact"), "exact").when(~F.col("exact"), "similar")).drop("exact")


def public_columns(photos: DataFrame) -> DataFrame:
    url = lambda kind: F.concat(F.lit("/api/photos/"), F.col("id"), F.lit(f"/{kind}"))
    return photos.drop(*PUBLIC_DROPPED).withColumn("url", url("file")).withColumn("thumb_url", url("thumb"))


def pending_analysis(photos: DataFrame, version: int = 6) -> DataFrame:
    """Never analysed, or done or failed with no or an older version."""
    old = F.col("ai_status").isin("done", "failed") & (F.col("ai_version").isNull() | (F.col("ai_version") < version))
    return photos.where(F.col("ai_status").isNull() | old)


def stats(photos: DataFrame, matches: DataFrame, people: DataFrame) -> DataFrame:
    """One row of dashboard numbers; people: the listed ones."""
    files = photos.groupBy("sha256").agg(F.max("size").alias("size"), F.count("*").alias("n"), F.sum("size").alias("all"))
    one = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("photos"), F.coalesce(F.sum("all"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("stored_bytes"), F.count("*").alias("unique"))
    one = one.withColumn("saved_bytes", F.col("total_bytes") - F.col("stored_bytes")).withColumn("exact_copies", F.col("photos") - F.col("unique")).drop("unique")
    similar = matches.where("kind = 'similar'").agg(F.count("*").alias("similar_pairs"))
    return one.crossJoin(similar).crossJoin(people.agg(F.count("*").alias("people")))  # one row each


def recent(photos: DataFrame, n: int = 10) -> DataFrame:
    return photos.orderBy(F.col("uploaded_at").desc(), "id").limit(n)


def analysis_status(photos: DataFrame) -> DataFrame:
    """Photos by status; those being processed still wait."""
    status = F.coalesce("ai_status", F.lit("waiting"))
    return photos.groupBy(F.when(status == "processing", "waiting").otherwise(status).alias("status")).agg(F.count("*").alias("n"))


def photo_details(photos: DataFrame, matches: DataFrame, faces: DataFrame, people: DataFrame, albums: DataFrame, album_photos: DataFrame, receipts: DataFrame | None = None) -> DataFrame:
    """id, matches (best first), people (faces from left to right, with the person's photo count), albums (by name, then id), text,
    found (entities of the text), qr_codes, words, receipt: all that is shown of each photo.

    photos: id and, where known, ocr_text, qr_codes, ocr_words. receipts: id and what all_receipts gives. Every part is brought
    to one layout, a column for each, and one grouping by photo puts them together. A photo's lists are one row.
    """
    held = {c: F.col(c) if c in photos.columns else F.lit(None).cast(kind) for c, kind in (("ocr_text", "string"), ("qr_codes", "array<struct<text:string,box:array<double>>>"), ("ocr_words", "array<struct<text:string,box:array<double>,line:int>>"))}
    own = photos.select("id", F.coalesce(held["ocr_text"], F.lit("")).alias("text"), held["qr_codes"].alias("qr_codes"), held["ocr_words"].alias("words"))
    own = with_entities(own, "text", "found").select("id", F.struct("text", "found", F.coalesce("qr_codes", F.array()).alias("qr_codes"), F.coalesce("words", F.array()).alias("words")).alias("own"))
    match = both_ends(matches).select(F.col("node").alias("id"), F.struct((-F.col("similarity")).alias("order"), F.col("other").alias("id"), "kind", "similarity").alias("match"))
    counts = faces.where("person_id is not null").groupBy("person_id").agg(F.count_distinct("photo_id").alias("photos"))
    face = faces.join(people.select(F.col("id").alias("person_id"), "name"), "person_id", "left").join(counts, "person_id", "left")
    face = face.select(F.col("photo_id").alias("id"), F.struct("x", F.col("id").alias("face_id"), "person_id", "name", "y", "w", "h", F.coalesce("photos", F.lit(0)).alias("photos")).alias("face"))
    album = album_photos.join(albums.select(F.col("id").alias("album_id"), "name"), "album_id").select(F.col("photo_id").alias("id"), F.struct("name", F.col("album_id").alias("id")).alias("album"))
    parts = own.unionByName(match, True).unionByName(face, True).unionByName(album, True)
    if receipts is not None:
        parts = parts.unionByName(receipts.select("id", F.struct(*[c for c in receipts.columns if c != "id"]).alias("receipt")), True)
    listed = lambda c: F.array_sort(F.collect_list(c)).alias(c)
    made = parts.groupBy("id").agg(F.first("own", True).alias("own"), listed("match"), listed("face"), listed("album"), *([F.first("receipt", True).alias("receipt")] if receipts is not None else []))
    shown = [F.transform("match", lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"), x["similarity"].alias("similarity"))).alias("matches"), F.col("face").alias("people"), F.transform("album", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("albums")]
    return made.where("own is not null").select("id", *shown, "own.*", *(["receipt"] if receipts is not None else []))


def delete_photos(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables photos, faces, matches, album_photos and people without the given ids, and the files that nothing uses any more."""
    gone = ids.select("id").dropna().distinct()
    out = dict(tables)
    out["photos"] = tables["photos"].join(gone, "id", "left_anti")
    for name in ("faces", "album_photos"):
        out[name] = tables[name].join(gone.withColumnRenamed("id", "photo_id"), "photo_id", "left_anti")
    left = tables["matches"].join(gone.withColumnRenamed("id", "photo_a"), "photo_a", "left_anti")
    out["matches"] = left.join(gone.withColumnRenamed("id", "photo_b"), "photo_b", "left_anti").select(*tables["matches"].columns)
    lost = tables["faces"].join(gone.withColumnRenamed("id", "photo_id"), "photo_id", "left_semi")
    touched = lost.select(F.col("person_id").alias("id")).dropna().distinct()
    empty = touched.join(out["faces"].select(F.col("person_id").alias("id")), "id", "left_anti")
    out["people"] = tables["people"].join(empty, "id", "left_anti")
    files = tables["photos"].join(gone, "id", "left_semi").select("sha256").distinct().join(out["photos"].select("sha256"), "sha256", "left_anti")
    keys = files.select(F.explode(F.array(F.concat(F.lit("originals/"), "sha256"), F.concat(F.lit("thumbnails/"), "sha256", F.lit(".jpg")))).alias("key"))
    return out, keys.unionByName(lost.select(F.concat(F.lit("faces/"), "id", F.lit(".jpg")).alias("key")))


def apply_actions(photos: DataFrame, album_photos: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """actions: moment, action, photo_id, album_id. The last favourite or album action of a pair holds; unknown photos are ignored."""
    known = actions.join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    fav = known.where("action in ('favorite', 'unfavorite')").groupBy(F.col("photo_id").alias("id")).agg(F.max_by(F.col("action") == "favorite", "moment").alias("_f"))
    photos = photos.join(fav, "id", "left").withColumn("favorite", F.coalesce("_f", "favorite")).drop("_f")
    last = known.where("action in ('add_to_album', 'remove_from_album')").groupBy("album_id", "photo_id").agg(F.max_by("action", "moment").alias("action"))
    kept = album_photos.join(last, ["album_id", "photo_id"], "left_anti").select("album_id", "photo_id")
    return photos, kept.unionByName(last.where("action = 'add_to_album'").select("album_id", "photo_id")).dropDuplicates()


def apply_analyses(photos: DataFrame, analyses: DataFrame) -> DataFrame:
    """Analysis columns overwritten by id; taken_at and sharpness keep what is there; results of unknown photos are dropped."""
    own = [c for c in analyses.columns if c != "id" and c in photos.columns]
    renamed = analyses.select("id", *[F.col(c).alias(f"_{c}") for c in own], F.lit(True).alias("_hit"))
    joined = photos.join(renamed, "id", "left")
    for c in own:
        new = F.coalesce(c, f"_{c}") if c in ("taken_at", "sharpness") else F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c))
        joined = joined.withColumn(c, new)
    return joined.select(*photos.columns)


def distinct_first(df: DataFrame, key: str, order: str, cap: int = 500) -> DataFrame:
    """Order-preserving de-duplication: the first row of each key, the first `cap` of them."""
    first = df.groupBy(key).agg(F.min(order).alias(order))
    return first.orderBy(order, key).limit(cap)


def store_manifest(uploads: DataFrame, photos: DataFrame) -> DataFrame:
    """sha256, first upload id, of contents that need a new file."""
    first = uploads.groupBy("sha256").agg(F.min_by("id", F.struct("uploaded_at", "id")).alias("id"))
    return first.join(photos.select("sha256").distinct(), "sha256", "left_anti")


def worker_liveness(heartbeats: DataFrame, now: Column, online: int = 20) -> DataFrame:
    seen = heartbeats.groupBy("name").agg(F.max("last_seen").alias("last_seen"))
    return seen.withColumn("online", F.unix_timestamp("last_seen") >= F.unix_timestamp(now) - online)


def stale_claims(photos: DataFrame, liveness: DataFrame, now: Column, silent: int = 600) -> DataFrame:
    """Photos in processing whose worker is unknown or silent for more than `silent` seconds."""
    live = liveness.where(F.unix_timestamp("last_seen") >= F.unix_timestamp(now) - silent).select(F.col("name").alias("ai_worker"))
    return photos.where("ai_status = 'processing'").join(live, "ai_worker", "left_anti").select("id")


def ranked_page(photos: DataFrame, ranking: DataFrame) -> DataFrame:
    """Photos in the order of a given ranking (id, rank)."""
    return photos.join(ranking, "id").orderBy("rank", "id")


def first_uploads(uploads: DataFrame) -> DataFrame:
    """In-batch repeats: each upload with `repeat` true if the same content came earlier in the batch."""
    first = uploads.groupBy("sha256").agg(F.min(F.struct("uploaded_at", "id")).alias("_first"))
    return uploads.join(first, "sha256").withColumn("repeat", F.struct("uploaded_at", "id") > F.col("_first")).drop("_first")
