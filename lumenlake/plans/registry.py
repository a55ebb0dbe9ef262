"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions import text as X
from lumenlake.functions.hashes import aspect_difference
from lumenlake.functions.receipts import explode_items as with_items
from lumenlake.operators import bursts as B
from lumenlake.operators import catalogue as C
from lumenlake.operators import groups as G
from lumenlake.operators import pairs as P
from lumenlake.operators import people as H
from lumenlake.operators import spending as M
from lumenlake.operators.vector_index import close_pairs
from lumenlake.plans import analysed, streams  # noqa: F401  register their queries
from lumenlake.plans.register import ORACLES, QUERIES, query  # noqa: F401
from lumenlake.plans.views import PAD
from lumenlake.sources.scratch import materialise, table

# --- duplicates ---------------------------------------------------------------------------------------

_COMPONENTS = """
    e AS (SELECT photo_a AS a, photo_b AS b FROM matches WHERE kind IN ({kinds}) UNION SELECT photo_b, photo_a FROM matches WHERE kind IN ({kinds})),
    reach AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
    comp AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)"""
_DUP = _COMPONENTS.format(kinds="'exact', 'similar'")
_GROUPS = f"""WITH RECURSIVE {_DUP},
    r AS (SELECT p.*, component, row_number() OVER g AS place, row_number() OVER s > 1 AS again FROM photos p JOIN comp ON p.id = comp.node
        WINDOW g AS (PARTITION BY component ORDER BY cast(width AS bigint) * height DESC, size DESC, uploaded_at, id),
               s AS (PARTITION BY component, sha256 ORDER BY cast(width AS bigint) * height DESC, size DESC, uploaded_at, id)),
    k AS (SELECT component, max(CASE WHEN place = 1 THEN id END) AS group_id, sum(size) - max(CASE WHEN place = 1 THEN size END) AS extra_bytes,
            max(CASE WHEN sharpness > 0 THEN sharpness END) AS hi, min(CASE WHEN sharpness > 0 THEN sharpness END) AS lo, count(CASE WHEN sharpness > 0 THEN 1 END) AS n,
            arg_min(id, struct_pack(s := -coalesce(CASE WHEN sharpness > 0 THEN sharpness END, -1), p := place)) AS top FROM r GROUP BY component),
    ends AS (SELECT photo_a AS node, photo_b AS other, similarity FROM matches WHERE kind IN ('exact', 'similar')
        UNION ALL SELECT photo_b, photo_a, similarity FROM matches WHERE kind IN ('exact', 'similar')),
    best AS (SELECT node, max(similarity) AS best FROM ends GROUP BY node), direct AS (SELECT node, other, max(similarity) AS direct FROM ends GROUP BY node, other),
    dups AS (SELECT group_id, r.id, place, CASE WHEN place = 1 THEN 'keep' WHEN again THEN 'exact' ELSE 'similar' END AS relation,
            CASE WHEN place = 1 OR again THEN 1.0::DOUBLE ELSE coalesce(direct, best) END AS similarity, cast(extra_bytes AS bigint) AS extra_bytes,
            coalesce(r.id = top AND n >= 2 AND hi >= 1.15 * lo, false) AS sharpest
        FROM r JOIN k USING (component) LEFT JOIN best ON best.node = r.id LEFT JOIN direct ON direct.node = r.id AND direct.other = group_id)"""


@query("photos matches", _GROUPS + " SELECT * FROM dups")
def duplicate_groups(v, spark, sf_dir):
    return G.duplicate_groups(v("photos"), v("matches"))


@query(
    "photos matches",
    _GROUPS
    + """ SELECT count(*) AS groups, cast(coalesce(sum(extra), 0) AS bigint) AS extra_bytes, cast(coalesce(sum(copies), 0) AS bigint) AS removable
    FROM (SELECT group_id, max(extra_bytes) AS extra, count(*) - count(DISTINCT sha256) AS copies FROM dups JOIN photos USING (id) GROUP BY group_id)""",
)
def duplicate_summary(v, spark, sf_dir):
    return G.duplicate_summary(G.duplicate_groups(v("photos"), v("matches")), v("photos"))


@query("matches", f"WITH RECURSIVE {_DUP} SELECT * FROM comp")
def connected_components(v, spark, sf_dir):
    from lumenlake.operators.graph import connected_components as cc

    return cc(v("matches").where("kind in ('exact', 'similar')"), "photo_a", "photo_b")


@query(
    "photos matches",
    "WITH RECURSIVE "
    + _COMPONENTS.format(kinds="'subject'")
    + """, m AS (SELECT component, node AS id, count(*) OVER (PARTITION BY component) AS n FROM comp WHERE node IN (SELECT id FROM photos) AND node NOT IN (SELECT id FROM photos WHERE favorite)),
    ends AS (SELECT photo_a AS node, similarity FROM matches WHERE kind = 'subject' UNION ALL SELECT photo_b, similarity FROM matches WHERE kind = 'subject')
    SELECT component, id, max(similarity) AS similarity FROM m JOIN ends ON node = id WHERE n > 1 GROUP BY component, id""",
)
def related_groups(v, spark, sf_dir):
    """Favourites stand for the photos of bursts."""
    return G.related_groups(v("photos"), v("matches"), v("photos").where("favorite").select("id"))


@query("photos", "SELECT id, sha256, size FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY uploaded_at, id) AS n FROM photos) WHERE n > 1")
def exact_copies_to_remove(v, spark, sf_dir):
    return G.exact_copies_to_remove(v("photos"))


@query(
    "photos",
    "SELECT a.id AS photo_a, b.id AS photo_b, 'exact' AS kind, 1.0::DOUBLE AS similarity FROM photos a JOIN photos b ON a.sha256 = b.sha256 AND (a.uploaded_at, a.id) > (b.uploaded_at, b.id)",
)
def exact_pairs(v, spark, sf_dir):
    return P.exact_pairs(v("photos"))


@query(
    "photos",
    "SELECT id AS photo_a, f AS photo_b, 'exact' AS kind, 1.0::DOUBLE AS similarity FROM (SELECT id, first(id) OVER (PARTITION BY sha256 ORDER BY uploaded_at, id) AS f FROM photos) WHERE id <> f",
)
def exact_stars(v, spark, sf_dir):
    return P.exact_stars(v("photos"))


@query(
    "photos",
    "SELECT f.sha256, arg_min(filename, struct_pack(u := uploaded_at, i := id)) AS filename FROM photos p JOIN (SELECT DISTINCT sha256 FROM photos WHERE favorite) f ON p.sha256 = f.sha256 GROUP BY f.sha256",
)
def already_stored(v, spark, sf_dir):
    return P.already_stored(v("photos").where("favorite").select(F.upper("sha256").alias("sha256")), v("photos"))


@query(
    "photos matches",
    """SELECT photo_a, arg_min(photo_b, struct_pack(s := -m.similarity, u := uploaded_at, b := photo_b)) AS photo_b, max(m.similarity) AS similarity
    FROM matches m JOIN photos ON id = photo_b GROUP BY photo_a""",
)
def best_match(v, spark, sf_dir):
    return P.best_match(v("matches"), v("photos"))


def hashed_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with hashes from the embeddings' signs: variants 0-3 flip 0, 5, 10 and 11 bits; variant 4 is a byte-identical copy of 0."""
    e = table(spark, sf_dir, "embeddings")
    middle = lambda: F.transform("embedding", lambda x: x.cast("double"))
    e = e.withColumn("d", middle())
    median = (F.sort_array("d")[31] + F.sort_array("d")[32]) / 2
    e = e.withColumn("m", median)
    bits = lambda flags: F.array_join(F.transform(flags, lambda b: b.cast("int").cast("string")), "")
    e = e.withColumn("s", bits(F.transform("d", lambda x: x > F.col("m")))).withColumn("t", bits(F.transform("d", lambda x, i: x > F.get("d", F.pmod(i + 1, F.lit(64))))))
    e = e.withColumn("variant", F.explode(F.array(*[F.lit(k) for k in range(5)]))).withColumn("kind", F.col("variant") % 4)

    def flipped(name: str, counts: tuple[int, ...]) -> Column:
        n = F.get(F.array(*[F.lit(c) for c in counts]), F.col("kind"))
        head = F.translate(F.substr(F.col(name), F.lit(1), n), "01", "10")
        b = F.concat(head, F.substr(F.col(name), n + 1))
        return F.lower(F.concat(*[F.lpad(F.conv(F.substring(b, k, 16), 2, 16), 4, "0") for k in (1, 17, 33, 49)]))

    photos = e.select(
        F.concat(F.lit("h"), F.lpad((F.col("vec_id") * 10 + F.col("variant")).cast("string"), 9, "0")).alias("id"),
        F.sha2(F.concat_ws(":", "vec_id", "kind"), 256).alias("sha256"),
        flipped("s", (0, 5, 10, 11)).alias("phash"),
        flipped("t", (0, 6, 12, 13)).alias("dhash"),
        (1000 + F.col("vec_id") % 4 * 100).cast("int").alias("width"),
        F.lit(800).alias("height"),
        F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("uploaded_at"),
    )
    return materialise(photos, "hashed-photos")  # a table, as a catalogue has it


_H = r"""
    base AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings),
    med AS (SELECT *, (list_sort(d)[32] + list_sort(d)[33]) / 2 AS m FROM base),
    bits AS (SELECT vec_id, list_transform(d, lambda x: x > m) AS s, list_transform(range(1, 65), lambda i: d[i] > d[i % 64 + 1]) AS t FROM med),
    var AS (SELECT vec_id, v, v % 4 AS k, s, t FROM bits CROSS JOIN range(0, 5) r(v)),
    ph AS (SELECT concat('h', lpad((vec_id * 10 + v)::VARCHAR, 9, '0')) AS id, sha256(concat(vec_id, ':', k)) AS sha256, lpad(vec_id::VARCHAR, 9, '0') AS uploaded_at,
        (1000 + vec_id % 4 * 100)::INT AS width, 800 AS height,
        list_transform(range(1, 65), lambda i: s[i] <> (i <= [0, 5, 10, 11][k + 1])) AS p, list_transform(range(1, 65), lambda i: t[i] <> (i <= [0, 6, 12, 13][k + 1])) AS q FROM var),
    h AS (SELECT id, sha256, uploaded_at, width, height, array_to_string(list_transform(p, lambda b: b::INT), '')::BIT AS p, array_to_string(list_transform(q, lambda b: b::INT), '')::BIT AS q FROM ph)"""


@query(
    sql=f"""WITH {_H}
    SELECT a.id AS photo_a, b.id AS photo_b, 'similar' AS kind, least(0.99, round(1 - (bit_count(xor(a.p, b.p)) + bit_count(xor(a.q, b.q))) / 128.0::DOUBLE, 3))::DOUBLE AS similarity
    FROM h a JOIN h b ON (a.uploaded_at, a.id) > (b.uploaded_at, b.id) AND a.sha256 <> b.sha256 AND bit_count(xor(a.p, b.p)) <= 10 AND bit_count(xor(a.q, b.q)) <= 12
        AND 1 - least(a.width / a.height, b.width / b.height) / greatest(a.width / a.height, b.width / b.height) <= 0.15""",
    plain=True,
)
def similar_pairs(v, spark, sf_dir):
    return P.similar_pairs(hashed_photos(spark, sf_dir))


# --- browsing -----------------------------------------------------------------------------------------


@query("photos", "SELECT id, filename FROM photos WHERE lower(filename) LIKE '%the re%' OR ocr_search LIKE '%there%'")
def search_photos(v, spark, sf_dir):
    return C.search_photos(v("photos"), "The re").select("id", "filename")


@query("photos matches", "SELECT id FROM photos WHERE id IN (SELECT photo_a FROM matches WHERE kind <> 'subject' UNION SELECT photo_b FROM matches WHERE kind <> 'subject')")
def filter_duplicates(v, spark, sf_dir):
    return C.filter_photos(v("photos"), v("matches"), "duplicates").select("id")


@query("photos", "SELECT id FROM photos WHERE ocr_search <> ''")
def filter_text(v, spark, sf_dir):
    return C.filter_photos(v("photos"), None, "text").select("id")


@query("photos", "SELECT id FROM photos WHERE favorite")
def filter_favorites(v, spark, sf_dir):
    return C.filter_photos(v("photos"), None, "favorites").select("id")


@query("photos", "SELECT id, substr(coalesce(taken_at, uploaded_at), 1, 10) AS day FROM photos WHERE substr(coalesce(taken_at, uploaded_at), 1, 10) BETWEEN '2023-03-05' AND '2024-02-10'")
def date_range(v, spark, sf_dir):
    return C.date_range(v("photos"), "2023-03-05", "2024-02-10").select("id", C.photo_date().alias("day"))


@query("photos album_photos", "SELECT p.id FROM photos p SEMI JOIN (SELECT photo_id FROM album_photos WHERE album_id = 'a7') x ON p.id = x.photo_id")
def in_album(v, spark, sf_dir):
    return C.in_album(v("photos"), v("album_photos"), "a7").select("id")


@query(
    "photos matches",
    """SELECT id, sha256, size FROM photos WHERE id IN (SELECT photo_a FROM matches WHERE kind <> 'subject' UNION SELECT photo_b FROM matches WHERE kind <> 'subject')
    AND substr(coalesce(taken_at, uploaded_at), 1, 10) >= '2023-02-01' ORDER BY size DESC, id LIMIT 20 OFFSET 5""",
)
def list_photos(v, spark, sf_dir):
    return C.list_photos(v("photos"), v("matches"), v("album_photos"), kind="duplicates", start="2023-02-01", sort="largest", offset=5, limit=20)[1].select("id", "sha256", "size")


_SORTS = {
    "newest": "uploaded_at DESC",
    "oldest": "uploaded_at",
    "taken_new": "coalesce(taken_at, uploaded_at) DESC",
    "taken_old": "coalesce(taken_at, uploaded_at)",
    "largest": "size DESC",
    "smallest": "size",
    "name": "lower(filename)",
}
for _key, _order in _SORTS.items():

    def _sorted(v, spark, sf_dir, key=_key):
        """The third page of 20 by one sort key, with the place of each photo."""
        rows = C.page(C.sort_photos(v("photos"), key), 40, 20).select("id")
        return rows.withColumn("place", F.monotonically_increasing_id())  # one partition: the page is

    _sorted.__name__ = f"sort_{_key}"
    query("photos", f"SELECT id, row_number() OVER (ORDER BY n) - 1 AS place FROM (SELECT id, row_number() OVER (ORDER BY {_order}, id) AS n FROM photos) WHERE n BETWEEN 41 AND 60")(_sorted)


@query("photos matches", "SELECT count(*) AS total FROM photos WHERE ocr_search <> '' AND substr(coalesce(taken_at, uploaded_at), 1, 10) <= '2023-06-01'")
def list_photos_total(v, spark, sf_dir):
    return C.list_photos(v("photos"), v("matches"), v("album_photos"), kind="text", end="2023-06-01")[0]


@query(
    "photos matches",
    """WITH e AS (SELECT photo_a AS id, kind FROM matches UNION ALL SELECT photo_b, kind FROM matches),
    b AS (SELECT id, max((kind = 'exact')::INT) AS x FROM e WHERE kind <> 'subject' GROUP BY id)
    SELECT id, CASE x WHEN 1 THEN 'exact' WHEN 0 THEN 'similar' END AS match FROM photos LEFT JOIN b USING (id)""",
)
def match_badge(v, spark, sf_dir):
    return C.with_match_badge(v("photos"), v("matches")).select("id", "match")


@query("photos", "SELECT id, filename, size, concat('/api/photos/', id, '/file') AS url, concat('/api/photos/', id, '/thumb') AS thumb_url FROM photos")
def public_columns(v, spark, sf_dir):
    return C.public_columns(v("photos")).select("id", "filename", "size", "url", "thumb_url")


@query("photos", "SELECT id FROM photos WHERE ai_status IS NULL OR (ai_status IN ('done', 'failed') AND (ai_version IS NULL OR ai_version < 6))")
def pending_analysis(v, spark, sf_dir):
    return C.pending_analysis(v("photos")).select("id")


_PEOPLE = "SELECT p.id, name, count(DISTINCT photo_id) AS photos FROM people p JOIN faces f ON f.person_id = p.id GROUP BY p.id, name, manual HAVING count(DISTINCT photo_id) >= 2 OR manual"


@query(
    "photos matches people faces",
    f"""SELECT (SELECT count(*) FROM photos) AS photos, (SELECT sum(size)::BIGINT FROM photos) AS total_bytes, sum(s)::BIGINT AS stored_bytes,
    ((SELECT sum(size) FROM photos) - sum(s))::BIGINT AS saved_bytes, (SELECT count(*) FROM photos) - count(*) AS exact_copies,
    (SELECT count(*) FROM matches WHERE kind = 'similar') AS similar_pairs, (SELECT count(*) FROM ({_PEOPLE})) AS people
    FROM (SELECT max(size) AS s FROM photos GROUP BY sha256)""",
)
def stats(v, spark, sf_dir):
    return C.stats(v("photos"), v("matches"), H.list_people(v("people"), v("faces")))


@query("photos", "SELECT id, uploaded_at FROM photos ORDER BY uploaded_at DESC, id LIMIT 10")
def recent_photos(v, spark, sf_dir):
    return C.recent(v("photos")).select("id", "uploaded_at")


@query("photos", "SELECT CASE WHEN coalesce(ai_status, 'processing') = 'processing' THEN 'waiting' ELSE ai_status END AS status, count(*) AS n FROM photos GROUP BY 1")
def analysis_status(v, spark, sf_dir):
    return C.analysis_status(v("photos"))


@query(
    "photos matches faces people albums album_photos receipts",
    f"""WITH e AS (SELECT photo_a AS id, photo_b AS o, kind, similarity FROM matches UNION ALL SELECT photo_b, photo_a, kind, similarity FROM matches),
    m AS (SELECT id, string_agg(o || '/' || kind, ',' ORDER BY similarity DESC, o, kind) AS matches FROM e GROUP BY id),
    c AS (SELECT person_id, count(DISTINCT photo_id) AS n FROM faces WHERE person_id IS NOT NULL GROUP BY person_id),
    f AS (SELECT photo_id AS id, string_agg(f.id || '/' || coalesce(p.name, '-') || '/' || coalesce(n, 0), ',' ORDER BY x, f.id) AS people FROM faces f LEFT JOIN people p ON p.id = person_id LEFT JOIN c ON c.person_id = f.person_id GROUP BY photo_id),
    a AS (SELECT photo_id AS id, string_agg(name || '/' || album_id, ',' ORDER BY name, album_id) AS albums FROM album_photos JOIN albums ON albums.id = album_id GROUP BY photo_id),
    r AS (SELECT {PAD("cast(regexp_extract(id, 'r([0-9]+)', 1) AS bigint) % 1000")} AS id, min(shop) AS shop, max(total) AS total FROM receipts GROUP BY 1)
    SELECT photos.id, coalesce(matches, '') AS matches, coalesce(people, '') AS people, coalesce(albums, '') AS albums, coalesce(ocr_text, '') AS text, filename AS code, coalesce(split_part(ocr_text, ' ', 1), '') AS word,
        shop, total FROM photos LEFT JOIN m USING (id) LEFT JOIN f USING (id) LEFT JOIN a USING (id) LEFT JOIN r USING (id)""",
)
def photo_details(v, spark, sf_dir):
    """File names stand for codes, the first word of the text for the read words, the receipts of a thousand orders for those of photos."""
    box = F.array(F.lit(0.0)).alias("box")
    photos = v("photos").withColumn("qr_codes", F.array(F.struct(F.col("filename").alias("text"), box)))
    photos = photos.withColumn("ocr_words", F.when(F.col("ocr_text").isNotNull(), F.array(F.struct(F.element_at(F.split("ocr_text", " "), 1).alias("text"), box, F.lit(0).alias("line")))))
    receipts = v("receipts").groupBy(F.expr(PAD("cast(regexp_extract(id, 'r([0-9]+)', 1) as bigint) % 1000")).alias("id")).agg(F.min("shop").alias("shop"), F.max("total").alias("total"))
    d = C.photo_details(photos, v("matches"), v("faces"), v("people"), v("albums"), v("album_photos"), receipts)
    said = lambda x: F.concat_ws("/", x["face_id"], F.coalesce(x["name"], F.lit("-")), x["photos"].cast("string"))
    return d.select(
        "id",
        F.array_join(F.transform("matches", lambda x: F.concat_ws("/", x["id"], x["kind"])), ",").alias("matches"),
        F.array_join(F.transform("people", said), ",").alias("people"),
        F.array_join(F.transform("albums", lambda x: F.concat_ws("/", x["name"], x["id"])), ",").alias("albums"),
        "text",
        F.get("qr_codes", F.lit(0))["text"].alias("code"),
        F.coalesce(F.get("words", F.lit(0))["text"], F.lit("")).alias("word"),
        "receipt.shop",
        "receipt.total",
    )


def _catalogue(v):
    return {n: v(n) for n in ("photos", "faces", "matches", "album_photos", "people")}


@query(
    "photos faces matches album_photos people",
    """WITH gone AS (SELECT id FROM photos WHERE favorite), left_p AS (SELECT * FROM photos WHERE NOT favorite)
    SELECT 'originals/' || sha256 AS key FROM photos WHERE favorite AND sha256 NOT IN (SELECT sha256 FROM left_p) GROUP BY sha256
    UNION ALL SELECT 'thumbnails/' || sha256 || '.jpg' FROM photos WHERE favorite AND sha256 NOT IN (SELECT sha256 FROM left_p) GROUP BY sha256
    UNION ALL SELECT 'faces/' || id || '.jpg' FROM faces WHERE photo_id IN (SELECT id FROM gone)""",
)
def delete_orphans(v, spark, sf_dir):
    return C.delete_photos(_catalogue(v), v("photos").where("favorite"))[1]


@query(
    "photos faces matches album_photos people",
    """WITH gone AS (SELECT id FROM photos WHERE favorite), f AS (SELECT * FROM faces WHERE photo_id NOT IN (SELECT id FROM gone)),
    lost AS (SELECT DISTINCT person_id FROM faces WHERE photo_id IN (SELECT id FROM gone) AND person_id IS NOT NULL AND person_id NOT IN (SELECT person_id FROM f WHERE person_id IS NOT NULL))
    SELECT 'photos' AS name, count(*) AS n FROM photos WHERE NOT favorite UNION ALL SELECT 'faces', count(*) FROM f
    UNION ALL SELECT 'matches', count(*) FROM matches WHERE photo_a NOT IN (SELECT id FROM gone) AND photo_b NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'album_photos', count(*) FROM album_photos WHERE photo_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'people', count(*) FROM people WHERE id NOT IN (SELECT person_id FROM lost)""",
)
def delete_photos(v, spark, sf_dir):
    out = C.delete_photos(_catalogue(v), v("photos").where("favorite"))[0]
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, d in out.items()]
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made


_ACTIONS = """acts AS (SELECT event_id AS moment, CASE event_id % 4 WHEN 0 THEN 'favorite' WHEN 1 THEN 'unfavorite' WHEN 2 THEN 'add_to_album' ELSE 'remove_from_album' END AS action,
    concat('p', lpad(cast(user_id * 7 % 1100 as string), 8, '0')) AS photo_id, concat('a', cast(user_id % 20 as string)) AS album_id FROM {events})"""


def _actions(spark, sf_dir):
    return spark.sql("WITH " + _ACTIONS + " SELECT * FROM acts", events=table(spark, sf_dir, "events"))


@query(
    "photos",
    "WITH "
    + _ACTIONS.format(events="events")
    + ", l AS (SELECT photo_id, arg_max(action, moment) AS action FROM acts WHERE action LIKE '%favorite' GROUP BY photo_id) SELECT id, coalesce(l.action = 'favorite', favorite) AS favorite FROM photos LEFT JOIN l ON photo_id = id",
)
def apply_favorites(v, spark, sf_dir):
    return C.apply_actions(v("photos"), v("album_photos"), _actions(spark, sf_dir))[0].select("id", "favorite")


@query(
    "photos album_photos",
    "WITH "
    + _ACTIONS.format(events="events")
    + """, l AS (SELECT album_id, photo_id, arg_max(action, moment) AS action FROM acts WHERE action LIKE '%album' AND photo_id IN (SELECT id FROM photos) GROUP BY album_id, photo_id)
    SELECT album_id, photo_id FROM album_photos a WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.album_id = a.album_id AND l.photo_id = a.photo_id)
    UNION SELECT album_id, photo_id FROM l WHERE action = 'add_to_album'""",
)
def apply_album_actions(v, spark, sf_dir):
    return C.apply_actions(v("photos"), v("album_photos"), _actions(spark, sf_dir))[1]


@query(
    "photos",
    """SELECT p.id, coalesce(p.taken_at, a.taken_at) AS taken_at, coalesce(p.sharpness, a.sharpness) AS sharpness, CASE WHEN a.id IS NULL THEN p.ai_status ELSE 'done' END AS ai_status
    FROM photos p LEFT JOIN (SELECT id, uploaded_at AS taken_at, 1.5::DOUBLE AS sharpness FROM photos WHERE camera) a ON a.id = p.id""",
)
def apply_analyses(v, spark, sf_dir):
    done = v("photos").where("camera").select("id", F.col("uploaded_at").alias("taken_at"), F.lit(1.5).alias("sharpness"), F.lit("done").alias("ai_status"))
    return C.apply_analyses(v("photos"), done).select("id", "taken_at", "sharpness", "ai_status")


@query("photos", "SELECT sha256, arg_min(id, struct_pack(u := uploaded_at, i := id)) AS id FROM photos WHERE camera AND sha256 NOT IN (SELECT sha256 FROM photos WHERE NOT camera) GROUP BY sha256")
def store_manifest(v, spark, sf_dir):
    return C.store_manifest(v("photos").where("camera"), v("photos").where("not camera"))


@query("photos", "SELECT id, row_number() OVER (PARTITION BY sha256 ORDER BY uploaded_at, id) > 1 AS repeat FROM photos")
def batch_repeats(v, spark, sf_dir):
    return C.first_uploads(v("photos")).select("id", "repeat")


@query(sql="SELECT source AS filename, min(doc_id) AS moment FROM documents GROUP BY source ORDER BY moment LIMIT 500", plain=True)
def distinct_first(v, spark, sf_dir):
    return C.distinct_first(table(spark, sf_dir, "documents").select(F.col("source").alias("filename"), F.col("doc_id").alias("moment")), "filename", "moment")


@query("", "WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT concat('w', user_id % 40) AS name, max(ts) AS last_seen FROM events GROUP BY 1) SELECT name, last_seen, epoch(last_seen)::BIGINT >= epoch(now)::BIGINT - 3600 AS online FROM l, m", plain=True)
def worker_liveness(v, spark, sf_dir):
    beats = table(spark, sf_dir, "events").select(F.concat(F.lit("w"), (F.col("user_id") % 40).cast("string")).alias("name"), F.col("ts").alias("last_seen"))
    now = beats.agg(F.max("last_seen")).first()[0]
    return C.worker_liveness(beats, F.lit(now), 3600) if now else C.worker_liveness(beats, F.current_timestamp(), 3600)


@query(
    "photos",
    """WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT concat('w', user_id % 40) AS name, max(ts) AS last_seen FROM events GROUP BY 1)
    SELECT id FROM photos WHERE ai_status = 'processing' AND (ai_worker IS NULL OR ai_worker NOT IN (SELECT name FROM l, m WHERE epoch(last_seen)::BIGINT >= epoch(now)::BIGINT - 7200))""",
)
def stale_claims(v, spark, sf_dir):
    beats = table(spark, sf_dir, "events").select(F.concat(F.lit("w"), (F.col("user_id") % 40).cast("string")).alias("name"), F.col("ts").alias("last_seen"))
    now = beats.agg(F.max("last_seen")).first()[0]
    return C.stale_claims(v("photos"), C.worker_liveness(beats, F.lit(now)), F.lit(now), 7200)


# --- people and albums --------------------------------------------------------------------------------


@query("people faces", _PEOPLE)
def list_people(v, spark, sf_dir):
    return H.list_people(v("people"), v("faces"))


@query("faces", "SELECT person_id, arg_min(id, struct_pack(a := -(w * h), i := id)) AS face_id FROM faces WHERE person_id IS NOT NULL GROUP BY person_id")
def cover_faces(v, spark, sf_dir):
    return H.cover_faces(v("faces"))


@query(
    "faces photos",
    """WITH l AS (SELECT person_id, photo_id, arg_max(struct_pack(x := x, y := y, w := w, h := h), id) AS f FROM faces WHERE person_id IS NOT NULL GROUP BY ALL)
    SELECT person_id, photo_id, uploaded_at, round(f.x + f.w / 2, 3) AS focus_x, round(f.y + f.h / 2, 3) AS focus_y FROM l JOIN photos ON photo_id = photos.id""",
)
def person_photos(v, spark, sf_dir):
    return H.person_photos(v("faces"), v("photos"))


@query(
    "people faces photos",
    """WITH l AS (SELECT person_id, photo_id, arg_max(struct_pack(x := x, y := y, w := w, h := h), id) AS f FROM faces WHERE person_id IS NOT NULL GROUP BY ALL),
    s AS (SELECT person_id AS id, string_agg(concat_ws('/', photo_id, round(round(f.x + f.w / 2, 3) * 1000)::BIGINT::VARCHAR), ',' ORDER BY uploaded_at DESC, photo_id DESC) AS photos FROM l JOIN photos ON photo_id = photos.id GROUP BY person_id),
    c AS (SELECT person_id AS id, arg_min(id, struct_pack(a := -(w * h), i := id)) AS cover, string_agg(id, ',' ORDER BY id) AS faces FROM faces WHERE person_id IS NOT NULL GROUP BY person_id)
    SELECT id, name, cover, photos, faces FROM people LEFT JOIN c USING (id) LEFT JOIN s USING (id)""",
)
def person_details(v, spark, sf_dir):
    d = H.person_details(v("people"), v("faces"), v("photos"))
    seen = F.transform("photos", lambda p: F.concat_ws("/", p["photo_id"], F.round(p["focus_x"] * 1000).cast("long").cast("string")))
    return d.select("id", "name", "cover", F.array_join(seen, ",").alias("photos"), F.array_join(F.transform("faces", lambda f: f["face_id"]), ",").alias("faces"))


@query("receipts", "SELECT id, item AS name, item_amount AS amount FROM receipts")
def explode_items(v, spark, sf_dir):
    read = v("receipts").select("id", F.struct(F.array(F.struct(F.col("item").alias("name"), F.col("item_amount").alias("amount"))).alias("items")).alias("receipt"))
    return with_items(read, "id")


@query("billing", "SELECT service, CASE WHEN cost > 0 AND cost < 0.005 THEN 'under $0.01' ELSE '$' || printf('%.2f', cost) END AS shown, count(*) AS n FROM billing GROUP BY ALL")
def shown_money(v, spark, sf_dir):
    return v("billing").groupBy("service", X.format_money(F.col("cost")).alias("shown")).agg(F.count("*").alias("n"))


@query(
    "faces people",
    """WITH k AS (SELECT arg_min(id, struct_pack(n := name IS NULL, c := created_at, i := id)) AS keep FROM people WHERE id IN ('n1-0', 'n2-1', 'n3-2'))
    SELECT id, CASE WHEN person_id IN ('n1-0', 'n2-1', 'n3-2') THEN coalesce(keep, person_id) ELSE person_id END AS person_id FROM faces, k""",
)
def merge_people(v, spark, sf_dir):
    return H.merge_people(v("people"), v("faces"), ["n1-0", "n2-1", "n3-2"])[1].select("id", "person_id")


@query(
    "people",
    """WITH k AS (SELECT arg_min(id, struct_pack(n := name IS NULL, c := created_at, i := id)) AS keep FROM people WHERE id IN ('n1-0', 'n2-1', 'n3-2'))
    SELECT id, name, created_at, CASE WHEN id = keep THEN true ELSE manual END AS manual FROM people, k WHERE id NOT IN ('n1-0', 'n2-1', 'n3-2') OR id = keep""",
)
def merged_people(v, spark, sf_dir):
    return H.merge_people(v("people"), v("faces"), ["n1-0", "n2-1", "n3-2"])[0].select("id", "name", "created_at", "manual")


@query(
    "faces people",
    """WITH f AS (SELECT CASE WHEN person_id = 'n1-0' AND id IN ('f1', 'f21', 'f31', 'f61') THEN 'new' ELSE person_id END AS p FROM faces),
    b AS (SELECT id, name, created_at, CASE WHEN id = 'n1-0' THEN true ELSE manual END AS manual FROM people UNION ALL SELECT 'new', NULL, '2024-02-01', true)
    SELECT * FROM b WHERE id NOT IN ('n1-0', 'new') OR id IN (SELECT p FROM f WHERE p IS NOT NULL)""",
)
def split_people(v, spark, sf_dir):
    return H.split_person(v("people"), v("faces"), "n1-0", ["f1", "f21", "f31", "f61"], "new", "2024-02-01")[0].select("id", "name", "created_at", "manual")


@query("faces people", "SELECT id, CASE WHEN person_id = 'n1-0' AND id IN ('f3', 'f6', 'f9') THEN 'new' ELSE person_id END AS person_id FROM faces")
def split_person(v, spark, sf_dir):
    return H.split_person(v("people"), v("faces"), "n1-0", ["f3", "f6", "f9"], "new", "2024-02-01")[1].select("id", "person_id")


@query(
    "albums album_photos photos",
    """SELECT a.id, name, count(p.id) AS photos, coalesce(sum(size), 0)::BIGINT AS bytes, min(p.id) AS cover FROM albums a LEFT JOIN album_photos x ON x.album_id = a.id LEFT JOIN photos p ON p.id = photo_id GROUP BY a.id, name""",
)
def list_albums(v, spark, sf_dir):
    return H.list_albums(v("albums"), v("album_photos"), v("photos"))


@query("photos", "SELECT lang AS album, count(*) AS photos, sum(n_chars * 10)::BIGINT AS bytes, concat('p', lpad(min(doc_id)::VARCHAR, 8, '0')) AS cover FROM documents GROUP BY lang")
def auto_album_summary(v, spark, sf_dir):
    auto = table(spark, sf_dir, "documents").select(F.col("lang").alias("album"), F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"), F.col("doc_id").alias("rank"))
    return H.auto_album_summary(auto, v("photos"))


@query(sql="SELECT least(a.vec_id, b.vec_id) AS a, greatest(a.vec_id, b.vec_id) AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.vec_id // 2 <> b.vec_id // 2 WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.363", plain=True)
def face_pairs(v, spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.floor(F.col("vec_id") / 2).alias("photo"))
    return close_pairs(e, 0.363, group="photo").withColumn("similarity", F.round("similarity", 6))


# --- money --------------------------------------------------------------------------------------------

_SQ = r"""regexp_replace(lower({}), '[\s\-_.,:;!?''"()/]+', '', 'g')"""
_NAME = "CASE WHEN coalesce(shop, '') = '' THEN 'Unknown shop' ELSE shop END"
_KEY = f"CASE WHEN {_SQ.format(_NAME)} = '' THEN 'unknown' ELSE substr({_SQ.format(_NAME)}, 1, 16) END"
_MARKED = f"""marked AS (SELECT *, CASE WHEN coalesce(shop, '') = '' OR date IS NULL OR total IS NULL OR f = id THEN NULL ELSE f END AS copy_of FROM (
    SELECT *, first(id) OVER (PARTITION BY substr({_SQ.format('shop')}, 1, 16), date, total ORDER BY coalesce(sharpness, 0) DESC, coalesce(date, '') DESC, uploaded_at DESC, id) AS f FROM receipts))"""


def _receipts(v):
    return M.mark_receipt_copies(v("receipts").withColumn("items", F.array(F.struct(F.col("item").alias("name"), F.col("item_amount").alias("amount")))))


@query("receipts", f"WITH {_MARKED} SELECT id, copy_of FROM marked")
def receipt_copy_marks(v, spark, sf_dir):
    return _receipts(v).select("id", "copy_of")


@query("receipts", f"WITH {_MARKED} SELECT copy_of AS kept, string_agg(id, ',' ORDER BY id) AS copies, sum(size)::BIGINT AS extra_bytes FROM marked WHERE copy_of IS NOT NULL GROUP BY copy_of")
def receipt_copies(v, spark, sf_dir):
    return M.receipt_copies(_receipts(v)).withColumn("copies", F.array_join("copies", ","))


@query("receipts", f"WITH {_MARKED} SELECT currency, count(*) AS n, sum(total::DECIMAL(18,2))::DOUBLE AS total FROM marked WHERE copy_of IS NULL AND total IS NOT NULL GROUP BY currency")
def spending_totals(v, spark, sf_dir):
    return M.spending_totals(_receipts(v))


@query(
    "receipts",
    f"""WITH {_MARKED}, k AS (SELECT *, {_KEY} AS shop_key FROM marked),
    n AS (SELECT shop_key, arg_max({_NAME}, struct_pack(d := coalesce(date, ''), u := uploaded_at, i := id)) AS shop, count(*) AS receipts FROM k GROUP BY shop_key),
    s AS (SELECT shop_key, currency, sum(total::DECIMAL(18,2))::DOUBLE AS total FROM k WHERE copy_of IS NULL AND total IS NOT NULL GROUP BY ALL)
    SELECT shop_key, currency, shop, receipts, total FROM n LEFT JOIN s USING (shop_key)""",
)
def spending_by_shop(v, spark, sf_dir):
    return M.spending_by_shop(_receipts(v))


@query(
    "receipts",
    rf"""WITH {_MARKED}, i AS (SELECT *, {_SQ.format("item")} AS key FROM marked WHERE copy_of IS NULL)
    SELECT key, arg_max(currency, struct_pack(d := coalesce(date, ''), u := uploaded_at, i := id)) AS currency, count(*) AS times, sum(item_amount::DECIMAL(18,2))::DOUBLE AS spent, max(date) AS latest FROM i GROUP BY key ORDER BY times DESC, spent DESC, key LIMIT 8""",
)
def top_items(v, spark, sf_dir):
    return M.top_items(_receipts(v)).select("key", "currency", "times", "spent", "latest")


@query("receipts", f"WITH {_MARKED} SELECT count(*) - count(copy_of) AS count, count(copy_of) AS copies FROM marked")
def receipt_counts(v, spark, sf_dir):
    return M.receipt_counts(_receipts(v))


@query("deletions", "SELECT coalesce(sum(CASE WHEN duplicate THEN size END), 0)::BIGINT AS freed_bytes FROM deletions")
def freed_bytes(v, spark, sf_dir):
    return M.freed_bytes(v("deletions"))


@query(
    "receipts",
    rf"""WITH {_MARKED} SELECT coalesce(shop, '') AS "Shop", coalesce(date, '') AS "Date", total AS "Total", currency AS "Currency", upper(kind[1]) || kind[2:] AS "Kind", item || ' ' || regexp_replace(printf('%.2f', item_amount), '\.?0+$', '') AS "Items", filename AS "Photo" FROM marked WHERE copy_of IS NULL""",
)
def export_receipts(v, spark, sf_dir):
    return M.export_receipts(_receipts(v))


def _listing(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]+/(.*)$", 1).alias("path"), F.octet_length("html").cast("long").alias("length"))


@query(sql="SELECT split_part(regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1), '/', 1) AS part, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1", plain=True)
def storage_usage(v, spark, sf_dir):
    return M.storage_usage(_listing(spark, sf_dir))


@query(
    "photos deletions",
    """WITH u AS (SELECT sum(strlen(html))::BIGINT AS used FROM pages), s AS (SELECT sum(a - m)::BIGINT AS twice FROM (SELECT sum(size) AS a, max(size) AS m FROM photos GROUP BY sha256)),
    f AS (SELECT coalesce(sum(CASE WHEN duplicate THEN size END), 0)::BIGINT AS freed FROM deletions)
    SELECT used AS total_bytes, (twice + freed)::BIGINT AS saved_bytes, used / 1073741824.0::DOUBLE * 0.02::DOUBLE AS monthly_cost, (twice + freed) / 1073741824.0::DOUBLE * 0.02::DOUBLE AS saved_monthly, 88.0::DOUBLE AS inr_rate, used / (5 * 1073741824.0::DOUBLE) AS share FROM u, s, f""",
)
def storage_report(v, spark, sf_dir):
    return M.storage_report(_listing(spark, sf_dir), v("photos"), M.freed_bytes(v("deletions")))


@query("billing", "WITH e AS (SELECT service, round(sum(cost), 4) AS cost FROM billing GROUP BY service) SELECT * FROM e UNION ALL SELECT NULL, round(sum(cost), 2) FROM e")
def cost_report(v, spark, sf_dir):
    return M.cost_report(v("billing"))


_FIX = """CASE id_n % 10 WHEN 1 THEN '{"shop":"Corner Store","total":"12.5"}' WHEN 2 THEN '{"total":null}' WHEN 3 THEN '{"receipt":"false"}' END"""


@query(
    "receipts",
    """WITH n AS (SELECT *, cast(regexp_extract(id, 'r([0-9]+)', 1) AS bigint) % 10 AS k FROM receipts)
    SELECT id, CASE k WHEN 1 THEN 'Corner Store' ELSE shop END AS shop, date, CASE k WHEN 1 THEN 12.5::DOUBLE WHEN 2 THEN NULL ELSE total END AS total, currency, kind,
        CASE k WHEN 1 THEN 'shop,total' WHEN 2 THEN 'total' ELSE '' END AS edited FROM n WHERE k <> 3""",
)
def apply_fixes(v, spark, sf_dir):
    r = v("receipts")
    fixes = r.select("id", F.from_json(F.expr(_FIX.replace("id_n", "cast(regexp_extract(id, 'r([0-9]+)', 1) as bigint)")), "map<string,string>").alias("fix")).where("fix is not null").dropDuplicates(["id"])
    return M.apply_fixes(r, fixes).withColumn("edited", F.array_join("edited", ","))


# --- text and scalars ---------------------------------------------------------------------------------


@query(
    sql=r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b'), ',') AS emails,
    array_to_string(regexp_extract_all(text, '(?i)\b(?:https?://|www\.)[^\s,;]+'), ',') AS links, len(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b'))::INT AS dates FROM documents""",
    plain=True,
)
def extract_contacts(v, spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.extract_emails(t), ",").alias("emails"), F.array_join(X.extract_links(t), ",").alias("links"), F.size(X.extract_iso_dates(t)).alias("dates"))


@query(sql=rf"SELECT doc_id, {_SQ.format('text')} AS squeezed FROM documents", plain=True)
def squeeze(v, spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.squeeze(F.col("text")).alias("squeezed"))


@query(
    sql=rf"""SELECT p_partkey, array_to_string(list_filter(list_transform(list_filter(string_split_regex(trim(p_name), '\s+'), lambda w: lower(w) NOT IN ('the', 'and', 'with', 'that', 'says', 'said', 'photo', 'picture', 'image', 'showing', 'from', 'for')),
    lambda w: {_SQ.format("w")}), lambda w: length(w) >= 3), ' ') AS words FROM part""",
    plain=True,
)
def search_words(v, spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.search_words(F.col("p_name")), " ").alias("words"))


@query(
    sql="""SELECT o_orderkey, CASE WHEN y < 100 THEN CASE WHEN y < 50 THEN y + 2000 ELSE y + 1900 END ELSE y END AS year, strftime(try_cast(concat(CASE WHEN y < 50 THEN y + 2000 ELSE y + 1900 END, '-', lpad(m::VARCHAR, 2, '0'), '-', lpad(d::VARCHAR, 2, '0')) AS DATE), '%Y-%m-%d') AS iso
    FROM (SELECT o_orderkey, o_orderkey % 100 AS y, 1 + o_orderkey % 13 AS m, 1 + o_orderkey % 31 AS d FROM orders)""",
    plain=True,
)
def check_dates(v, spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).alias("y"), (1 + F.col("o_orderkey") % 13).alias("m"), (1 + F.col("o_orderkey") % 31).alias("d"))
    return o.select("o_orderkey", F.when(F.col("y") < 50, F.col("y") + 2000).otherwise(F.col("y") + 1900).alias("year"), X.check_date(F.col("y"), F.col("m"), F.col("d")).alias("iso"))


@query(
    sql="""SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 3 WHEN 0 THEN (l_quantity::INT * 1000 + 250)::DOUBLE WHEN 1 THEN l_quantity::INT + 0.21::DOUBLE ELSE l_quantity::INT::DOUBLE END, 2) AS amount FROM lineitem""",
    plain=True,
)
def parse_amounts(v, spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    said = F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit(",250.00"))).when(F.col("l_linenumber") % 3 == 1, F.concat(q, F.lit(",21"))).otherwise(q)
    return li.select("l_orderkey", "l_linenumber", X.parse_amount(said).alias("amount"))


@query("photos", "SELECT a.id AS a, b.id AS b, round(1 - least(a.width / a.height, b.width / b.height) / greatest(a.width / a.height, b.width / b.height), 6) AS d FROM photos a JOIN photos b ON a.sha256 = b.sha256 AND a.id < b.id")
def aspect_differences(v, spark, sf_dir):
    p = v("photos").select("id", "sha256", "width", "height")
    a, b = p.alias("a"), p.alias("b")
    d = aspect_difference(F.col("a.width"), F.col("a.height"), F.col("b.width"), F.col("b.height"))
    return a.join(b, F.expr("a.sha256 = b.sha256 and a.id < b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(d, 6).alias("d"))


@query("photos", "SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 10240 THEN printf('%.1f KB', floor(size / 1024.0::DOUBLE * 10 + 0.5) / 10) WHEN size < 1048576 THEN floor(size / 1024.0::DOUBLE + 0.5)::BIGINT || ' KB' WHEN size < 10485760 THEN printf('%.1f MB', floor(size / 1048576.0::DOUBLE * 10 + 0.5) / 10) ELSE floor(size / 1048576.0::DOUBLE + 0.5)::BIGINT || ' MB' END AS shown, floor(sharpness)::BIGINT AS percent FROM photos")
def shown_sizes(v, spark, sf_dir):
    return v("photos").select("id", X.format_bytes(F.col("size")).alias("shown"), F.when(F.col("sharpness").isNotNull(), X.percent_floor(F.col("sharpness"), F.lit(100))).alias("percent"))


@query(
    "photos matches",
    _GROUPS
    + """, every AS (SELECT d.id, 1 AS rank, 'Lower-quality copy' AS reason, group_id AS keep FROM dups d JOIN photos p USING (id) JOIN photos q ON q.id = group_id WHERE place > 1 AND p.sha256 <> q.sha256
    UNION ALL SELECT id, 2, 'Blurrier burst shot', top FROM (SELECT id, first(id) OVER (PARTITION BY substr(uploaded_at, 1, 13) ORDER BY coalesce(sharpness, 0) DESC, id) AS top FROM photos WHERE camera) WHERE id <> top
    UNION ALL SELECT id, 3, 'Very blurry', NULL FROM photos WHERE sharpness < 45
    UNION ALL SELECT id, 5, 'Meme', NULL FROM photos WHERE filename LIKE '%.webp'
    UNION ALL SELECT id, 4, 'Screenshot', NULL FROM photos WHERE filename LIKE 'Screenshot%'
    UNION ALL SELECT id, 6, 'Forwarded image', NULL FROM photos WHERE filename LIKE 'IMG-%'),
    one AS (SELECT id, arg_min(struct_pack(rank := rank, keep := keep, reason := reason), rank) AS r FROM every GROUP BY id)
    SELECT id, r.reason AS reason, r.keep AS keep, r.rank < 4 AS ticked, CASE WHEN row_number() OVER (PARTITION BY sha256 ORDER BY r.rank, id) > 1 THEN 0 ELSE size END AS bytes, size FROM one JOIN photos USING (id)""",
)
def cleanup(v, spark, sf_dir):
    p = v("photos")
    auto = p.where("filename like 'Screenshot%'").select(F.lit("screenshots").alias("album"), "id").unionByName(p.where("filename like 'IMG-%'").select(F.lit("forwarded").alias("album"), "id"))
    auto = auto.unionByName(p.where("filename like '%.webp'").select(F.lit("memes").alias("album"), "id"))
    shots = p.where("camera").select(F.substring("uploaded_at", 1, 13).alias("burst"), "id")  # those of one hour
    return B.cleanup(p, G.duplicate_groups(p, v("matches")), shots, auto)


@query(
    sql="""WITH n AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    r AS (SELECT event_id AS id, ts AS taken, event_id // 2 % 400 AS content, event_id // 3 % n AS k FROM events, n),
    s AS (SELECT id, taken, v FROM (SELECT *, row_number() OVER (PARTITION BY content, k ORDER BY taken, id) AS first FROM r) JOIN e USING (k) WHERE first = 1),
    o AS (SELECT *, CASE WHEN epoch(taken) - epoch(lag(taken) OVER w) <= 600 AND list_inner_product(v, lag(v) OVER w) >= 0.1 THEN 0 ELSE 1 END AS opens FROM s WINDOW w AS (ORDER BY taken, id)),
    g AS (SELECT *, sum(opens) OVER (ORDER BY taken, id) AS k FROM o), b AS (SELECT id, first(id) OVER (PARTITION BY k ORDER BY taken, id) AS burst, count(*) OVER (PARTITION BY k) AS n FROM g)
    SELECT burst, id FROM b WHERE n > 1""",
    plain=True,
)
def bursts(v, spark, sf_dir):
    """Ten minutes and a cosine of 0.1, each shot with an embedding; shots of one content and vector count once."""
    e = table(spark, sf_dir, "embeddings")
    shots = table(spark, sf_dir, "events").withColumn("k", F.expr(f"event_id div 3 % {max(1, e.count())}"))
    shots = shots.join(e.select(F.col("vec_id").alias("k"), F.col("embedding").alias("vector")), "k")
    content = F.concat_ws(":", F.expr("event_id div 2 % 400"), "k")
    return B.bursts(shots.select(F.col("event_id").alias("id"), content.alias("sha256"), F.col("ts").alias("taken"), "vector"), 600, 0.1)


@query(
    sql=f"""WITH RECURSIVE {_H.strip()}, d AS (SELECT DISTINCT p FROM h), e AS (SELECT a.p AS a, b.p AS b FROM d a JOIN d b ON a.p <> b.p AND bit_count(xor(a.p, b.p)) <= 10),
    reach AS (SELECT p AS node, p AS other FROM d UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
    comp AS (SELECT node, min(other) AS c FROM reach GROUP BY node),
    m AS (SELECT id, c, count(*) OVER (PARTITION BY c) AS n, min(id) OVER (PARTITION BY c) AS first FROM h JOIN comp ON p = node)
    SELECT first, id FROM m WHERE n > 1""",
    plain=True,
)
def meme_groups(v, spark, sf_dir):
    """Every hashed photo as a meme, its pHash for the core hash."""
    photos = hashed_photos(spark, sf_dir).withColumn("core_hash", F.col("phash"))
    made = G.meme_groups(photos, photos.select("id"))
    return made.join(made.groupBy("component").agg(F.min("id").alias("first")), "component").select("first", "id")
