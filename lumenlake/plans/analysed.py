"""Queries over what is read from photos: text, receipts, vectors, people, albums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import text as X
from lumenlake.functions import vectors as V
from lumenlake.functions.entities import explode_entities, split_words, with_entities
from lumenlake.functions.receipts import alike_together, with_printed_rows, with_receipt
from lumenlake.operators import albums as A
from lumenlake.operators import spending as M
from lumenlake.operators import subjects as S
from lumenlake.operators.edits import normalise_fixes as normalise
from lumenlake.plans.register import query
from lumenlake.plans.views import PAD
from lumenlake.sources.analyses import parse_analyses as parse
from lumenlake.sources.scratch import cut, discard, materialise_all, table


#: Receipts that are put together, read and compared at a time: their shuffle files are on disk together.
ROWS_A_SLICE = 20_000_000


@query()
def entities(v, spark, sf_dir):
    return explode_entities(with_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), "text"), "doc_id")


_SHOP = "translate({}, '0123456789#', 'abcdefghij ')"


@query(
    "receipts",
    f"""
    SELECT id, CASE WHEN total IS NOT NULL THEN coalesce({_SHOP.format("shop")}, 'Corner Store') END AS shop, CASE WHEN total IS NOT NULL THEN date END AS date, total,
        CASE WHEN total IS NOT NULL THEN currency END AS currency, CASE WHEN total IS NOT NULL THEN item END AS item, CASE WHEN total IS NOT NULL THEN item_amount END AS item_amount
    FROM receipts""",
)
def read_receipts(v, spark, sf_dir):
    """Receipts written out as text and read back."""
    rows = v("receipts")
    # reading costs far more than moving the rows, so they are spread first
    read = with_receipt(alike_together(rows.select("id", _written().alias("text")), "text"), "text")
    one = F.try_element_at(F.col("receipt.items"), F.lit(1))
    return read.select("id", "receipt.shop", "receipt.date", "receipt.total", "receipt.currency", one["name"].alias("item"), one["amount"].alias("item_amount"))


def _written() -> Column:
    """A row of the receipts view as the text of its photo."""
    day = F.date_format(F.col("date").cast("date"), "dd/MM/yyyy")
    shop = F.coalesce(F.expr(_SHOP.format("shop")), F.lit("Corner Store"))
    item = F.concat("item", F.lit("   "), F.format_string("%.2f", "item_amount"))
    total = F.concat(F.lit("TOTAL "), "currency", F.lit(" "), F.format_string("%.2f", "total"))
    return F.concat_ws("\n", shop, F.concat(F.lit("Date: "), day), item, F.when(F.col("total").isNotNull(), total))


@query(
    "receipts",
    f"""SELECT id, coalesce({_SHOP.format("shop")}, 'Corner Store') AS shop, date, CASE WHEN total IS NOT NULL THEN total END AS total, '₹' AS currency, 'payment' AS kind FROM receipts""",
)
def read_payments(v, spark, sf_dir):
    """Payments written out as a screenshot's text and read back."""
    shop = F.coalesce(F.expr(_SHOP.format("shop")), F.lit("Corner Store"))
    paid = F.when(F.col("total").isNotNull(), F.concat(F.lit("₹ "), F.format_string("%.2f", "total")))
    said = F.concat_ws("\n", F.lit("Payment successful"), F.concat(F.lit("Paid to "), shop), paid, F.lit("UPI transaction id seven"), F.date_format(F.col("date").cast("date"), "dd/MM/yyyy"))
    read = with_receipt(alike_together(v("receipts").select("id", said.alias("text")), "text"), "text")
    return read.select("id", *[f"receipt.{c}" for c in ("shop", "date", "total", "currency", "kind")])


@query(
    sql="""WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents),
    r AS (SELECT doc_id, (i - 1) // 8 AS line, string_agg(ws[i], ' ' ORDER BY i) AS said FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w) GROUP BY ALL),
    t AS (SELECT doc_id, string_agg(said, chr(10) ORDER BY line) AS printed FROM r GROUP BY doc_id)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(printed, '') END AS printed FROM documents LEFT JOIN t USING (doc_id)""",
    plain=True,
)
def printed_rows(v, spark, sf_dir):
    """The words of every text as boxes, eight a row of a slightly turned page and in the order of a hash, put back into rows."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    x, y = lambda i: (i % 8) / 8.0, lambda i: F.floor(i / 8) * 0.03
    box = lambda i: F.array(x(i), y(i) + (x(i) + 0.04) * 0.02, F.lit(0.08), F.lit(0.02))
    line = lambda i: F.floor(i / 8).cast("int")
    # sort_array compares whole rows at once, array_sort calls a function for each two
    mixed = F.sort_array(F.transform(words, lambda w, i: F.struct(F.xxhash64(w, line(i)).alias("h"), w.alias("text"), box(i).alias("box"), line(i).alias("line"))))
    return with_printed_rows(table(spark, sf_dir, "documents").select("doc_id", mixed.alias("words")), "words").select("doc_id", "printed")


@query(
    sql="""SELECT vec_id AS id, reason, CASE WHEN reason IS NULL THEN least(1.0::DOUBLE, (vec_id % 30) / 10.0::DOUBLE) END AS flatness, CASE WHEN reason IS NULL THEN CAST(greatest(1, least(100, vec_id % 150)) AS INT) END AS jpeg_quality,
    CASE WHEN reason IS NULL THEN concat('HOTEL ', label) END AS ocr_text, CASE WHEN reason IS NULL THEN round(list_sum(embedding::DOUBLE[]), 4) END AS total
    FROM (SELECT *, CASE vec_id % 10 WHEN 0 THEN 'json' WHEN 1 THEN 'version' WHEN 2 THEN 'vector' WHEN 3 THEN 'core_hash' WHEN 4 THEN 'box' END AS reason FROM embeddings)""",
    plain=True,
)
def parse_analyses(v, spark, sf_dir):
    """Results of all embeddings as JSON, half of them with a fault of one kind."""
    e = V.encode_vectors(table(spark, sf_dir, "embeddings"), "embedding").withColumn("k", F.col("vec_id") % 10)
    clip = F.base64(F.when(F.col("k") == 2, F.substring("embedding", 1, 40)).otherwise(F.col("embedding")))
    box = F.array(F.lit(0.1), F.lit(0.1), F.lit(0.2), F.when(F.col("k") == 4, 2.0).otherwise(0.1))
    word = lambda t: F.struct(t.alias("text"), box.alias("box"), F.lit(0).alias("line"))
    fields = F.struct(F.when(F.col("k") == 1, 5).otherwise(6).alias("version"), clip.alias("clip"), F.array(word(F.lit("HOTEL")), word(F.lit("")), word(F.col("label").cast("string"))).alias("words"), ((F.col("vec_id") % 30) / 10).alias("flatness"), (F.col("vec_id") % 150).alias("jpeg_quality"), F.when(F.col("k") == 3, "xyz").otherwise("0123456789abcdef").alias("core_hash"))
    said = e.select(F.col("vec_id").alias("id"), F.when(F.col("k") == 0, "{not").otherwise(F.to_json(fields)).alias("json"))
    size = table(spark, sf_dir, "embeddings").select(F.max(F.size("embedding"))).first()[0] or 1
    good, bad = parse(said, size=size)
    total = F.round(F.aggregate("clip", F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    return good.select("id", F.lit(None).cast("string").alias("reason"), "flatness", "jpeg_quality", "ocr_text", total.alias("total")).unionByName(bad.select("id", "reason"), True)


_FIXED = """CASE cast(regexp_extract(id, 'r([0-9]+)', 1) as bigint) % 10 WHEN 1 THEN '{"shop":"Corner Store","total":"12.5"}' WHEN 2 THEN '{"total":null}' WHEN 3 THEN '{"receipt":"false"}' WHEN 4 THEN '{"receipt":"true"}' END"""


@query(
    "receipts",
    rf"""WITH u AS (SELECT id, min(shop) AS shop, min(date) AS date, min(total) AS total, min(currency) AS currency, min(sharpness) AS sharpness, min(uploaded_at) AS uploaded_at FROM receipts GROUP BY id),
    r AS (SELECT id, sharpness, uploaded_at, cast(regexp_extract(id, 'r([0-9]+)', 1) AS bigint) % 10 AS k, total IS NOT NULL AS seen,
        CASE WHEN total IS NOT NULL THEN coalesce({_SHOP.format("shop")}, 'Corner Store') END AS s, CASE WHEN total IS NOT NULL THEN date END AS date, total AS t, CASE WHEN total IS NOT NULL THEN currency END AS c FROM u),
    x AS (SELECT id, sharpness, uploaded_at, date, CASE k WHEN 1 THEN 'Corner Store' ELSE s END AS shop, CASE k WHEN 1 THEN 12.5::DOUBLE WHEN 2 THEN NULL ELSE t END AS total, coalesce(c, '₹') AS currency,
        CASE k WHEN 1 THEN 'shop,total' WHEN 2 THEN 'total' ELSE '' END AS edited FROM r WHERE k <> 3 AND (seen OR k = 4)),
    f AS (SELECT *, first(id) OVER (PARTITION BY substr(regexp_replace(lower(shop), '[\s\-_.,:;!?''"()/]+', '', 'g'), 1, 16), date, total ORDER BY coalesce(sharpness, 0) DESC, uploaded_at DESC, id) AS kept FROM x)
    SELECT id, shop, date, total, currency, edited, CASE WHEN shop IS NOT NULL AND date IS NOT NULL AND total IS NOT NULL AND kept <> id THEN kept END AS copy_of FROM f""",
)
def all_receipts(v, spark, sf_dir):
    """Photos of receipts read, corrected, and marked where one stands on two photos."""
    least = [F.min(c).alias(c) for c in ("shop", "date", "total", "currency", "item", "item_amount", "sharpness", "uploaded_at", "size", "filename")]
    slices = -(-table(spark, sf_dir, "lineitem").count() // ROWS_A_SLICE) or 1

    def one(rows: DataFrame) -> DataFrame:
        photos = rows.groupBy("id").agg(*least)  # ids repeat in the view
        photos = photos.withColumn("ocr_text", _written()).withColumn("receipt_fix", F.from_json(F.expr(_FIXED), "map<string,string>"))
        return photos.select("id", "ocr_text", "receipt_fix", "sharpness", "uploaded_at", "size", "filename")

    photos = materialise_all([one(rows) for rows in cut(v("receipts"), slices, "id")], "receipt-photos")  # a table, as a catalogue has it
    made = M.all_receipts(photos, slices)
    discard(photos)
    return made.select("id", "shop", "date", "total", "currency", F.array_join("edited", ",").alias("edited"), "copy_of")


def _photos(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr(PAD("vec_id")).alias("id"), "vec_id", F.col("embedding").alias("clip"), F.concat(F.lit("2024-"), F.lpad((F.col("vec_id") * 7 % 1000).cast("string"), 4, "0")).alias("uploaded_at"))


_E = f"e AS (SELECT vec_id, {PAD('vec_id')} AS id, CAST(embedding AS DOUBLE[]) AS v, concat('2024-', lpad(cast(vec_id * 7 % 1000 as string), 4, '0')) AS uploaded_at, label FROM embeddings)"


@query(
    "matches faces",
    f"""WITH {_E}, f AS (SELECT DISTINCT photo_id FROM faces),
    p AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) AS s, a.uploaded_at AS ua, b.uploaded_at AS ub FROM e a JOIN e b ON a.id < b.id WHERE list_inner_product(a.v, b.v) >= 0.4)
    SELECT CASE WHEN (ua, a) > (ub, b) THEN a ELSE b END AS photo_a, CASE WHEN (ua, a) > (ub, b) THEN b ELSE a END AS photo_b, 'subject' AS kind, round(least(s, 0.99), 3) AS similarity
    FROM p WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE least(photo_a, photo_b) = a AND greatest(photo_a, photo_b) = b) AND NOT (a IN (FROM f) AND b IN (FROM f))""",
)
def subject_pairs(v, spark, sf_dir):
    return S.subject_pairs(_photos(spark, sf_dir), v("faces"), v("matches"), t=0.4)


def _faces(v, spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    return v("faces").join(own, "id")


@query(
    "faces",
    """WITH k AS (SELECT f.*, CAST(embedding AS DOUBLE[]) AS v FROM faces f JOIN embeddings ON id = concat('f', cast(vec_id as string))),
    n AS (SELECT concat('n', id) AS id, photo_id, list_transform(v, lambda x, i: v[1 + i % len(v)] * 0.1 + x) AS v FROM k),
    s AS (SELECT n.id, k.person_id, row_number() OVER (PARTITION BY n.id ORDER BY list_inner_product(n.v, k.v) DESC, k.id) AS r, list_inner_product(n.v, k.v) AS s FROM n JOIN k USING (photo_id))
    SELECT id, person_id FROM s WHERE r = 1 AND s > 0.9 AND person_id IS NOT NULL""",
)
def carry_over_people(v, spark, sf_dir):
    """Every face comes again, a little changed."""
    old = _faces(v, spark, sf_dir)
    wide = F.transform("embedding", lambda x: x.cast("double"))
    changed = F.zip_with(wide, F.concat(F.slice(wide, 2, 1 << 20), F.slice(wide, 1, 1)), lambda x, y: y * 0.1 + x)
    return S.carry_over_people(old.select(F.concat(F.lit("n"), "id").alias("id"), "photo_id", changed.alias("embedding")), old)


@query(
    "faces people",
    """WITH RECURSIVE k AS (SELECT f.*, CAST(embedding AS DOUBLE[]) AS v FROM faces f JOIN embeddings ON id = concat('f', cast(vec_id as string))),
    near AS (SELECT a.id AS a, b.id AS b, b.person_id AS person, list_inner_product(a.v, b.v) AS s FROM k a JOIN k b ON a.photo_id <> b.photo_id AND a.id <> b.id AND a.person_id IS NULL WHERE list_inner_product(a.v, b.v) >= 0.4),
    score AS (SELECT a, person, max(s) AS s, any_value(name) AS name, any_value(coalesce(manual, false)) AS manual FROM near JOIN people ON people.id = person GROUP BY a, person),
    fixed AS (SELECT a AS id, arg_min(person, struct_pack(s := -s, p := person)) AS person_id FROM score GROUP BY a HAVING bool_or(manual)),
    free AS (SELECT * FROM score WHERE a NOT IN (SELECT id FROM fixed)),
    e AS (SELECT concat('f:', a) AS x, concat('p:', person) AS y FROM free
        UNION SELECT concat('f:', a), concat('f:', b) FROM near WHERE person IS NULL AND a NOT IN (SELECT id FROM fixed) AND b NOT IN (SELECT id FROM fixed)),
    both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    reach AS (SELECT x AS node, x AS other FROM both_ways UNION SELECT node, y FROM reach JOIN both_ways ON other = x),
    member AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
    best AS (SELECT component, arg_min(person, struct_pack(n := name IS NULL, s := -s, p := person)) AS keep FROM free JOIN member ON node = concat('f:', a) GROUP BY component)
    SELECT id, person_id FROM fixed
    UNION ALL SELECT k.id, coalesce(keep, concat('new-', coalesce(component[3:], k.id))) FROM k LEFT JOIN member ON node = concat('f:', k.id) LEFT JOIN best USING (component) WHERE person_id IS NULL AND k.id NOT IN (SELECT id FROM fixed)
    UNION ALL SELECT k.id, keep FROM k JOIN member ON node = concat('p:', person_id) JOIN best USING (component) WHERE keep <> person_id""",
)
def assign_people(v, spark, sf_dir):
    """Faces without a person, against all that have one."""
    faces = _faces(v, spark, sf_dir)
    return S.assign_people(faces.where("person_id is null"), faces.where("person_id is not null"), v("people"), t=0.4)


def _centroids(spark, sf_dir) -> dict[int | None, np.ndarray]:
    """The mean vector of each label and (None) of all: as many rows as there are labels."""
    cell = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    row = lambda: F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("v")
    by = cell.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(row()).collect()
    every = cell.groupBy("i").agg(F.avg("x").alias("m")).agg(row()).collect()
    return {r["label"]: np.array(r["v"]) for r in by} | {None: np.array(every[0]["v"])}


_CENTROIDS = """
    x AS (SELECT label, i, avg(v[i]) AS m FROM e, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY ALL),
    c AS (SELECT label, list(m ORDER BY i) AS cv FROM x GROUP BY label),
    y AS (SELECT i, avg(v[i]) AS m FROM e, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY i),
    g AS (SELECT list(m ORDER BY i) AS gv FROM y)"""


@query(
    "",
    f"""WITH {_E}, {_CENTROIDS},
    s AS (SELECT c.label, id, list_inner_product(v, cv) - list_inner_product(v, gv) AS s, vec_id % 7 = c.label % 7 AS found FROM e, c, g),
    b AS (SELECT label, max(s) AS best FROM s GROUP BY label)
    SELECT concat('q', cast(label as string)) AS query, id, round(s + CASE WHEN found THEN 0.025 ELSE 0 END, 6) AS score FROM s JOIN b USING (label) WHERE found OR s >= greatest(0.015, best - 0.045)""",
    plain=True,
)
def smart_search(v, spark, sf_dir):
    """One query for each label: its mean vector and a word."""
    c = _centroids(spark, sf_dir)
    photos = _photos(spark, sf_dir).withColumn("ocr_text", F.concat(F.lit("WORD-"), (F.col("vec_id") % 7).cast("string")))
    wanted = [(f"q{k}", f"word{k % 7} pizza", vec) for k, vec in c.items() if k is not None]
    return A.smart_search(photos, wanted, c[None]).withColumn("score", F.round("score", 6))


def _auto(v, spark, sf_dir) -> DataFrame:
    c = _centroids(spark, sf_dir)
    """Captions by photo number: 0 of 4 has one above and one below (4 of 8 with forty more words), 1 of 4 small ones, 2 of 4 one above alone."""
    n = F.substring("id", 2, 20).cast("long")
    word = lambda y, h, line: F.struct(F.lit("WORD").alias("text"), F.array(F.lit(0.1), F.lit(y), F.lit(0.8), F.lit(h)).alias("box"), F.lit(line).alias("line"))
    caption = F.when(n % 4 == 0, F.array(word(0.05, 0.08, 0), word(0.85, 0.08, 1))).when(n % 4 == 1, F.array(word(0.05, 0.02, 0), word(0.85, 0.02, 1))).when(n % 4 == 2, F.array(word(0.05, 0.08, 0)))
    words = F.when(n % 8 == 4, F.concat(caption, F.array_repeat(word(0.5, 0.02, 2), 40))).otherwise(caption)
    photos = v("photos").join(_photos(spark, sf_dir).select("id", "clip"), "id").withColumn("ocr_words", words)
    return A.auto_albums(photos, v("faces"), {"pets": c[1], "animals": c[2], "beach": np.stack([c[3], c[4]])}, c[None], c[5], c[6])


@query(
    "photos faces",
    f"""WITH {_E}, {_CENTROIDS},
    s AS (SELECT photos.*, list_inner_product(v, gv) AS base, list_inner_product(v, (SELECT cv FROM c WHERE label = 1)) - base AS pets, list_inner_product(v, (SELECT cv FROM c WHERE label = 2)) - base AS animals,
        greatest(list_inner_product(v, (SELECT cv FROM c WHERE label = 3)), list_inner_product(v, (SELECT cv FROM c WHERE label = 4))) - base AS beach,
        list_inner_product(v, (SELECT cv FROM c WHERE label = 5)) - list_inner_product(v, (SELECT cv FROM c WHERE label = 6)) AS doc,
        regexp_matches(lower(filename), 'screen ?shot|screen[_-]?capture|scrnli') OR (content_type IN ('image/png', 'image/webp', 'image/bmp', 'image/gif') AND taken_at IS NULL AND flatness >= 0.45) AS shot,
        list_filter(string_split_regex(lower(coalesce(ocr_text, '')), '\\s+'), lambda x: x <> '') AS words FROM photos JOIN e USING (id), g)
    SELECT 'pets' AS album, id, round(pets, 6) AS score FROM s WHERE pets >= 0.02 AND NOT (animals >= 0.02 AND pets < animals)
    UNION ALL SELECT 'animals', id, round(animals, 6) FROM s WHERE animals >= 0.02 AND NOT (pets >= 0.02 AND pets >= animals)
    UNION ALL SELECT 'beach', id, round(beach, 6) FROM s WHERE beach >= 0.02
    UNION ALL SELECT 'documents', id, round(doc, 6) FROM s WHERE NOT shot AND (doc >= 0.035 OR len(words) >= 20
        OR len(list_filter(words, lambda x: regexp_matches(x, 'total|amount|invoice|receipt|qty|cash|change|gst|tax|bill'))) >= 2)
    UNION ALL SELECT 'screenshots', id, round(flatness, 6) FROM s WHERE shot
    UNION ALL SELECT 'memes', id, 1.0::DOUBLE FROM s WHERE NOT shot AND CAST(substr(id, 2) AS BIGINT) % 8 = 0
    UNION ALL SELECT 'forwarded', id, 100.0::DOUBLE - jpeg_quality FROM s WHERE regexp_matches(filename, '(?i)^IMG-[0-9]{{8}}-WA[0-9]+') OR (content_type = 'image/jpeg' AND NOT camera AND jpeg_quality <= 70 AND greatest(width, height) <= 1600)
    UNION ALL SELECT 'people', photo_id, count(*)::DOUBLE FROM faces GROUP BY photo_id""",
)
def auto_albums(v, spark, sf_dir):
    return _auto(v, spark, sf_dir).withColumn("score", F.round("score", 6))


@query()
def suggest_album_names(v, spark, sf_dir):
    """For every album of the catalogue."""
    names = A.suggest_album_names(v("album_photos"), v("photos"), _auto(v, spark, sf_dir).select("album", "id"))
    return names.select("album_id", F.array_join("names", "|").alias("names"))


@query(
    "receipts",
    """
    SELECT id, trim(regexp_replace(shop, '\\s+', ' ', 'g')) AS shop, CASE WHEN total > 2 THEN NULL ELSE total END AS total, currency
    FROM (SELECT id, min(shop) AS shop, min(date) AS date, min(total) AS total, min(currency) AS currency FROM receipts WHERE total IS NOT NULL GROUP BY id) WHERE date IS NOT NULL AND total < 4""",
)
def normalise_fixes(v, spark, sf_dir):
    """Two edits of each receipt: its shop, total and currency, then, for totals over 2, the total cleared; one edit with a bad date or total goes."""
    rows = v("receipts").where("total is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("shop", "date", "total", "currency")])
    first = rows.select("id", F.lit(1).alias("moment"), F.create_map(F.lit("shop"), F.concat(F.lit("  "), F.col("shop")), F.lit("total"), F.when(F.col("total") < 4, F.col("total").cast("string")).otherwise("-1"), F.lit("date"), F.coalesce("date", F.lit("soon")), F.lit("currency"), F.col("currency")).alias("sent"))
    second = rows.where("total > 2 and total < 4 and date is not null").select("id", F.lit(2).alias("moment"), F.create_map(F.lit("total"), F.lit(None).cast("string")).alias("sent"))
    fixes, _ = normalise(first.unionByName(second))
    return fixes.select("id", F.col("fix")["shop"].alias("shop"), F.col("fix")["total"].cast("double").alias("total"), F.col("fix")["currency"].alias("currency"))


@query(sql="SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last, len(embedding) AS n FROM embeddings", plain=True)
def vector_bytes(v, spark, sf_dir):
    """Vectors to bytes and back."""
    e = V.decode_vectors(V.encode_vectors(table(spark, sf_dir, "embeddings"), "embedding"), "embedding")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"), F.size("embedding").cast("long").alias("n"))


_LETTERS = r"list_distinct(regexp_extract_all(coalesce(text, ''), '\p{L}'))"


@query(sql=f"SELECT doc_id, len(l) >= 3 AND len(list_filter(l, lambda x: x >= 'ऀ' AND x <= 'ॿ')) >= 0.8 * len(l) AS hindi FROM (SELECT doc_id, {_LETTERS} AS l FROM documents)", plain=True)
def in_script(v, spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.in_script(F.col("text"), "hindi").alias("hindi"))


@query(sql="SELECT doc_id, md5(regexp_replace(replace(text, 'a', '\u093f\u0915'), '\u093f([\u0915-\u0939\\x{0958}-\\x{095F}]\u093c?)', '\\1\u093f', 'g')) AS digest FROM documents", plain=True)
def logical_order(v, spark, sf_dir):
    """Every letter a written as a vowel sign before its consonant, and put right."""
    text = F.replace("text", F.lit("a"), F.lit("\u093f\u0915"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.logical_order(text)).alias("digest"))


@query(sql="SELECT o_orderkey, round(CAST(o_totalprice AS DOUBLE) * 88, 2) AS inr FROM orders", plain=True)
def rupees(v, spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(X.to_inr(F.col("o_totalprice").cast("double")), 2).alias("inr"))


@query(sql=r"SELECT item_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))) AS BIGINT) AS words FROM benchmark", plain=True)
def split_lines(v, spark, sf_dir):
    """Words of benchmark items, each character placed by its number."""
    n = F.greatest(F.length("text"), F.lit(1))
    where = F.transform(F.sequence(F.lit(1), n), lambda k: k / n)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(split_words(F.col("text"), where, 0.001)).cast("long").alias("words"))


@query(sql="SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN 2 ELSE 1 END AS hits FROM embeddings", plain=True)
def highlights(v, spark, sf_dir):
    """Words to outline for the search 'the menu with pizza3'."""
    box = lambda k: F.array(*[F.lit(x / 10) for x in (k, k, 1, 1)])
    word = lambda text, k: F.struct(text.alias("text"), box(k).alias("box"))
    words = F.array(word(F.lit("MENU:"), 1), word(F.concat(F.lit("Pizza-"), (F.col("vec_id") % 7).cast("string")), 2), word(F.lit("me"), 3))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(X.highlights(words, F.lit("the menu with pizza3"))).alias("hits"))


@query(
    sql="""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)
    SELECT item_id, array_to_string(list_transform(range(CAST(ceil(len(w) / 8.0) AS BIGINT)), lambda k: array_to_string(w[k * 8 + 1:k * 8 + 8], ' ')), chr(10)) AS text FROM w""",
    plain=True,
)
def pictured_words(v, spark, sf_dir):
    """Benchmark items as word boxes of eight a line, put back into text by line."""
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("text"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.1), F.lit(0.1)).alias("box"), F.floor(i / 8).cast("int").alias("line")))
    return table(spark, sf_dir, "benchmark").select("item_id", X.text_of(words, by_line=True).alias("text"))
