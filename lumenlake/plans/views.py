"""Catalogue-shaped views over the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lumenlake.sources.scratch import table

PAD = "concat('p', lpad(cast({} as string), 8, '0'))".format
TWO = "lpad(cast({} as string), 2, '0')".format


def _photos(sha: str, squeezed: str) -> str:
    return f"""
    SELECT {PAD("doc_id")} AS id,
        CASE doc_id % 6 WHEN 0 THEN concat('IMG-20240105-WA', lpad(cast(doc_id % 10000 as string), 4, '0'), '.jpg')
            WHEN 1 THEN concat('Screenshot_', cast(doc_id as string), '.png') WHEN 2 THEN concat(source, '_', lang, '.webp')
            ELSE concat('DSC_', cast(doc_id as string), '.jpg') END AS filename,
        CASE doc_id % 6 WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' ELSE 'image/jpeg' END AS content_type,
        n_chars * 10 AS size, cast(1000 + doc_id % 5 * 300 as int) AS width, cast(800 + doc_id % 3 * 200 as int) AS height,
        {sha} AS sha256,
        concat('2024-', {TWO("1 + doc_id % 12")}, '-', {TWO("1 + doc_id % 28")}, 'T', {TWO("doc_id % 24")}, ':', {TWO("doc_id % 60")}, ':00+00:00') AS uploaded_at,
        CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('2023-', {TWO("1 + doc_id % 11")}, '-', {TWO("1 + doc_id % 27")}, 'T', {TWO("doc_id % 23")}, ':00:00') END AS taken_at,
        CASE WHEN doc_id % 11 = 0 THEN NULL ELSE cast(doc_id * 37 % 1000 as double) / 10 END AS sharpness,
        doc_id % 9 = 0 AS favorite,
        CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS ocr_text,
        CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {squeezed} END AS ocr_search,
        CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'done' WHEN 2 THEN 'failed' WHEN 3 THEN 'processing' ELSE 'done' END AS ai_status,
        CASE WHEN doc_id % 5 = 3 THEN concat('w', cast(doc_id % 40 as string)) END AS ai_worker,
        CASE doc_id % 7 WHEN 0 THEN NULL ELSE cast(3 + doc_id % 5 as int) END AS ai_version,
        cast(doc_id % 100 as double) / 100 AS flatness, cast(40 + doc_id % 60 as int) AS jpeg_quality, doc_id % 2 = 0 AS camera
    FROM {{documents}}"""


BASE = {
    "matches": f"""
    SELECT {PAD("d.doc_id")} AS photo_a, {PAD("f.first")} AS photo_b, 'exact' AS kind, cast(1.0 as double) AS similarity
        FROM {{documents}} d JOIN (SELECT text, min(doc_id) AS first FROM {{documents}} GROUP BY text) f ON d.text = f.text WHERE d.doc_id > f.first
    UNION ALL SELECT {PAD("doc_id")}, {PAD("doc_id - 1")}, 'similar', cast(90 - doc_id % 10 as double) / 100 FROM {{documents}} WHERE doc_id % 13 = 1
    UNION ALL SELECT {PAD("doc_id")}, {PAD("doc_id - 3")}, 'subject', cast(85 + doc_id % 7 as double) / 100 FROM {{documents}} WHERE doc_id % 17 IN (3, 6)""",
    "faces": f"""
    SELECT concat('f', cast(vec_id as string)) AS id, {PAD("cast((vec_id - vec_id % 2) / 2 as bigint)")} AS photo_id,
        CASE WHEN vec_id % 5 = 0 THEN NULL ELSE concat('n', cast(label as string), '-', cast(vec_id % 3 as string)) END AS person_id,
        cast(vec_id % 7 as double) / 10 AS x, cast(vec_id % 5 as double) / 10 AS y, cast(1 + vec_id % 3 as double) / 10 AS w, cast(1 + vec_id % 4 as double) / 10 AS h
    FROM {{embeddings}}""",
    "people": """
    SELECT DISTINCT concat('n', cast(label as string), '-', cast(vec_id % 3 as string)) AS id, CASE WHEN (label + vec_id % 3) % 3 = 0 THEN NULL ELSE concat('Person ', cast(label as string)) END AS name,
        concat('2024-01-', lpad(cast(1 + label % 28 as string), 2, '0')) AS created_at, CASE WHEN label % 4 = 0 THEN true WHEN label % 4 = 1 THEN NULL ELSE false END AS manual
    FROM {embeddings} WHERE vec_id % 5 <> 0""",
    "albums": "SELECT concat('a', cast(c_custkey as string)) AS id, c_name AS name, concat('2024-', lpad(cast(1 + c_custkey % 12 as string), 2, '0')) AS created_at FROM {customer}",
    "album_photos": f"""
    SELECT DISTINCT concat('a', cast(o_custkey as string)) AS album_id, {PAD("o_orderkey % 1000")} AS photo_id FROM {{orders}}""",
    "receipts": """
    SELECT concat('r', cast(l_orderkey as string), '-', cast(l_linenumber as string)) AS id, CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE s_name END AS shop,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(cast(o_orderdate as date) as string) END AS date,
        CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE cast(cast(l_quantity as int) % 5 as double) + 0.5 END AS total,
        CASE s_nationkey % 4 WHEN 0 THEN '$' WHEN 1 THEN '€' WHEN 2 THEN '' ELSE '£' END AS currency, CASE WHEN l_orderkey % 3 = 0 THEN 'payment' ELSE 'receipt' END AS kind,
        cast(l_quantity as double) AS sharpness, concat('2024-01-', lpad(cast(1 + l_linenumber as string), 2, '0')) AS uploaded_at,
        p_name AS item, cast(p_size as double) + 0.25 AS item_amount, cast(l_quantity as bigint) * 100 AS size, concat('bill', cast(l_orderkey as string), '.jpg') AS filename
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey""",
    "billing": "SELECT concat('service ', l_returnflag) AS service, cast(l_tax as double) AS cost, 'USD' AS currency FROM {lineitem}",
    "deletions": "SELECT event_id AS photo_id, cast(floor(value * 10) as bigint) AS size, event_id % 3 = 0 AS duplicate FROM {events}",
}
TABLES = ("documents", "embeddings", "customer", "orders", "lineitem", "supplier", "part", "events", "pages")
SPARK = BASE | {"photos": _photos("sha2(text, 256)", r"""regexp_replace(lower(text), '[\\s\\-_.,:;!?\\\'"()/]+', '')""")}
DUCK = BASE | {"photos": _photos("sha256(text)", r"""regexp_replace(lower(text), '[\s\-_.,:;!?''"()/]+', '', 'g')""")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SPARK[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def duck(names: str, body: str) -> str:
    """A DuckDB query over the named views."""
    made = [f"{n} AS ({DUCK[n].format(**{t: t for t in TABLES})})" for n in names.split()]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(made) + ", " + body[len("WITH RECURSIVE") :]
    return "WITH " + ", ".join(made) + (", " + body[4:] if body.upper().startswith("WITH") else " " + body)


def views(spark: SparkSession, sf_dir: str):
    return partial(view, spark, sf_dir)
