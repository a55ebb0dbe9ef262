"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import bpe, decontaminate, html, lexical, negatives, passages, pieces, quality, secrets, sharding, simhash, spans, toxicity, urlrules
from lumenlake.sources.scratch import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECE_MODEL = "piece_bpe_32k.model"
#: The rules of op9 (fixed values): host, path, verdict.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and empty texts have fingerprint zero and are linked like any other."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text by a net trained on labels of rows that are not held out; null and empty texts get a score too."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that a repeated run covers; null texts stay null, of equal rows the first keeps its text."""
    return spans.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job of op3: the SQL of op3_substring_dedup fixes its pieces, and so what it cannot see."""
    return passages.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of near equal bytes; equal texts stay together, a null text counts 8 bytes."""
    made = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null and empty texts have no words and fail the base rules."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and entropy spans of every whole text; null texts are empty ones."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by a labeller trained on pages that name theirs; null and empty pages give an empty text."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they contain; texts without a word contain none and are contained in none."""
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page's url; null urls and urls without :// have an empty host and path and are allowed."""
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document as digests; null texts are empty ones."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every anchor and positive; rows without label or finite vector take no part."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item; documents and items without a term have no rows."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document as digests; null texts are empty ones."""
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_toxicity,
        op3_substring_dedup,
        op3_passage_dedup,
        op4_sharding,
        op5_quality,
        op6_secrets,
        op7_html,
        op8_decontamination,
        op9_url_rules,
        op10_bpe,
        op11_hard_negatives,
        op12_lexical_search,
        op13_sentencepiece,
    )
}

_WORD = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]|[^\x09-\x0D \x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]+"

ORACLES = {
    "op3_substring_dedup": rf"""
        WITH split AS (
            SELECT doc_id, text, regexp_extract_all(text, '(?:{_WORD})[\x09-\x0D ]*') AS tokens FROM documents
        ), words AS (
            SELECT doc_id, i, CASE WHEN i = 1 THEN regexp_extract(text, '^[\x09-\x0D ]*') ELSE '' END || tokens[i] AS token,
                lower(regexp_replace(tokens[i], '[\x09-\x0D ]+$', '')) AS word, len(tokens) AS n
            FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM split)
        ), ranked AS (
            SELECT *, CASE WHEN regexp_matches(word, '[.!?。！？]["'')\]”’»]*$') THEN '' ELSE md5(word)[1:15] END AS h FROM words
        ), least_of AS (
            SELECT *, CASE WHEN i + 9 <= n THEN min(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) END AS m FROM ranked
        ), closing AS (
            SELECT *, h = '' OR i = n OR coalesce(h = max(m) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), false) AS closes FROM least_of
        ), numbered AS (
            SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k FROM closing
        ), sentences AS (
            SELECT doc_id, k, min(i) AS lo, max(i) AS hi, string_agg(token, '' ORDER BY i) AS whole FROM numbered GROUP BY doc_id, k
        ), lists AS (
            SELECT doc_id, list(word ORDER BY i) AS ws FROM numbered GROUP BY doc_id
        ), ends AS (
            SELECT p.doc_id, p.k, min(q.k) AS last, p.lo, min(q.hi) AS hi
            FROM sentences p JOIN sentences q ON p.doc_id = q.doc_id AND q.k BETWEEN p.k + 1 AND p.k + 11 AND q.hi - p.lo + 1 >= 12 GROUP BY ALL
        ), runs AS (
            SELECT doc_id, k, last, row_number() OVER (PARTITION BY ws[lo:hi] ORDER BY doc_id, k) AS place FROM ends JOIN lists USING (doc_id)
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(range(k, last + 1)) AS k FROM runs WHERE place > 1
        ), made AS (
            SELECT s.doc_id, count(*) AS n_sentences, count(c.k) AS n_removed, string_agg(CASE WHEN c.k IS NULL THEN whole ELSE '' END, '' ORDER BY s.k) AS text
            FROM sentences s LEFT JOIN covered c ON s.doc_id = c.doc_id AND s.k = c.k GROUP BY s.doc_id
        )
        SELECT d.doc_id, CASE WHEN m.n_removed > 0 THEN m.text ELSE d.text END AS text, coalesce(m.n_sentences, 0) AS n_sentences, coalesce(m.n_removed, 0) AS n_removed
        FROM documents d LEFT JOIN made m USING (doc_id)
    """,
    "op8_decontamination": r"""
        WITH d AS (
            SELECT DISTINCT doc_id, text, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), b AS (
            SELECT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
        ), bs AS (
            SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
            FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(len(w), 5) AS m FROM b WHERE len(w) > 0))
        ), ds AS (
            SELECT DISTINCT doc_id, text, m, array_to_string(w[i:i + m - 1], ' ') AS s
            FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bs) WHERE len(w) >= m)
        ), n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
        SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(count(*) AS BIGINT) AS n_shared, count(*) / CAST(n AS DOUBLE) AS containment
        FROM ds JOIN bs USING (s, m) JOIN n USING (item_id)
        GROUP BY doc_id, text, item_id, n HAVING count(*) >= 0.8 * n - 1e-9
    """,
    "op9_url_rules": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), r(rule_host, rule_path, verdict) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ), hits AS (
            SELECT page_id, host, path, max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, verdict := verdict)) AS best
            FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id, host, path
        )
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN hits USING (page_id, host, path)
    """,
    "op11_hard_negatives": r"""
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3
    """,
    "op12_lexical_search": r"""
        WITH t AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), c AS (
            SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
        ), d AS (
            SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY ALL
        ), whole AS (
            SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d
        ), m AS (
            SELECT doc_id, 100 - 50 + ((50 * n * docs) // words) AS m FROM d, whole
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, whole GROUP BY term, docs
        ), i AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), s AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
            FROM i JOIN c USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 50
    """,
}
