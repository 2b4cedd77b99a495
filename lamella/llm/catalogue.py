"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import bpe, exact_dedup, license_scan, line_dedup, lm_scoring, mixing, near_dedup, neighbours, quality, warc
from lamella.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.perplexities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.deduplicate(docs, report=True)
    return kept.select("doc_id", "n_lines", "n_equal", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80).drop("text_key", "component_key")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality": op2_quality,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe": op5_bpe,
    "op6_near_dedup": op6_near_dedup,
    "op7_neighbours": op7_neighbours,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
}

#: Lower-cases A-Z alone, as the operators do.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op4_line_dedup": """
        WITH keyed AS (SELECT doc_id, text, coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS key FROM documents),
        split_up AS (SELECT DISTINCT doc_id, key, string_split(text, chr(10)) AS parts FROM keyed),
        pieces AS (SELECT doc_id, key, unnest(parts) AS raw, unnest(range(len(parts))) AS num FROM split_up),
        numbered AS (
            SELECT *, row(doc_id IS NOT NULL, coalesce(doc_id, 0), key, num) AS pos,
                   translate(trim(raw, ' ' || chr(9) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM pieces),
        firsts AS (SELECT t, min(pos) AS pos FROM numbered WHERE length(t) >= 1 GROUP BY t),
        sized AS (SELECT t, pos, unnest([length(t), length(t) - 1]) AS n FROM firsts WHERE length(t) >= 10),
        halves AS (SELECT t, pos, unnest(['p' || left(t, n // 2), 's' || right(t, n - n // 2)]) AS h FROM sized),
        close AS (
            SELECT DISTINCT x.t FROM halves AS x JOIN halves AS y USING (h)
            WHERE y.pos < x.pos AND abs(length(x.t) - length(y.t)) <= 1 AND levenshtein(x.t, y.t) <= 1),
        judged AS (
            SELECT doc_id, key, num, raw, coalesce(numbered.pos <> firsts.pos, false) AS again,
                   coalesce(numbered.pos = firsts.pos, false) AND close.t IS NOT NULL AS almost
            FROM numbered LEFT JOIN firsts ON numbered.t = firsts.t LEFT JOIN close ON close.t = firsts.t),
        found AS (
            SELECT doc_id, key, count(num) AS n_lines, count(*) FILTER (WHERE again) AS n_equal, count(*) FILTER (WHERE almost) AS n_near,
                   string_agg(raw, chr(10) ORDER BY num) FILTER (WHERE NOT again AND NOT almost) AS kept
            FROM judged GROUP BY doc_id, key)
        SELECT keyed.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_equal, 0) AS n_equal, coalesce(n_near, 0) AS n_near, sha256(coalesce(kept, '')) AS text_sha256
        FROM keyed LEFT JOIN found ON keyed.doc_id IS NOT DISTINCT FROM found.doc_id AND keyed.key = found.key""",
    "op6_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
            FROM w),
        n AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id),
        links AS (
            SELECT p.doc_id AS a, q.doc_id AS b
            FROM s AS p JOIN s AS q USING (s) JOIN n AS x ON x.doc_id = p.doc_id JOIN n AS y ON y.doc_id = q.doc_id
            WHERE p.doc_id <> q.doc_id
            GROUP BY p.doc_id, q.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        reach AS (
            SELECT doc_id, doc_id AS root FROM documents
            UNION SELECT b, root FROM reach JOIN links ON a = reach.doc_id)
        SELECT doc_id, n AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
        FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n""",
    "op8_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {LOWER} AS t FROM documents)
        WINDOW g AS (PARTITION BY t)""",
    "op9_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, text, '')) AS key,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents),
        sources AS (
            SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * s AS cap
            FROM (SELECT source, sum(size)::BIGINT AS s FROM docs GROUP BY source)),
        levels AS (
            SELECT *, (sum(s) OVER () - coalesce(sum(cap) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS level
            FROM sources
            WINDOW r AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        goals AS (SELECT source, s AS source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
        queue AS (
            SELECT doc_id, source, key, size, source_size, target,
                   row_number() OVER q AS place, (sum(size) OVER q)::BIGINT AS through
            FROM docs JOIN goals USING (source)
            WINDOW q AS (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        slots AS (
            SELECT source, place, size, sum(size) OVER (
                ORDER BY (turn * source_size + through)::DOUBLE / target, source, key, place, turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
            FROM (SELECT *, unnest(range(ceil(target / source_size)::BIGINT)) AS turn FROM queue WHERE size > 0))
        SELECT doc_id, size, source_size, target,
               size * coalesce((SELECT count(*) FROM slots WHERE slots.source = queue.source AND slots.place = queue.place
                                AND used <= (SELECT sum(size) FROM docs)), 0)::BIGINT AS taken
        FROM queue""",
    "op10_warc": """
        SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
               CASE WHEN again > 1 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again > 1 THEN first END AS refers_to
        FROM (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first,
                     CASE WHEN strlen(h) >= 100 THEN row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) ELSE 1 END AS again
              FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))""",
}
