"""The registered queries of this package: each applies one operator, with production settings, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm import collocations, decontaminate, langid, negatives, packing, quality, shards, simhash, spotsigs, substrings, toxicity, urlfilter, warc
from siteledger.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules(spark, URL_RULES), default="allow")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"), by=substrings.BOTH)


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.encode_and_read(table(spark, sf_dir, "documents"), end_id=0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label, scale=256, every=100, positives=5, negatives=10, low=30, high=90)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, subsumed=50, first=2000)


def op13_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edits(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_url_filter": op2_url_filter,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_lines": op5_lines,
    "op6_token_shards": op6_token_shards,
    "op7_quality": op7_quality,
    "op8_pack": op8_pack,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_spotsigs": op13_spotsigs,
}

ORACLES: dict[str, str] = {
    "op12_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
        w AS (SELECT lang, unnest(words) AS a, unnest(list_concat(words[2:], [NULL])) AS b, unnest(list_concat(words[3:], [NULL, NULL])[1:len(words)]) AS c FROM p WHERE len(words) > 0),
        f1 AS (SELECT lang, a, count(*) AS f FROM w GROUP BY ALL),
        f2 AS (SELECT lang, a, b, count(*) AS f FROM w WHERE b IS NOT NULL GROUP BY ALL),
        f3 AS (SELECT lang, a, b, c, count(*) AS f FROM w WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY ALL),
        s AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY ALL),
        two AS (
            SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, x.f AS l, y.f AS r
            FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b LEFT JOIN s ON s.lang = f2.lang AND s.a = f2.a AND s.b = f2.b
            WHERE f2.f >= 10 AND NOT coalesce(100 * s.f >= 50 * f2.f, false)),
        three AS (
            SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c AS phrase, f3.f AS a, h.f AS h, t.f AS t, p.f AS p, e.f AS e
            FROM f3 JOIN f1 h ON h.lang = f3.lang AND h.a = f3.a JOIN f2 t ON t.lang = f3.lang AND t.a = f3.b AND t.b = f3.c
            JOIN f2 p ON p.lang = f3.lang AND p.a = f3.a AND p.b = f3.b JOIN f1 e ON e.lang = f3.lang AND e.a = f3.c),
        cuts AS (
            SELECT lang, phrase, a, 1 AS k, l, r FROM two
            UNION ALL SELECT lang, phrase, a, 1, h, t FROM three
            UNION ALL SELECT lang, phrase, a, 2, p, e FROM three),
        scored AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
        least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least_cut)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score
            FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
            FROM p JOIN s USING (anchor_id)
            WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, payload_bytes, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY ALL HAVING count(*) > 1)
        SELECT page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes = f.payload_bytes""",
    "op2_url_filter": r"""
        WITH parsed AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        best AS (
            SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
            FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY host, path)
        SELECT page_id, p.host, p.path, rule, coalesce(rule_verdict, 'allow') AS verdict
        FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path""",
}
