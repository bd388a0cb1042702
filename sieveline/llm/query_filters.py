"""Queries of operators that look at one text or URL at a time against small fixed sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontaminate, license_templates, secret_ledger, url_rules
from sieveline.llm.registry import query, table


@query(r"""
WITH w AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
items AS (SELECT item_id, words, least(10, len(words)) AS n FROM b WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS gram
            FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM items)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT id, s, n, array_to_string(words[s:s + n - 1], ' ') AS gram
          FROM (SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM w, sizes WHERE len(words) >= n)),
hits AS (SELECT g.id, g.s, g.n, v.item_id FROM grams g JOIN windows v ON g.gram = v.gram AND g.n = v.n),
words_hit AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY id),
found AS (SELECT id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY id)
SELECT w.id AS doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words_hit h ON w.id = h.id LEFT JOIN found f ON w.id = f.id
""")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(hits)


@query()
def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_ledger.scan_versions(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    count = lambda kind: F.size(secret_ledger.of_kinds(spans, (kind,))).cast("long").alias(f"n_{kind}")
    base = secret_ledger.of_kinds(spans, [r.kind for r in secret_ledger.BASE])
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_ledger.listed(base), 256).alias("base_sha256"),
                        secret_ledger.listed(spans).alias("spans"))


@query()
def op6_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_templates.scan_licenses(table(spark, sf_dir, "documents"))
    own = F.transform("matches", lambda m: m["label"])
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", own)))
    score = F.when(F.size("matches") > 0, 1.0).when(F.col("n_base") > 0, 0.5).otherwise(0.0)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join(labels, ",").alias("labels"), score.alias("score"))


@query(r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
         FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT hp.page_id, host, path, rule,
       CASE WHEN best.verdict IS NOT NULL THEN best.verdict
            WHEN host GLOB '*spam-*' OR host GLOB '*cheap-pills*' OR host GLOB '*casino*' OR host GLOB '*free-*download*'
              OR path GLOB '*/wp-login.*' OR path GLOB '*.exe' OR path GLOB '*.zip' THEN 'block' ELSE 'allow' END AS verdict
FROM hp LEFT JOIN best ON hp.page_id = best.page_id
""")
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
