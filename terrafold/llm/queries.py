"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import audit, bpe, decontaminate, lexical, lm, neighbours, pieces, pii, repeats, secrets, simhash, toxicity, urlfilter
from terrafold.llm.common import table

#: The rules of the URL query.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "verdict string, host string, path string"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii_digests(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats_digests(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2, vocabulary())


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_number")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_toxicity, op3_pii, op4_suffix_array_dedup, op5_byte_bpe, op6_nearest_neighbours, op7_decontamination, op8_simhash, op9_lm_scoring, op10_secret_scans, op11_sentencepiece, op12_filter_audit, op13_ranked_search)}


_UPPER, _LOWER = urlfilter.UPPER, urlfilter.LOWER


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return {
        "op1_url_filters": f"""
            WITH rules(verdict, host, path) AS (VALUES {rules}),
            rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
            parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
                coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM rest),
            fits AS (SELECT n, max({{'length': length(r.host || r.path), 'rule': r.host || r.path, 'verdict': r.verdict}}) AS best FROM parts p JOIN rules r
                ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
            SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)""",
        # Failures are listed as letters, and each order's steps are judged on them.
        "op12_filter_audit": r"""
            WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
            words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
            told AS (SELECT doc_id, part, (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
                || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
                || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM words),
            marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
            kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM told LEFT JOIN marks USING (doc_id) GROUP BY ALL),
            letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
            orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
            steps AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS earlier FROM orders, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step)),
            judged AS (SELECT *, contains(fails, x) AS failing, earlier <> '' AND translate(fails, earlier, '') <> fails AS gone FROM steps, kinds),
            sums AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0) AS removed,
                coalesce(sum(n) FILTER (WHERE gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = x), 0) AS unique_fails,
                coalesce(sum(good) FILTER (WHERE NOT gone AND failing), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND failing), 0) AS toxic_lost FROM judged GROUP BY ALL)
            SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
                CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM sums""",
        "op13_ranked_search": r"""
            WITH terms AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, '""" + f"{_UPPER}', '{_LOWER}" + r"""'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
            sizes AS (SELECT d, doc_id, CAST(len(w) AS BIGINT) AS n FROM terms WHERE len(w) > 0),
            whole AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM sizes),
            asked AS (SELECT item_id, x, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '""" + f"{_UPPER}', '{_LOWER}" + r"""'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM benchmark) GROUP BY ALL),
            found AS (SELECT d, x, count(*) AS tf FROM (SELECT d, unnest(w) AS x FROM terms) WHERE x IN (SELECT x FROM asked) GROUP BY ALL),
            weights AS (SELECT x, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM found, whole GROUP BY x),
            scores AS (SELECT item_id, d, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l)))) AS BIGINT) AS score
                FROM found JOIN sizes USING (d) JOIN weights USING (x) JOIN asked USING (x), whole GROUP BY item_id, d)
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores JOIN sizes USING (d) WHERE score > 0
            QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
    }
