"""The registered queries of these operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import best_fit_packing, decontamination, language_id, ngram_jaccard, pii, quality_rules, secret_scans, sharding, text_sql, url_filters, warc_revisits
from corpusflow.llm._common import fresh_path, table
from pyspark.sql import functions as F

N_SHARDS = 16


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan of the whole corpus: the ledger is new."""
    return secret_scans.scan(table(spark, sf_dir, "documents"), ledger=fresh_path(spark, "ledger"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filters.filter_urls(table(spark, sf_dir, "pages"))
    return out.withColumn("terms", F.array_join("terms", ","))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.classes(table(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_revisits.resolve(warc_revisits.captures_of_pages(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.withColumn("headers", F.array_join(lines, "\n"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), "doc_id", sharding.equal_shards(N_SHARDS), sharding.equal_shards(N_SHARDS + 1))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_language_id, op2_quality_rules, op3_secret_scans, op4_url_filters, op5_best_fit_packing,
        op6_decontamination, op7_jaccard_join, op8_warc_revisits, op9_pii, op10_sharding,
    ]
    return {f.__name__: f for f in found}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secret_sql() -> str:
    parts = [f"SELECT doc_id, text, {_quoted(r.name)} AS rule, {r.version} AS version, unnest(regexp_extract_all(text, {_quoted(r.pattern)}, 1)) AS secret FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)" for r in secret_scans.RULES]
    return f"""
    WITH found AS ({" UNION ALL ".join(parts)})
    SELECT doc_id, sha256(text) AS blob_id, rule, CAST(version AS INTEGER) AS version, sha256(secret) AS secret_sha256, substr(secret, 1, 4) || '...' AS masked,
           CAST(count(*) AS INTEGER) AS hits, CAST(min(strpos(text, secret)) AS INTEGER) AS first_pos
    FROM found GROUP BY doc_id, text, rule, version, secret"""


def _url_sql() -> str:
    terms = [(t, True, 0.0) for t in url_filters.STRICT] + [(t, False, w) for t, w in url_filters.SOFT]
    rows = ", ".join(f"({_quoted(t)}, {s}, CAST({w} AS DOUBLE))" for t, s, w in terms)
    return f"""
    WITH terms(term, strict, weight) AS (VALUES {rows}),
    p AS (SELECT row_number() OVER () AS k, page_id, url, lower(url_decode(coalesce(url, ''))) AS u FROM pages),
    pos AS (SELECT k, u, unnest(generate_series(1, length(u))) AS i FROM p),
    hit AS (SELECT k, term, strict, weight, count(*) AS n FROM pos JOIN terms ON substr(u, i, length(term)) = term
            WHERE (i = 1 OR NOT regexp_matches(substr(u, i - 1, 1), '[a-z0-9]'))
              AND (i + length(term) > length(u) OR NOT regexp_matches(substr(u, i + length(term), 1), '[a-z0-9]'))
            GROUP BY ALL),
    s AS (SELECT k, sum(CASE WHEN strict THEN n ELSE 0 END) AS a, sum(CASE WHEN strict THEN 0 ELSE n END) AS b, count(*) FILTER (NOT strict) AS c,
                 round(sum(weight), 6) AS w, string_agg(term, ',' ORDER BY term) AS terms FROM hit GROUP BY k)
    SELECT page_id, url, CAST(coalesce(a, 0) AS INTEGER) AS strict_hits, CAST(coalesce(b, 0) AS INTEGER) AS soft_hits, CAST(coalesce(c, 0) AS INTEGER) AS soft_distinct,
           coalesce(w, 0.0) AS soft_weight, coalesce(terms, '') AS terms,
           coalesce(a, 0) > 0 OR (coalesce(c, 0) >= {url_filters.MIN_SOFT} AND coalesce(w, 0.0) >= {url_filters.MIN_WEIGHT}) AS rejected
    FROM p LEFT JOIN s USING (k)"""


_CANONICAL_SQL = r"""
    p0 AS (SELECT page_id, html, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
    p1 AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
                  regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '(\.html?|/index)$', ''), '/+$', '') AS path,
                  list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]*|ref)(=|$)'))) AS q FROM p0),
    pages1 AS (SELECT page_id, html, url, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM p1)"""


def _warc_sql() -> str:
    return f"""
    WITH {_CANONICAL_SQL},
    c AS (SELECT page_id, canonical, page_id % 3 <> 0 AS revisit, CAST(page_id // 64 AS VARCHAR) AS epoch,
                 CASE WHEN page_id % 5 <> 0 THEN 'W/"' || substr(md5(canonical || '|' || CAST(page_id // 64 AS VARCHAR)), 1, 16) || '"' END AS etag,
                 length(html) AS n FROM pages1),
    r AS (SELECT v.page_id, v.canonical, v.epoch, v.etag, f.page_id AS f_id, f.epoch AS f_epoch, f.etag AS f_etag, f.n
          FROM c v LEFT JOIN c f ON f.canonical = v.canonical AND NOT f.revisit AND f.page_id < v.page_id
          WHERE v.revisit QUALIFY row_number() OVER (PARTITION BY v.page_id ORDER BY f.page_id DESC NULLS LAST) = 1),
    w AS (SELECT *, CASE WHEN f_id IS NULL THEN 'orphan' WHEN etag IS NOT NULL AND f_etag IS NOT NULL THEN CASE WHEN etag = f_etag THEN 'resolved' ELSE 'mismatch' END
                         WHEN epoch = f_epoch THEN 'resolved' ELSE 'mismatch' END AS verdict FROM r)
    SELECT page_id AS record_id, canonical, page_id AS date, f_id AS resolved_record_id, verdict,
           CASE WHEN verdict = 'resolved' THEN
             'cache-control: max-age=' || page_id || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: minute ' || page_id ||
             CASE WHEN coalesce(etag, f_etag) IS NOT NULL THEN chr(10) || 'etag: ' || coalesce(etag, f_etag) ELSE '' END || chr(10) || 'last-modified: epoch ' || epoch END AS headers
    FROM w"""


def _shard_sql() -> str:
    def owned(n: int) -> str:
        return f"""SELECT doc_id, arg_max(name, (score, -i)) AS shard FROM (
            SELECT doc_id, 'shard-' || lpad(CAST(i AS VARCHAR), 5, '0') AS name, i,
                   -1.0 / ln((CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|shard-' || lpad(CAST(i AS VARCHAR), 5, '0')), 1, 13) AS UBIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) AS score
            FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), (SELECT unnest(generate_series(0, {n - 1})) AS i)) GROUP BY doc_id"""

    return f"""
    WITH a AS ({owned(N_SHARDS)}), b AS ({owned(N_SHARDS + 1)})
    SELECT d.doc_id, a.shard, b.shard AS shard_after, a.shard <> b.shard AS moved FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scans": _secret_sql(), "op4_url_filters": _url_sql(), "op7_jaccard_join": text_sql.jaccard_classes(ngram_jaccard.N, ngram_jaccard.THRESHOLD), "op8_warc_revisits": _warc_sql(), "op10_sharding": _shard_sql()}
