"""DuckDB SQL for the words and n-gram sets of textkernel (texts without kana, Han or Hangul)."""

from __future__ import annotations

WORD = r"[0-9a-z_\x{AA}\x{B5}\x{BA}\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+"


def ngram_sets(n: int, source: str = "documents", key: str = "doc_id") -> str:
    """CTEs ``words``, ``grams`` (key, gram; distinct) and ``sizes`` (key, size)."""
    return f"""
    words AS (SELECT {key}, regexp_extract_all(lower(text), '{WORD}') AS w FROM (SELECT DISTINCT {key}, text FROM {source} WHERE {key} IS NOT NULL AND text IS NOT NULL)),
    grams AS (SELECT DISTINCT {key}, gram FROM (
        SELECT {key}, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS gram FROM (SELECT {key}, w, unnest(generate_series(1, greatest(1, len(w) - {n - 1}))) AS i FROM words WHERE len(w) > 0))),
    sizes AS (SELECT {key}, count(*) AS size FROM grams GROUP BY {key})"""


def jaccard_classes(n: int, threshold: float) -> str:
    """A row for each document: the smallest document that links lead to, and the number of its links."""
    return f"""
    WITH RECURSIVE {ngram_sets(n)},
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS s FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
    pairs AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE s / (p.size + q.size - s) >= {threshold}),
    links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
    reach(x, y) AS (SELECT x, x FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
    SELECT doc_id, coalesce(c, doc_id) AS class_id, coalesce(n, 0) AS links
    FROM documents LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS n FROM links GROUP BY x) USING (doc_id)
    WHERE doc_id IS NOT NULL"""
