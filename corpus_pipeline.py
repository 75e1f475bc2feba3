"""The corpus pipeline: STAGES over documents, each stage's result stored as Parquet and read again as the next one's documents.

1. quality_rules: documents that the isolation forest rejects go
2. near_duplicates: of each group of similar documents the one with the smallest doc_id stays
3. decontamination: documents in which a benchmark item is found go
4. secret_scans: secrets are replaced in the texts of the documents that have findings
5. best_fit_packing: the documents left, as pieces in training sequences

Nulls: a document with a null or empty text, or without words, is rejected by the
first stage.  One with a null doc_id can't be named in a decision of stages 2 to 4:
it stays as it is in 2 and 3, and in 4 its text is searched directly.  Repeated rows of
one document become one in stage 2.  Extra columns go in the first stage.  Very long
texts are processed whole; of documents that tie in stage 2 the smallest doc_id stays;
empty tables give an empty result.

Texts move between tasks only in the scans that need it: where the ids that a stage
decides on are few (counted first, at most SENT_IDS), they are sent to the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import best_fit_packing, decontamination, ngram_jaccard, quality_rules, secret_scans
from corpusflow.llm._common import SENT_IDS, by_ids, document_columns, fresh_path, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the forest keeps, decided row by row in one pass."""
    return quality_rules.kept(document_columns(docs), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = document_columns(docs)
    gone = ngram_jaccard.duplicates(docs).select("doc_id")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = stored(repeated, "repeated")
    left = by_ids(docs, gone, "left_anti")
    if repeated.isEmpty():
        return left.select(docs.columns)
    one = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d")).select("doc_id", "d.*")
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).union(one.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = document_columns(docs)
    return by_ids(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; in those with findings each secret is replaced, and n_chars counts the new text."""
    docs = document_columns(docs)
    found = stored(secret_scans.scan(docs, ledger=fresh_path(spark, "ledger")).select("doc_id").distinct().withColumn("_found", F.lit(True)), "found")
    few = found.limit(SENT_IDS + 1).count() <= SENT_IDS
    marked = docs.join(F.broadcast(found) if few else found.hint("shuffle_hash"), "doc_id", "left")
    hit = F.col("_found") | (F.col("doc_id").isNull() & F.col("text").isNotNull())
    text = F.when(hit, secret_scans.redacted(F.col("text"))).otherwise(F.col("text"))
    out = marked.select("doc_id", text.alias("text"), "lang", "source", "n_chars", hit.alias("_hit"))
    return out.withColumn("n_chars", F.when(F.col("_hit"), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]

#: SQL can't express the isolation forest of the first stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, the result of each but the last stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
