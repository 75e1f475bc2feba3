"""Incremental blob ledger for secret scanning.

Every historical version of every path is content-addressed (SHA-256 of its
text).  A ledger remembers which (blob, rule, rule version) triples were scanned;
only unseen ones are scanned, once for each distinct blob however many paths and
versions hold it, and findings are joined back to all paths.  Raising a rule's
version scans the known blobs again with that rule alone.

Plan: path and digest are one narrow table; one holder of each unseen blob is
chosen by an aggregation of digests.  If these are few (an increment), they are sent
to the texts, which stay where they are and of which only the unseen are looked at;
else (a first scan) the text reaches the scan by one hash join with the holders
(the small side is built, the text is streamed, not sorted).
Rules run as JVM regular expressions, each behind a literal test.

* null text: no blob, no findings; empty text: a blob without findings
* null path: its findings are joined to path null like any other
* repeated (path, text) rows: reported once
* very long text: scanned whole; ties: of the paths of a blob the smallest is scanned, all are reported
* extra columns: not in the result; empty table: empty result
* a missing ledger is an empty one; findings are stored before the scanned
  triples, so after a failure in between a rescan adds repeats, dropped on reading
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm._common import SENT_IDS, picked, stored

_EDGE = "(?:^|[^0-9A-Za-z_])"
#: the end of an assigned name; any prefix may stand before it
_NAME = "(?i:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|token|passwd|password)"
#: what ends an assigned value (in a class): quotes, controls and white space
_STOP = "\\x00-\\x20\"'\\x{A0}\\x{2000}-\\x{200A}\\x{3000}"
#: from BEGIN to END with no other five dashes between (so not into the next key); where END is missing, the lines of key characters and what else is on the line after them
_PRIVATE_KEY = (
    "-----BEGIN [0-9A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    "(?:[^-]*(?:-{1,4}[^-]+){0,200}-----END [0-9A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    "|(?:(?:[ \\t\\r\\n]|\\\\[nr])*(?:Proc-Type|DEK-Info):[0-9A-Za-z, :-]*)*"
    "(?:(?:(?:[ \\t\\r\\n\"'+,]|\\\\[nr])*[0-9A-Za-z+/=_-]{16,})+(?:(?:[\\r\\n]|\\\\[nr])+[0-9A-Za-z+/=_]{1,15})?)?)"
)


@dataclass(frozen=True)
class Rule:
    """head, secret, tail: syntax of both Java and RE2, without groups that capture.  hints: lower-case literals of which any match contains one, in any case."""

    name: str
    head: str
    secret: str
    tail: str
    hints: tuple[str, ...]
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    @property
    def pattern(self) -> str:
        """Group 1 is the secret."""
        return f"{self.head}({self.secret}){self.tail}"


RULES = (
    Rule("aws_access_key", _EDGE, "(?:AKIA|ASIA)[0-9A-Z]{16}", "", ("akia", "asia")),
    Rule("github_token", _EDGE, "gh[opsur]_[0-9A-Za-z]{36,}", "", ("gho_", "ghp_", "ghs_", "ghu_", "ghr_"), version=2),
    Rule("slack_token", _EDGE, "xox[abprs]-[0-9A-Za-z-]{10,}", "", ("xox",), version=2),
    Rule("google_api_key", _EDGE, "AIza[0-9A-Za-z_-]{35}", "", ("aiza",)),
    Rule("payment_key", _EDGE, "[rs]k_live_[0-9A-Za-z]{24,}", "", ("k_live_",), version=2),
    Rule("json_web_token", _EDGE, "eyJ[0-9A-Za-z_-]{10,}[.][0-9A-Za-z_-]{10,}[.][0-9A-Za-z_-]{10,}", "", ("eyj",), version=2),
    Rule("private_key", "", _PRIVATE_KEY, "", ("-----begin",), version=2),
    Rule("assigned_secret", _NAME + "\\\\*[\"']?[ \\t]*(?::=|==|=>|[:=])[ \\t]*\\\\*[\"']?", f"[^{_STOP}]{{15,}}[^{_STOP},;)\\]}}>\\\\]", "", ("key", "secret", "token", "passw"), version=2),
)


#: so many unseen blobs (some 400 bytes each as a hash table) are sent to the texts; beyond, texts and blobs meet in a shuffle
SENT_HOLDERS = SENT_IDS // 100


def _hinted(lowered: Column, rule: Rule) -> Column:
    out = F.lit(False)
    for hint in rule.hints:
        out = out | lowered.contains(hint)
    return out


def find(text: Column, rules: Sequence[Rule], wanted: Column | None = None) -> Column:
    """array<struct<rule, version, secret, hits, first_pos>>: the distinct secrets that the rules (those whose key is in wanted) find in the text."""
    lowered = F.lower(text)
    parts = []
    for r in rules:
        go = _hinted(lowered, r)
        if wanted is not None:
            go = F.array_contains(wanted, r.key) & go
        all_hits = F.when(go, F.regexp_extract_all(text, F.lit(r.pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
        parts.append(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), all_hits.alias("secrets")))
    hit = F.filter(F.array(*parts), lambda x: F.size(x["secrets"]) > 0)

    def distinct(x: Column) -> Column:
        def row(s: Column) -> Column:
            return F.struct(x["rule"].alias("rule"), x["version"].alias("version"), s.alias("secret"), F.size(F.filter(x["secrets"], lambda o: o == s)).alias("hits"), F.instr(text, s).alias("first_pos"))

        return F.transform(F.array_distinct(x["secrets"]), row)

    return F.flatten(F.transform(hit, distinct))


def masked(secret: Column) -> Column:
    return F.concat(F.substring(secret, 1, 4), F.lit("..."))


def redacted(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """text with each secret replaced by ``<SECRET>``; what surrounds it stays.  A fold, so that the text is one expression however many rules there are."""
    patterns = F.array(*[F.lit(f"({r.head})(?:{r.secret})({r.tail})") for r in rules])
    return F.aggregate(patterns, text, lambda t, p: F.regexp_replace(t, p, F.lit("$1<SECRET>$2")))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path)


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, ledger: str | None = None) -> DataFrame:
    """Findings of all paths: path, blob_id, rule, version, secret_sha256, masked, hits, first_pos (1-based, in code points).

    ledger: a folder in shared storage that is read, and to which this run's findings
    and scanned triples are added; None scans every distinct blob and keeps nothing.
    """
    spark = versions.sparkSession
    if len({r.key for r in rules}) < len(rules):
        raise ValueError("rule names and versions must be distinct")
    source = picked(versions, path, text).select(F.col(f"`{path}`").alias("_path"), F.col(f"`{text}`").alias("_text")).filter(F.col("_text").isNotNull())
    blob = F.unhex(F.sha2("_text", 256))
    held = stored(source.select("_path", blob.alias("_blob")).distinct(), "blobs")
    keys = F.array(*[F.lit(r.key) for r in rules]) if rules else F.array().cast("array<string>")
    holders = held.groupBy("_blob").agg(F.min("_path").alias("_path"))
    known = _read(spark, f"{ledger}/scanned") if ledger else None
    if known is None:
        holders = holders.withColumn("_wanted", keys)
    else:
        seen = known.groupBy(F.col("blob").alias("_blob")).agg(F.flatten(F.collect_set("rules")).alias("_seen"))
        holders = holders.join(seen, "_blob", "left").withColumn("_wanted", F.array_except(keys, F.coalesce("_seen", F.array().cast("array<string>")))).drop("_seen")
    holders = holders.filter(F.size("_wanted") > 0)
    holders = stored(holders, "holders")
    few = holders.limit(SENT_HOLDERS + 1).count() <= SENT_HOLDERS
    rows = source.withColumn("_blob", blob)
    joined = rows.alias("r").join((F.broadcast(holders) if few else holders.hint("shuffle_hash")).alias("h"), (F.col("r._blob") == F.col("h._blob")) & F.col("r._path").eqNullSafe(F.col("h._path")))
    found = joined.select(F.col("h._blob").alias("blob"), F.explode(find(F.col("_text"), rules, F.col("_wanted"))).alias("f"))
    found = found.select("blob", "f.rule", "f.version", F.sha2("f.secret", 256).alias("secret_sha256"), masked(F.col("f.secret")).alias("masked"), "f.hits", "f.first_pos")
    found = found.dropDuplicates(["blob", "rule", "version", "secret_sha256"])  # a holder may occur in several equal rows
    if ledger:
        found = stored(found, "findings")
        found.write.mode("append").parquet(f"{ledger}/findings")
        holders.select(F.col("_blob").alias("blob"), F.col("_wanted").alias("rules")).write.mode("append").parquet(f"{ledger}/scanned")
        wanted = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int") if rules else None
        found = spark.read.parquet(f"{ledger}/findings").dropDuplicates(["blob", "rule", "version", "secret_sha256"])
        if wanted is not None:
            found = found.join(F.broadcast(wanted), ["rule", "version"], "left_semi")  # as many rows as rules
    out = held.join(found, held["_blob"] == found["blob"])
    return out.select(F.col("_path").alias(path), F.lower(F.hex("_blob")).alias("blob_id"), "rule", "version", "secret_sha256", "masked", "hits", "first_pos")
