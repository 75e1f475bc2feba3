"""Helpers shared by the operators: shared storage and reading tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where it is unset, one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corpusflow-shared-")
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusflow/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of DataFrames that are no longer referenced: it does so when the driver collects garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: so many ids (16 bytes each as a hash table) at most are sent to all tasks
SENT_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined with a table of doc_ids (``left_semi`` or ``left_anti``): no text moves where the ids, counted first, are few; else a hash join on doc_id."""
    ids = stored(ids.select("doc_id").distinct(), "ids")
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", how).select(docs.columns)


def picked(df: DataFrame, *names: str) -> DataFrame:
    """The columns of these names only, whatever other columns there are; one that differs in case only is another column."""
    have = df.columns
    if len({c.lower() for c in have}) < len(have):
        taken: set[str] = set()
        new = []
        for k, c in enumerate(have):
            new.append(c if c in names and c not in taken else f"extra {k}")
            taken.add(c)
        df = df.toDF(*new)
    return df.select(*[F.col(f"`{c}`").alias(c) for c in names])


def document_columns(docs: DataFrame) -> DataFrame:
    """Exactly the columns of documents; extra ones go."""
    return picked(docs, *DOCUMENT_COLUMNS)
