"""The row that pipelines work on, and how any DataFrame with a text column becomes one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTRAS = "map<string,string>"
TOKENS = "array<struct<text:string,original:string,is_rejected:boolean>>"
#: columns that a pipeline reads and writes; others pass through untouched
STATE = ("text", "original", "is_rejected", "reject_reason", "extras", "tokens")


def empty_map() -> Column:
    return F.create_map().cast(EXTRAS)


def as_documents(df: DataFrame, text: str = "text", id_col: str | None = None, tokens: bool = False) -> DataFrame:
    """df with the state columns added where they are missing.

    id_col names a stable, unique and ordered key; it becomes ``doc_id`` and gives the
    order in which first occurrences are found.  Without one, and without a doc_id, a
    sampling or deduplicating pipeline raises an error.
    Extras are a map from names to JSON text.
    """
    if text != "text":
        df = df.withColumn("text", F.col(text))
    have = set(df.columns)
    new = {}
    if id_col and id_col != "doc_id":
        new["doc_id"] = F.col(id_col)
    if "original" not in have:
        new["original"] = F.col("text")
    if "is_rejected" not in have:
        new["is_rejected"] = F.lit(False)
    for name in ("reject_reason", "extras"):
        if name not in have:
            new[name] = empty_map()
    if tokens and "tokens" not in have:
        new["tokens"] = F.array().cast(TOKENS)
    return df.withColumns(new)
