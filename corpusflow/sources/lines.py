"""Lines of text as documents, and documents as lines of text."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (in the order of the lines, if path is one file) and text.  Lines end in LF, CRLF or CR; bytes that aren't UTF-8 become U+FFFD."""
    lines = spark.read.text(path)
    return lines.select(F.monotonically_increasing_id().alias("doc_id"), F.make_valid_utf8("value").alias("text"))


def read_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The lines of files as they come into a folder: text."""
    return spark.readStream.options(**options).text(folder).select(F.make_valid_utf8("value").alias("text"))


def split_lines(data: bytes) -> list[str]:
    """What read_lines makes of bytes, for input that Spark can't read itself."""
    text = data.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")
    return text.removesuffix("\n").split("\n") if text else []


def spooled_stdin(stream=None) -> str:
    """Standard input, copied to a file of the driver's machine (for local mode)."""
    with tempfile.NamedTemporaryFile("wb", suffix=".txt", delete=False) as f:
        source = stream or sys.stdin.buffer
        while block := source.read(1 << 20):
            f.write(block)
    return f.name


def kept(df: DataFrame, everything: bool = False) -> DataFrame:
    return df if everything else df.filter(~F.col("is_rejected"))


def write_lines(df: DataFrame, path: str, everything: bool = False, delimiter: str = "\n") -> None:
    """The texts as a folder of files, written in parallel."""
    kept(df, everything).select("text").write.option("lineSep", delimiter).text(path)


def ordered_texts(df: DataFrame, everything: bool = False) -> Iterator[str]:
    """The texts in the order of doc_id, fetched partition by partition."""
    rows = kept(df, everything).select("doc_id", "text").orderBy("doc_id").select("text")
    return (r["text"] for r in rows.toLocalIterator(prefetchPartitions=True))


def write_ordered(texts: Iterator[str], out: TextIO | None = None, delimiter: str = "\n") -> bool:
    """Texts to one file or standard output; False if the reader has gone."""
    to = out or sys.stdout
    try:
        for t in texts:
            to.write(t + delimiter)
        to.flush()
    except BrokenPipeError:
        return False
    return True
