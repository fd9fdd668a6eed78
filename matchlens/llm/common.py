"""Small helpers the text operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.session import shared_dir

# Fixed value: the bytes that part words (blank, tab, line feed, vertical tab, form feed, carriage
# return). ``bytes.split()`` parts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
# A-Z to a-z, nothing else.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def corpus(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of the documents, a null text as an empty one; nothing else of theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/{re.sub(r'\W', '-', what)}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows from Parquet written once to the shared folder.

    It cuts the lineage: later steps read files that outlive any executor, and a step that is run
    twice sees the same rows.
    """
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
