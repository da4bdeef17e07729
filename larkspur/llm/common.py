"""Things the training-data operators share: tables and small SQL idioms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def bucket_of_id(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
