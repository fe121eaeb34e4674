"""What the operators of this subpackage share: the shared folder, written tables, text expressions, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import own_dir

#: The white space of the contracts, ``[\x20\x09-\x0D]``, as characters and as a Java pattern.
WS = " \t\n\x0b\x0c\r"
WS_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes in an Arrow batch that a written step sends to Python: rows of texts differ in size by many thousand times.
BATCH = "2m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def byte_batches(spark: SparkSession) -> Iterator[None]:
    """What is planned within sends Python batches of BATCH at most, or of one row."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, BATCH)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage is cut, and a lost executor costs only a re-read.
    ``plans.storage.clear`` deletes all of them."""
    path = fresh_path(df.sparkSession, name)
    with byte_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null and for texts without a word."""
    bare = F.btrim(text, F.lit(WS))
    return F.when(text.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, WS_RUN))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are. ``lower`` does that many times faster where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod folds; null ids are in fold 0 (held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0).cast("long"))
