"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_fold


def training_ids(labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """(doc_id, label as 0 or 1) of at most per_class ids of each class, none of fold 0, chosen by a hash of the id.
    Rows without an id or label don't count; an id with several labels counts with the largest."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (crc_fold(F.col(id_col), folds) != 0))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit(label))
    return rows.where("label = 1").orderBy(order).limit(per_class).union(rows.where("label = 0").orderBy(order).limit(per_class))


def held_out(id_col: str = "doc_id", folds: int = 5):
    return crc_fold(F.col(id_col), folds) == 0
