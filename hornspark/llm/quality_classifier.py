"""Quality classifier (operator 7): a sparse ensemble of tree rules as one Spark column.

Statistics of all texts are computed by DataFrame functions and written once, without the texts. A bounded sample
of labelled rows goes to the driver, where boosted trees give candidate rules and a lasso logistic regression
keeps a few of them with weights. They are compiled into an expression over the statistics.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written
from .labelled import held_out, training_ids
from .quality_rules import BLOCK, STATS, with_stats
from .trees import RuleModel, fit_rules

#: Labelled rows of each class that are learned from at most.
PER_CLASS = 4000
FEATURES = ["words", "mean_word", "symbols", "dup_lines", "repeated", "upper", "runs", "variety", "line_words"]


def features(prefix: str) -> list[Column]:
    """FEATURES from the statistics after prefix; 0 where there is no word."""
    c = {s: F.col(prefix + s).cast("double") for s in STATS}
    n = F.greatest(c["n_words"], F.lit(1.0))
    return [
        c["n_words"],
        c["word_chars"] / n,
        c["n_symbols"] / n,
        c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)),
        c["n_repeat_words"] / n,
        c["n_upper"] / F.greatest(c["word_chars"], F.lit(1.0)),
        c["n_runs"] / n,
        c["n_distinct"] / F.least(n, F.lit(float(BLOCK))),
        c["n_words"] / F.greatest(c["n_lines"], F.lit(1.0)),
    ]


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> tuple[DataFrame, RuleModel]:
    """((doc_id, held_out, score) of every row of docs, the model). The model is learned from at most per_class ids
    of each label, none of them held out; of rows with one id at most two are learned from.

    * Null texts count as empty; both have statistics of 0 and the score that follows from them.
    * Null ids are held out. Repeated rows get equal scores. Without labels of both kinds the score is constant.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stats = written(with_stats(text, "text", "__hs_").drop("text"), "stats")
    chosen = training_ids(labels, label, per_class)
    sample = stats.join(F.broadcast(chosen), "doc_id").select("label", *(f.alias(n) for f, n in zip(features("__hs_"), FEATURES, strict=True)))
    rows = np.array([tuple(r) for r in sample.limit(4 * per_class).collect()], float).reshape(-1, 1 + len(FEATURES))  # at most 4 * per_class rows
    rows = rows[np.lexsort(rows.T[::-1])]
    model = fit_rules(rows[:, 1:], rows[:, 0])
    columns = [f.alias(n) for f, n in zip(features("__hs_"), FEATURES, strict=True)]
    score = model.column([F.col(n) for n in FEATURES])
    return stats.select("doc_id", *columns).select("doc_id", held_out().alias("held_out"), score.alias("score")), model
