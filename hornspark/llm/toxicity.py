"""Toxicity (operator 4): windows are compressed with a dictionary of toxic and one of ordinary text.

A bounded sample of labelled documents trains both zstandard dictionaries. The ordinary one is trained on windows of
ordinary text. The toxic one is trained on single words of toxic text, those that toxic documents hold in many
contexts and ordinary ones hardly at all, and contains the ordinary dictionary, so that what differs between the
two lengths of a window is toxic words alone. Trained on whole windows of toxic documents, which are ordinary text
for the most part, the dictionaries differ by chance more than by toxicity (README has figures).
A window's gain is the bytes the toxic dictionary saves; a document's gains are calibrated on another part of the
sample by a logistic regression. Scoring reads each text once, whole, and shuffles nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_ids
from .trees import lasso_logistic, sigmoid

#: Labelled documents of each class that are learned from at most, and the characters of each.
PER_CLASS = 3000
MOST_CHARS = 20_000
WINDOW, STEP = 8, 4
TOXIC_BYTES, ORDINARY_BYTES = 8_192, 32_768
LEVEL = 9
EDGE = ".,!?;:\"'()"


def windows(text: str | None) -> list[bytes]:
    """Overlapping windows of WINDOW words, lower-cased; the last may be shorter."""
    w = (text or "").lower().split()
    return [(" " + " ".join(w[i : i + WINDOW]) + " ").encode() for i in range(0, max(1, len(w) - WINDOW + STEP), STEP)] if w else []


def marked(toxic: list[str], ordinary: list[str], ratio: float = 15.0) -> set[str]:
    """Words after several different words in toxic texts (5 to 8, a hundredth of the texts), and ratio times as often a character as in
    ordinary texts. Counting contexts, not places, keeps out the words of texts that were copied."""
    contexts = min(8, max(5, len(toxic) // 100))
    seen: list[dict[str, set[str]]] = [defaultdict(set), defaultdict(set)]
    for side, texts in zip(seen, (toxic, ordinary), strict=True):
        for t in texts:
            w = [x.strip(EDGE) for x in t.lower().split()]
            for a, b in zip(["", *w], w, strict=False):
                side[b].add(a)
    much, little = sum(map(len, toxic)) + 1, sum(map(len, ordinary)) + 1
    return {w for w, c in seen[0].items() if w and len(c) >= contexts and len(seen[1].get(w, ())) / little <= len(c) / much / ratio}


def _train(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    words = marked(toxic, ordinary)
    hits = [(" " + w + " ").encode() for t in toxic for w in t.lower().split() if w.strip(EDGE) in words]
    plain = [x for t in ordinary for x in windows(t)[::2]]
    rng = np.random.default_rng(5)
    pick = lambda rows: [rows[i] for i in sorted(rng.choice(len(rows), min(len(rows), 60_000), replace=False))]
    base = _train(ORDINARY_BYTES, pick(plain)) if plain else b""
    return (_train(TOXIC_BYTES, pick(hits)) if hits else b"") + base, base


class Gains:
    """Bytes that the toxic dictionary saves, by window."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        use = lambda raw: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.toxic, self.ordinary = use(toxic).compress, use(ordinary).compress

    def features(self, text: str | None) -> list[float]:
        """How many windows gain 2 and 4 bytes, as logarithms and shares, and the largest gain."""
        toxic, ordinary = self.toxic, self.ordinary
        gain = np.fromiter((len(ordinary(x)) - len(toxic(x)) for x in windows(text)), np.int64)
        if not len(gain):
            return [0.0] * 5
        some, much = float((gain >= 2).sum()), float((gain >= 4).sum())
        return [np.log1p(some), np.log1p(much), min(1.0, 10 * some / len(gain)), min(1.0, 10 * much / len(gain)), min(10.0, max(0.0, float(gain.max()))) / 10]


class Model:
    """Two dictionaries and the calibration of their gains."""

    def __init__(self, toxic: bytes, ordinary: bytes, bias: float, weights: list[float]) -> None:
        self.toxic, self.ordinary, self.bias, self.weights = toxic, ordinary, bias, weights

    def scorer(self):
        gains, weights = Gains(self.toxic, self.ordinary), np.array(self.weights)
        return lambda text: float(sigmoid(np.array(self.bias + weights @ np.array(gains.features(text)))))


def fit(rows: list[tuple[int, str, int]]) -> Model:
    """rows: (id, text, label). Two thirds train the dictionaries, the rest calibrates. With one class only the
    score is constant, the smoothed share of label 1."""
    rows = sorted(rows)
    learn, check = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    toxic, ordinary = dictionaries([t for _, t, y in learn if y], [t for _, t, y in learn if not y])
    y = np.array([r[2] for r in check], float)
    if not len(y) or y.min() == y.max():
        return Model(b"", b"", float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), [0.0] * 5)
    gains = Gains(toxic, ordinary)
    bias, w = lasso_logistic(np.array([gains.features(t) for _, t, _ in check]), y, 0.0005, 2000)
    return Model(toxic, ordinary, float(bias), [float(v) for v in w])


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int = MOST_CHARS) -> list[tuple[int, str, int]]:
    """At most 4 * per_class labelled rows of docs (doc_id, text), none of them held out; of a longer text
    most_chars characters from a place that its id chooses."""
    chosen = F.broadcast(training_ids(labels, label, per_class))
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - most_chars, F.lit(0)) + 1).cast("int")
    rows = docs.where(F.col("text").isNotNull()).join(chosen, "doc_id").select("doc_id", F.substring("text", start + 1, F.lit(most_chars)).alias("text"), "label")
    return [tuple(r) for r in rows.limit(4 * per_class).collect()]


_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> tuple[DataFrame, Model]:
    """((doc_id, held_out, score) of every row of docs, the model). Learned from at most per_class labelled ids of
    each class, none of them held out, and at most most_chars characters of each; whole texts are scored.

    * Null and empty texts have no window and get the score of a text without any gain. Time grows with a text's
      length; a very long text is scored by shares and logarithms of counts, as any other.
    * Null ids are held out. Repeated rows get equal scores. Without labels of both kinds the score is constant.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(sample(rows, labels, label, per_class, most_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], schema=_SCORE)

    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score"), model
