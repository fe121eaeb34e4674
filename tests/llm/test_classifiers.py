from __future__ import annotations

import random
import zlib

import numpy as np
from prose import prose

from hornspark.llm import quality_classifier, toxicity, trees

LABELS = "doc_id long, quality int, toxic int"
INSULTS = ["brutefool", "nitwitted", "scoundrelly", "dimbulb"]


def corpus(n: int) -> tuple[list, list]:
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        toxic, bad = i % 4 == 0, i % 5 == 0
        w = prose(60 + i % 40, i).split()
        if toxic:
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(INSULTS))
        if bad:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def held_out_accuracy(scores, labels, k: int, cut: float) -> float:
    truth = {r[0]: r[k] for r in labels}
    held = [r for r in scores if r["held_out"] and r["doc_id"] in truth]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held) and all(0 <= r["score"] <= 1 for r in scores)
    return float(np.mean([(r["score"] >= cut) == bool(truth[r["doc_id"]]) for r in held]))


def test_toxicity_and_quality_on_held_out_rows(spark, docs):
    rows, labels = corpus(600)
    extra: list = [(9001, None), (9002, ""), (None, "x"), (0, "a second text of the first id"), (9003, "long " * 20_000)]
    lab = spark.createDataFrame([*labels, (9001, None, None), (None, 1, 1)], LABELS)
    scores = toxicity.scored(docs(rows + extra), lab)[0].collect()
    assert len(scores) == len(rows) + len(extra)
    assert held_out_accuracy([r for r in scores if r["doc_id"] != 0], labels, 2, 0.5) > 0.9
    by = {r["doc_id"]: r for r in scores}
    assert by[9001]["score"] == by[9002]["score"] < 0.5 and by[None]["held_out"]
    scores = quality_classifier.scored(docs(rows + extra), lab)[0].collect()
    assert len(scores) == len(rows) + len(extra)
    assert held_out_accuracy([r for r in scores if r["doc_id"] != 0], labels, 1, 0.3) > 0.97


def test_without_labels_scores_are_constant(spark, docs):
    none, one = spark.createDataFrame([], LABELS), spark.createDataFrame([(i, 1, 1) for i in range(30)], LABELS)
    few = docs([(i, prose(30, i)) for i in range(30)])
    for f, k in ((toxicity.scored, 0.5), (quality_classifier.scored, 0.5)):
        assert {round(r["score"], 6) for r in f(few, none)[0].collect()} == {k}
        scores = {r["score"] for r in f(few, one)[0].collect()}
        assert len(scores) == 1 and scores.pop() > 0.9
        assert f(docs([]), one)[0].collect() == []


def test_rules_are_sparse_and_compile_to_the_same_score(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(2)
    x = r.random((800, 4)).round(3)
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.5)).astype(float)
    model = trees.fit_rules(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97 and len(model.rules) < 60
    df = spark.createDataFrame([tuple(map(float, v)) for v in x[:100]], "a double, b double, c double, d double")
    got = [v[0] for v in df.select(model.column([F.col(c) for c in "abcd"])).collect()]
    assert np.allclose(got, model.score(x[:100]))
    grown = trees.forest(x, y, 5, 4)
    assert np.allclose([v[0] for v in df.select(trees.column(grown[0], [F.col(c) for c in "abcd"])).collect()], trees.evaluate(grown[0], x[:100]))
