"""The stages one after another on a small corpus with planted cases, and the queries against their SQL."""

from __future__ import annotations

import os

import brute
import pytest
from prose import edited, natural, prose
from test_lines_and_rules import deduplicated

import corpus_pipeline
from hornspark.llm import queries

SF = "/root/testdata/sf0.001"
ITEM = "Train A leaves the old station with 120 passengers at 9 hours and Peter counts 35 seats in every coach before the bridge opens."


def test_each_stage_takes_effect(spark, docs, tmp_path):
    line = "This very line stands in several documents of the corpus."
    clean = [(i, natural(90, i)) for i in range(40)]
    rows = [*clean, (100, " ".join(w + "%%%" for w in natural(90, 100).split())), (101, edited(natural(90, 3), 1, 7)), (102, edited(natural(90, 4), 1, 1)), (110, natural(90, 5)), (103, f"{prose(60, 200)} {ITEM} {prose(60, 201)}"), (104, f"{natural(90, 202)}\n{line}"), (105, f"{line}\n{natural(90, 203)}"), (106, None)]
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step, kept = docs(rows), []
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        kept.append({r["doc_id"]: r.asDict().get("text") for r in step.collect()})
        if name != "packing":
            assert step.columns == docs([]).columns
    ids = [set(k) for k in kept]
    assert ids[0] == {i for i, _ in rows} - {100, 106}
    assert kept[1] == {i: t for i, _, _, t in deduplicated([(i, t) for i, t in rows if i in ids[0]]) if t.strip()} and line not in kept[1][105]
    groups = {i: c for i, _, c, _ in brute.similarity_groups(sorted(kept[1].items()), 5, 80, 100)}
    assert ids[2] == {i for i, c in groups.items() if i == c} and not ids[2] & {101, 102}
    assert 110 in ids[0] - ids[1]  # an exact copy has lost all its lines
    assert ids[3] == ids[2] - {103}
    assert ids[4] == ids[3] and {i for i, _ in clean} <= ids[4]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for x in os.listdir(SF):
        con.sql(f"create view {x.removesuffix('.parquet')} as select * from '{SF}/{x}'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_each_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
