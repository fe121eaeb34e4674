from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from prose import edited, prose

from hornspark.llm import ngram_join as g
from hornspark.llm.hashing import shingle_sets


def odd_rows() -> list[tuple[int | None, str | None]]:
    base = prose(60, 1)
    rows: list[tuple[int | None, str | None]] = [(10, base), (3, base.upper()), (7, edited(base, 1, 2)), (8, edited(base, 4, 3)), (9, edited(edited(base, 1, 2), 1, 4))]
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, "one"), (24, "ONE "), (25, "one two"), (26, "one two three")]
    rows += [(None, base), (10, base), (10, "another text with the same id altogether"), (30, "é" + base), (31, "x" * 5000 + " y z"), (32, " ".join(["la"] * 3000))]
    return rows


def near_group(n: int) -> list[tuple[int, str]]:
    r, base = random.Random(5), prose(120, 9)
    return [(100 + i, edited(base, r.choice([0, 1, 1, 2, 3, 4]), 50 + i)) for i in range(n)]


@pytest.mark.parametrize(("k", "num", "short", "run"), [(3, 90, 24, 8192), (5, 80, 24, 8192), (3, 90, 2, 16), (2, 60, 1, 8)])
def test_equals_brute_force(docs, monkeypatch, k, num, short, run):
    """Also with runs that count as long at once and are cut into blocks."""
    monkeypatch.setattr(g, "SHORT", short)
    monkeypatch.setattr(g, "RUN", run)
    rows = odd_rows() + near_group(40) + [(300 + i, prose(40, i)) for i in range(20)]
    got = [tuple(r) for r in g.similarity_groups(docs(rows), words=k, num=num, den=100).collect()]
    assert sorted(got, key=repr) == sorted(brute.similarity_groups(rows, k, num, 100), key=repr)


def test_empty_table(docs):
    assert g.similarity_groups(docs([])).collect() == []
    assert g.keep_first(docs([])).collect() == []


def test_keep_first(docs):
    rows = [*odd_rows(), (3, prose(60, 1).upper()), (10, "another text with the same id altogether")]
    kept = g.keep_first(docs(rows), words=3, num=90, den=100)
    assert kept.columns == docs([]).columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    # Rows whose id is their component's, equal ones once, and all without an id or words.
    groups = list(zip(rows, brute.similarity_groups(rows, 3, 90, 100), strict=True))
    want = [x for x, (i, n, _, _) in groups if i is None or not n] + list({x: 0 for x, (i, n, c, _) in groups if n and i is not None and i == c})
    assert (3, rows[1][1]) in want and (10, rows[-1][1]) in want and (10, rows[0][1]) not in want
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_copies_of_one_id_in_two_groups(docs):
    a, b = prose(60, 1), prose(60, 2)
    kept = g.keep_first(docs([(1, a), (1, b), (2, a), (2, b), (3, edited(a, 1, 1))])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, a), (1, b)])


def test_links_in_blocks(docs, monkeypatch):
    """Components cut into many blocks, and shared shingles in many passes."""
    monkeypatch.setattr(g, "SHORT", 3)
    monkeypatch.setattr(g, "MEMBERS", 7)
    rows = near_group(60) + [(500 + i, edited(prose(40, 4), i % 3, i)) for i in range(9)]
    got = [tuple(r) for r in g.similarity_groups(docs(rows), words=3, num=80, den=100).collect()]
    assert sorted(got) == sorted(brute.similarity_groups(rows, 3, 80, 100)) and max(r[3] for r in got) > 20


def test_signatures_never_overstate_the_difference():
    r = np.random.default_rng(1)
    for n, m in ((3, 4), (64, 70), (120, 130), (500, 530)):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n * 3 // 4], r.integers(0, 2**63, m - n * 3 // 4, dtype=np.uint64))))
        assert g.differing_bits(g.signature(a), g.signature(b)) <= len(np.setxor1d(a, b))


def test_shingles_have_the_sizes_of_brute_force():
    texts = [t for _, t in odd_rows()] + ["a\x0bb\x0cc\rd", "A b c d", "ÀB c d e"]
    sets = list(shingle_sets(pa.array(texts, pa.string()).slice(1), 3))
    assert [len(s) for s in sets] == [len(brute.shingles(t, 3)) for t in texts[1:]]
