from __future__ import annotations

import hashlib
import random

import brute
import numpy as np
from prose import natural, prose

from hornspark.llm import line_dedup, quality_rules

SPACE = " \t\n\x0b\x0c\r"


def deduplicated(rows):
    """(id, n_lines, n_dropped, text) of each row by plain Python."""
    key = lambda x: x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    holders: dict[str, set] = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_equals_brute_force(docs):
    shared = "Shared line of some length"
    rows = [
        (1, f"{shared}\nmine\n{shared}\n"), (2, f"own line of two\n\t{shared.upper()} \r\nshort\n\nlast"), (3, shared), (4, None), (5, ""), (6, "short\nshort\n\n"),
        (2, "own line of two\nother row of two"), (2, "own line of two\nother row of two"), (None, shared), (7, "Éclair au chocolat\néclair au chocolat"), (8, "éclair au chocolat"),
        (9, "\n".join(f"line number {i % 300}" for i in range(4000))), (10, "\n".join(f"LINE number {i}" for i in range(500))), (11, "\n" * 50), (12, "ten chars!"), (13, "ten chars!"), (14, "nine char"), (15, "nine char"),
    ]
    df = line_dedup.dedup_lines(docs(rows), n_lines_col="lines", n_dropped_col="dropped")
    got = [(r["doc_id"], r["lines"], r["dropped"], r["text"]) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(deduplicated(rows), key=repr)
    assert df.columns == [*docs([]).columns, "lines", "dropped"]
    assert line_dedup.dedup_lines(docs([])).collect() == []


def test_line_dedup_threshold(docs):
    rows = [(i, "a line that all hold\nfiller %d" % i) for i in range(3)] + [(7, "a line of two only"), (8, "a line of two only")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(rows), min_docs=3).collect()}
    assert got[0].startswith("a line") and got[1] == "filler 1" and got[8] == "a line of two only"


def test_emptied_documents_go(docs):
    rows = [(1, "a line that two hold\nmine alone, this one"), (2, "a line that two hold\n\n"), (3, "A LINE that two hold"), (4, ""), (5, None), (6, " \n"), (7, "a line that two hold\nshort"), (None, "a line that two hold")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(rows), drop_emptied=True).collect()}
    assert got == {1: rows[0][1], 4: "", 5: "", 6: " \n", 7: "short", None: "a line that two hold"}


def test_rule_statistics_equal_brute_force(docs):
    phrase = " ".join(f"w{i}" for i in range(12))
    rows = [(1, None), (2, ""), (3, " \n "), (4, f"{phrase} x {phrase}"), (5, f"{phrase} {phrase} {phrase}"), (6, "a b c d e f g h\n" * 5), (7, "la " * 4000), (8, prose(300, 1)), (9, "é ñ 中 😀 #$%&|<>*\n😀\n😀"), (8, prose(300, 1)), (None, prose(30, 2)), (10, "a\x1cb c\x0bd")]
    out, _ = quality_rules.judged(docs(rows), carry=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = [(r["doc_id"], *(r[f"__hs_{n}"] for n in names), r["__hs_base_failed"]) for r in out.collect()]
    want = []
    for i, t in rows:
        b = brute.rule_base(t)
        want.append((i, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert quality_rules.judged(docs([]))[0].collect() == []


def test_rules_catch_junk_and_keep_prose(docs):
    clean = [(i, natural(80 + i, i)) for i in range(120)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in natural(80, 500 + i).split())) for i in range(15)] + [(2000 + i, natural(80, 700 + i).upper()) for i in range(15)]
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs(clean + junk)).collect()}
    assert kept == {i for i, _ in clean}
    # Without junk all stays.
    assert quality_rules.keep_good(docs(clean)).count() == len(clean)


def test_a_rule_that_nothing_agrees_with_is_outvoted(docs):
    # One document in eight has many digits and is fine otherwise: all-must-pass would lose it.
    clean = [(i, natural(80 + i, i)) for i in range(160)]
    odd = [(500 + i, " ".join(f"{w}{k}" if k % 5 < 2 else w for k, w in enumerate(natural(90, 300 + i).split()))) for i in range(20)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in natural(80, 500 + i).split())) for i in range(15)]
    rows, _ = quality_rules.judged(docs(clean + odd + junk), carry=["doc_id"])
    votes = quality_rules.votes_of("__hs_")
    got = {r["doc_id"]: r for r in rows.select("doc_id", "__hs_kept", *(v.alias(n) for v, n in zip(votes, quality_rules.RULE_NAMES, strict=True))).collect()}
    assert all([n for n in quality_rules.RULE_NAMES if got[i][n] == 0] == ["marked"] for i, _ in odd)
    assert {i for i, r in got.items() if r["__hs_kept"]} == {i for i, _ in clean + odd}


def simulated(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(votes, whether good): two kinds of bad on which three and two rules agree, and a rule that votes bad at random."""
    r = np.random.default_rng(seed)
    kind = r.choice(3, n, p=[0.8, 0.12, 0.08])
    p = np.full((n, 10), 0.01)
    p[np.ix_(kind == 1, [1, 8, 9])] = 0.85
    p[np.ix_(kind == 2, [5, 9])] = 0.9
    p[:, 4] = 0.2
    votes = np.where(r.random((n, 10)) < p, 0, 2)
    votes[r.random((n, 10)) < 0.1] = 1
    return votes, kind == 0


def test_em_beats_all_must_pass_and_the_model_it_starts_from():
    votes, good = simulated(5000, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    counted = {tuple(p): int(k) for p, k in zip(patterns.tolist(), counts, strict=True)}
    model = quality_rules.fit_votes(counted)
    right = lambda kept: float((kept == good).mean())
    em = right(model.good(votes) >= 0.5)
    must_pass, start = right((votes != 0).all(axis=1)), right(quality_rules.initial(patterns, counts.astype(float)).good(votes) >= 0.5)
    assert em > 0.97 and em > must_pass + 0.1 and em > start + 0.1
    assert not model.bad[5] and not model.bad[0] and model.bad[[2, 6, 9, 10]].all()  # the random rule's kind isn't bad
    # What EM found is near the truth.
    assert abs(model.share[model.bad].sum() - 0.2) < 0.02 and abs(model.fails[0][4] - 0.2) < 0.05


def test_quality_column_equals_the_model(docs):
    rows = [(i, natural(30 + 5 * i, i)) for i in range(20)] + [(50 + i, "A1! " * (40 + i)) for i in range(4)] + [(60, "short one"), (61, None)]
    out, model = quality_rules.judged(docs(rows), carry=["doc_id"])
    votes = [v.alias(f"v{j}") for j, v in enumerate(quality_rules.votes_of("__hs_"))]
    found = out.select("__hs_quality", *votes).collect()
    assert model.bad.any() and np.allclose(model.good(np.array([tuple(r)[1:] for r in found])), [r[0] for r in found], atol=1e-9)


def test_em_is_deterministic_and_takes_no_rows():
    good, odd = (2,) * 10, (2, 0) + (2,) * 7 + (0,)
    first, again = (quality_rules.fit_votes({good: 900, odd: 100}) for _ in range(2))
    assert first.good(np.array([good, odd])).round().tolist() == [1, 0]
    assert hashlib.sha256(first.fails.tobytes()).digest() == hashlib.sha256(again.fails.tobytes()).digest()
    assert quality_rules.fit_votes({}).share[0] > 0.5


def test_variety_is_of_the_whole_text(docs):
    r = random.Random(4)
    rich = lambda k: [w if i % 3 == 1 else w + "abcdefghijklmnopqrst"[r.randrange(20)] + "uvwxyz"[r.randrange(6)] for i, w in enumerate(natural(k, 9).split())]
    poor = lambda k: [r.choice("red ten box hat cup pen mat jar fox owl ivy elk".split()) for _ in range(k)]
    texts = {i: rich(400) + poor(4000) for i in range(10, 25)} | {1: rich(400) + poor(4000), 2: poor(400) + rich(4000), 3: rich(400), 4: poor(400), 5: rich(401), 6: rich(790) + poor(10), 7: rich(60)}
    rows = [(i, " ".join(w)) for i, w in texts.items()] + [(8, None), (9, "")]
    got = {x["doc_id"]: x for x in quality_rules.judged(docs(rows + [(100 + i, natural(80 + i, i)) for i in range(60)]), carry=["doc_id"])[0].collect()}
    for i, w in texts.items():
        blocks = [w[min(b, max(0, len(w) - 400)) :][:400] for b in range(0, len(w), 400)]
        assert got[i]["__hs_n_distinct"] == sum(len(set(b)) for b in blocks) // len(blocks)
    assert got[8]["__hs_n_distinct"] == got[9]["__hs_n_distinct"] == 0
    # Junk after ordinary words isn't kept, ordinary words after a list are.
    assert not any(got[i]["__hs_kept"] for i in (1, *range(10, 25))) and got[2]["__hs_kept"]
