"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def rule_base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(wins)
    hit = {j for i, x in enumerate(wins) if times[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def shingles(text: str | None, k: int) -> frozenset[tuple[str, ...]]:
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def similarity_groups(rows: list[tuple[int | None, str | None]], k: int, num: int, den: int) -> list[tuple[int | None, int, int | None, int]]:
    """(id, size of set, component, links) of each row, by comparing all that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    holders: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        common: Counter = Counter()
        for x in s:
            common.update(holders.get(x, ()))
            holders.setdefault(x, []).append(i)
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), None if d is None else least[find(i)], links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
