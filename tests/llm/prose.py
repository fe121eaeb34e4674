"""Invented prose for tests."""

from __future__ import annotations

import random

WORDS = "river stone letter window garden market silver painter story winter bridge captain mirror lantern harbor forest village music evening engine doctor orange paper season teacher".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) + r.choice(["", "", "s", "ed", "ing", "ly"])
        out.append(w.capitalize() if i % 12 == 0 else w + ("." if i % 12 == 11 else ""))
    return " ".join(out)


def edited(text: str, k: int, seed: int) -> str:
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"word{r.randrange(10**6)}"
    return " ".join(w)


def natural(n: int, seed: int) -> str:
    """prose with a function word in each third place."""
    r = random.Random(seed)
    return " ".join(r.choice("the of and to in is on with".split()) if i % 3 == 1 else w for i, w in enumerate(prose(n, seed).split()))
