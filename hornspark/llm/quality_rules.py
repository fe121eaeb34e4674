"""Quality rules (operator 5), DataFrame functions only.

Rules over text statistics vote good, bad or abstain. How often each pattern of votes occurs is counted over
all documents (at most 3 ** 10 patterns, whatever the input), expectation-maximisation over those counts estimates
how the rules vote on each latent kind of document, and the posterior, compiled into one column expression,
decides. Texts are read once; nothing is shuffled but the pattern counts.

The accuracies are free: there is one kind of document to begin with for each rule, the documents it alone votes
bad, and one for the rest, and the data says which rules vote together. A kind is bad where two rules at least
vote bad on it, much more often than on the rest; a rule that nothing else agrees with is taken for noisy, and the
documents that it alone condemns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import UPPER, WS, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Words of a block in which variety is counted.
BLOCK = 400

RULE_NAMES = ["length", "symbols", "dup_lines", "repeated", "word_chars", "upper", "runs", "variety", "marked", "function"]
#: The statistics that ``with_stats`` adds.
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_runs", "n_distinct", "n_marked", "n_function"]
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "a an and are as at be by for from in is it not of on or that the this to was with "
    "als auch auf das dem den der die ein eine es für ich im ist mit nicht sich sie und von zu "
    "au avec ce dans des du en est et il la le les ne pas par pour que qui sur un une "
    "al con del el las los no para por se su y"
).split()


def with_stats(docs: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """docs with STATS as longs, names after prefix. Null texts count as empty. Word windows are compared by a
    64-bit hash within one text. n_distinct is the mean number of distinct words, rounded down, of the blocks of
    BLOCK words that cover the whole text; the last one ends with it and may overlap the one before. n_marked counts
    words with a symbol or digit, n_function FUNCTION_WORDS, in lower case or with an initial capital."""
    w, x = "__hs_words", "__hs_"
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn(w, words(F.col(text_col))).withColumn(x + "lines", F.filter(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(WS)) != ""))
    df = df.withColumn(x + "h", F.transform(w, lambda s: F.xxhash64(s)))
    h, n = F.col(x + "h"), F.size(w)
    # Hashes of 2, 4 and then 8 words from the pair before; positions over the end are cut off.
    pair = lambda a, gap, least: F.when(n >= least, F.transform(F.sequence(F.lit(0), n - least), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + gap)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(x + "h2", pair(h, 1, 2)).withColumn(x + "h4", pair(F.col(x + "h2"), 2, 4)).withColumn(x + "h8", pair(F.col(x + "h4"), 4, WINDOW))
    wins = F.col(x + "h8")
    df = df.withColumn(x + "s", F.when(F.size(F.array_distinct(wins)) < F.size(wins), F.sort_array(F.transform(wins, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))))
    s = F.col(x + "s")
    twice = F.filter(s, lambda e, k: (F.get(s, k - 1)["v"] == e["v"]) | (F.get(s, k + 1)["v"] == e["v"]))
    df = df.withColumn(x + "p", F.sort_array(F.transform(twice, lambda e: e["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(x + "p", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    runs = F.size(F.filter(h, lambda v, i: F.get(h, i - 1) == v))
    function = [F.xxhash64(F.lit(x)) for v in FUNCTION_WORDS for x in (v, v.capitalize())]
    blocks = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(BLOCK))
    distinct = F.transform(blocks, lambda i: F.size(F.array_distinct(F.slice(h, F.least(i, F.greatest(n - BLOCK, F.lit(0))) + 1, BLOCK))))
    stats = {
        "n_words": n,
        "word_chars": F.length(F.translate(text, WS, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": F.size(x + "lines") - F.size(F.array_distinct(x + "lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size(x + "lines"),
        "n_upper": F.length(text) - F.length(F.translate(text, UPPER, "")),
        "n_runs": runs,
        "n_distinct": F.floor(F.aggregate(distinct, F.lit(0).cast("long"), lambda a, k: a + k) / F.size(blocks)),
        "n_marked": F.size(F.filter(w, lambda v: v.rlike("[0-9#*$%&|<>]"))),
        "n_function": F.size(F.filter(h, lambda v: v.isin(function))),
    }
    return df.select(*docs.columns, *(e.cast("long").alias(prefix + k) for k, e in stats.items()))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def rules(prefix: str) -> list[tuple[Column, Column]]:
    """For each of RULE_NAMES: when it votes bad, when it votes good; it abstains elsewhere."""
    c = {s: F.col(prefix + s) for s in STATS}
    n, full = c["n_words"], c["n_words"] >= 50
    return [
        (n < 20, full),
        (c["n_symbols"] > 0.1 * n, c["n_symbols"] <= 0.02 * n),
        (c["n_dup_lines"] > 0.5 * c["n_lines"], (c["n_lines"] >= 2) & (c["n_dup_lines"] == 0)),
        (c["n_repeat_words"] > 0.3 * n, full & (c["n_repeat_words"] <= 0.1 * n)),
        ((c["word_chars"] < 2.5 * n) | (c["word_chars"] > 14 * n), c["word_chars"].between(3 * n, 10 * n)),
        (c["n_upper"] > 0.4 * c["word_chars"], c["n_upper"] <= 0.15 * c["word_chars"]),
        (c["n_runs"] > 0.2 * n, (n >= 20) & (c["n_runs"] <= 0.02 * n)),
        (full & (c["n_distinct"] < 0.2 * F.least(n, F.lit(BLOCK))), full & (c["n_distinct"] > 0.4 * F.least(n, F.lit(BLOCK)))),
        (c["n_marked"] > 0.3 * n, c["n_marked"] <= 0.1 * n),
        (full & (c["n_function"] < 0.05 * n), c["n_function"] > 0.1 * n),
    ]


def votes_of(prefix: str) -> list[Column]:
    """Each rule's vote: 2 good, 0 bad, 1 abstains."""
    return [F.when(bad, 0).when(good, 2).otherwise(1) for bad, good in rules(prefix)]


#: Documents that the prior of a kind's votes weighs.
STRENGTH = 0.5
#: How much more often than on good documents a rule votes bad on a kind that it speaks against.
LIFT = 0.5


@dataclass
class LabelModel:
    """Kinds of documents. Kind 0 are the documents most rules find good, kind j + 1 began as those rule j votes bad.

    share: of each kind; fails: for each kind and rule, how likely its vote, if there is one, is bad."""

    share: np.ndarray
    fails: np.ndarray

    @property
    def bad(self) -> np.ndarray:
        """Whether each kind is bad: at least two rules vote bad on it much more often than on kind 0."""
        return (self.fails - self.fails[0] > LIFT).sum(axis=1) >= 2

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(kind | votes) for rows of votes."""
        logs = np.log(self.share) + (votes == 0) @ np.log(self.fails).T + (votes == 2) @ np.log1p(-self.fails).T
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def good(self, votes: np.ndarray) -> np.ndarray:
        """P(good | votes) for rows of votes."""
        return self.posterior(votes)[:, ~self.bad].sum(axis=1)

    def quality(self, votes: list[Column]) -> Column:
        """The same as a column: 1 / (1 + the odds of bad kinds against the others)."""

        def weight(k: int) -> Column:
            # Against kind 0, so that exponents stay near 0 where nothing is wrong.
            out = F.lit(float(np.log(self.share[k] / self.share[0])))
            for v, p, q in zip(votes, self.fails[k], self.fails[0], strict=True):
                out = out + F.when(v == 0, float(np.log(p / q))).when(v == 2, float(np.log1p(-p) - np.log1p(-q))).otherwise(0.0)
            return F.exp(F.least(out, F.lit(300.0)))

        bad = self.bad
        against = sum((weight(k) for k in np.flatnonzero(bad)), F.lit(0.0))
        return 1 - against / (against + sum((weight(k) for k in np.flatnonzero(~bad) if k), F.lit(1.0)))


def initial(patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Kind 0 votes as all documents do, the kind of a rule as well but for its own, which is bad nine times of ten."""
    k = patterns.shape[1]
    voted, failed = ((patterns != 1) * counts[:, None]).sum(axis=0), ((patterns == 0) * counts[:, None]).sum(axis=0)
    fails = np.tile((failed + 0.02) / (voted + 1), (k + 1, 1))
    fails[np.arange(1, k + 1), np.arange(k)] = 0.9
    fails[0] = np.minimum(fails[0], 0.5)
    return LabelModel(np.array([0.85] + [0.15 / k] * k), fails)


def fit_votes(counted: dict[tuple[int, ...], int], rounds: int = 200) -> LabelModel:
    """EM over counted vote patterns: shares and vote probabilities of all kinds, with priors of STRENGTH documents."""
    k = len(RULE_NAMES)
    patterns = np.array(sorted(counted), int).reshape(-1, k)
    counts = np.array([counted[tuple(p)] for p in patterns.tolist()], float)
    start = model = initial(patterns, counts)
    for _ in range(rounds):
        weight = model.posterior(patterns) * counts[:, None]
        failed, voted = weight.T @ (patterns == 0), weight.T @ (patterns != 1)
        share = (weight.sum(axis=0) + STRENGTH * start.share) / (counts.sum() + STRENGTH)
        new = LabelModel(share, np.clip((failed + STRENGTH * start.fails) / (voted + STRENGTH), 1e-6, 1 - 1e-6))
        done = np.abs(new.fails - model.fails).max() < 1e-7
        model = new
        if done:
            break
    return model


def judged(docs: DataFrame, text_col: str = "text", prefix: str = "__hs_", carry: list[str] | None = None) -> tuple[DataFrame, LabelModel]:
    """(rows with their STATS after prefix, ``{prefix}base_failed``, ``{prefix}quality`` and ``{prefix}kept``; the fitted model).

    carry: the columns of docs that come along (all by default). Rows are written once to the shared folder
    with their statistics, counted by vote pattern, and read again for the verdict.

    * A null text has no words and fails the base rules, as any text under 20 words does.
    * Repeated rows and ids each get their own, equal verdict; an empty table gives an empty result.
    """
    carry = list(docs.columns) if carry is None else carry
    need = list(dict.fromkeys([*carry, text_col]))
    rows = written(with_stats(docs.select(need), text_col, prefix).select(*carry, *(prefix + s for s in STATS)), "stats")
    votes = votes_of(prefix)
    code = sum((v * 3**j for j, v in enumerate(votes)), F.lit(0))
    found = {r["code"]: r["count"] for r in rows.select(code.alias("code")).groupBy("code").count().collect()}
    pattern = {c: tuple(c // 3**j % 3 for j in range(len(RULE_NAMES))) for c in found}
    model = fit_votes({pattern[c]: n for c, n in found.items()})
    # The verdict by pattern, all of which were counted: a short test, where the posterior's expression is long.
    good_codes = [c for c in sorted(found) if model.good(np.array([pattern[c]]))[0] >= 0.5]
    good = model.quality(votes)
    failed = base_failed(F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words"))
    out = rows.select("*", failed.alias(prefix + "base_failed"), good.alias(prefix + "quality"), (~failed & code.isin(good_codes)).alias(prefix + "kept"))
    return out, model


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    return judged(docs, text_col)[0].where("__hs_kept").select(docs.columns)
