"""N-gram Jaccard join (operator 1): which texts are linked by the similarity of their shingle sets.

1. A count sketch over the shingles of all documents, of a size that follows the bytes of text, gives one global
   order, rare first. Any order that all documents share is right; a good one keeps lists short.
2. Each document gets the size and digest of its set, a parity signature, and its prefix: the n - ceil(t n) + 1
   rarest shingles, of which two linked sets share one at least. Equal sets become one class.
3. Prefix shingles are dealt by hash and scanned in runs. Pairs must pass the length and the positional filter.
   Short runs give all their pairs, long ones a star and a chain at first. Shingles that may be in very many
   prefixes by the sketch are counted exactly, and those that are, are dealt over several runs.
4. Distinct pairs pass the suffix filter (a lower bound on the symmetric difference from the parity signatures)
   and are verified once on whole sets, which are computed again from the texts of the classes in question.
5. Verified links are contracted to components. In long runs, pairs of classes that are still in different
   components are then joined, filtered and verified as well, so that no link between components is missed,
   while pairs within a component, which can't change the components, are not made.
6. Links are counted. Where no run was long, all have been verified by then. The sets of the other components are
   compared in blocks, as bits over the shingles that a block shares, and only counts come out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written
from .components import components
from .hashing import shingle_sets

#: The sketch has a counter for so many bytes of text, and 2 ** these for the smallest and the largest input.
BYTES, LEAST_BITS, MOST_BITS = 64, 16, 24
_PART = 1 << 14
#: Runs up to this length give all their pairs at once.
SHORT = 24
#: Hot shingles are dealt over several runs of about this many documents.
RUN = 8192
#: Members and shingles of a component in one block of step 6.
MEMBERS, MEMBER_TOKENS = 512, 1 << 18
#: Bits of a signature at most.
SIGNATURE = 1 << 14


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# -- 1. the order ---------------------------------------------------------------------------------------------

_COUNTS = _schema(part=pa.int32(), counts=pa.binary())


def _packed(counts: np.ndarray, kind: str, base: int = 0) -> pa.RecordBatch:
    parts = counts.reshape(-1, _PART)
    some = np.flatnonzero(parts.any(axis=1))
    return _rows(_COUNTS, (some + base).tolist(), [zlib.compress(parts[i].astype(kind).tobytes(), 1) for i in some])


def _count(k: int, bits: int):
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, size = np.zeros(1 << bits, np.uint32), [], 0

        def add() -> None:
            nonlocal waiting, size
            if waiting:
                cell, n = np.unique((np.concatenate(waiting) >> shift).astype(np.uint32), return_counts=True)
                counts[cell] += n.astype(np.uint32)
            waiting, size = [], 0

        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                waiting.append(s)
                size += len(s)
                if size > 1 << 20:
                    add()
        add()
        yield _packed(counts, "<u4")

    return run


def _rank(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte: eight steps for each power of two."""
    return np.minimum(255, np.floor(8 * np.log2(counts.astype(np.float64) + 1))).astype(np.uint8)


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(raw), "<u4")
            if part in total:
                total[part] += own
            else:
                total[part] = own.astype(np.uint64)
    for part, own in total.items():
        yield _packed(_rank(own), "u1", part)


def shingle_ranks(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """By the leading bits of a shingle's hash, how many documents hold one with these bits, in steps (``_rank``)."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(size // BYTES).bit_length()))
    counts = written(docs.select(text_col).mapInArrow(_count(k, bits), "part int, counts binary"), "counts")
    parts = written(counts.repartition("part").mapInArrow(_sum_counts, "part int, counts binary"), "ranks")
    ranks = np.zeros(1 << bits, np.uint8).reshape(-1, _PART)
    for r in parts.toLocalIterator():  # 2 ** MOST_BITS bytes in all
        ranks[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), "u1")
    return ranks.reshape(-1)


# -- 2. sets, prefixes and signatures -------------------------------------------------------------------------


def signature(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' hashes in as many bits, a power of two, as there are tokens at least, or in SIGNATURE
    bits: of two signatures, folded to the shorter's length, no more bits differ than tokens."""
    size = min(SIGNATURE, max(64, 1 << int(len(tokens) - 1).bit_length()))
    bits = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


_DOCS = _schema(doc_id=pa.int64(), key=pa.binary(), n=pa.int64(), digest=pa.binary(), prefix=pa.list_(pa.int64()), suspect=pa.list_(pa.bool_()), signature=pa.binary())
_DOCS_DDL = "doc_id long, key binary, n long, digest binary, prefix array<long>, suspect array<boolean>, signature binary"


def _lists(values: list[np.ndarray | None], kind: pa.DataType, dtype: type) -> pa.Array:
    sizes = np.array([0 if v is None else len(v) for v in values], np.int32)
    flat = np.concatenate([np.zeros(0, dtype), *(v for v in values if v is not None)])
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(flat, kind))


def _describe(ranks, k: int, num: int, den: int):
    hot = int(_rank(np.array([RUN]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = ranks.value
        shift = np.uint64(64 - int(len(order) - 1).bit_length())
        for batch in batches:
            n, digest, prefix, suspect, sig = [], [], [], [], []
            for s in shingle_sets(batch.column(2), k):
                n.append(len(s))
                if len(s) == 0:
                    digest.append(None), prefix.append(None), suspect.append(None), sig.append(None)
                    continue
                first = len(s) + num * -len(s) // den + 1  # n - ceil(t n) + 1
                rank = order[(s >> shift).astype(np.int64)]
                own = np.argsort(rank, kind="stable")[:first]
                digest.append(_digest(s)), prefix.append(s[own].view(np.int64)), suspect.append(rank[own] >= hot), sig.append(signature(s))
            yield _rows(_DOCS, batch.column(0), batch.column(1), n, digest, _lists(prefix, pa.int64(), np.int64), _lists(suspect, pa.bool_(), bool), sig)

    return run


# -- 3. runs of equal shingles --------------------------------------------------------------------------------

_FOUND = _schema(a=pa.int64(), b=pa.int64(), token=pa.int64(), n=pa.int64(), pos=pa.int32(), hub=pa.bool_())


def _postings(classes: DataFrame) -> DataFrame:
    """(token, salt, n, c, pos): the classes by the shingles of their prefixes. Shingles in more than RUN prefixes
    are dealt over runs 1, 2, …; only those that the sketch suspects are counted."""
    at = classes.select("c", "n", F.posexplode(F.arrays_zip("prefix", "suspect")).alias("pos", "x")).select(F.col("x.prefix").alias("token"), "n", "c", "pos", F.col("x.suspect").alias("suspect"))
    suspected = classes.where(F.exists("suspect", lambda x: x))
    often = suspected.select(F.explode(F.arrays_zip("prefix", "suspect")).alias("x")).where("x.suspect").groupBy(F.col("x.prefix").alias("token")).count()
    often = written(often.where(F.col("count") > RUN).select("token", F.ceil(F.col("count") / RUN).cast("int").alias("runs")), "often")
    if often.isEmpty():
        return at.select("token", F.lit(0).alias("salt"), "n", "c", "pos")
    dealt = at.where("suspect").join(often, "token", "left").withColumn("salt", F.when(F.col("runs").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("c"), F.col("runs"))).cast("int"))
    names = ["token", "salt", "n", "c", "pos"]
    return at.where("NOT suspect").withColumn("salt", F.lit(0)).select(names).union(dealt.select(names))


def _alike(n, m, i, j, num: int, den: int):
    """Length and positional filter for sizes n and m and the positions i and j of a common token. Tokens before
    it aren't counted: of the tokens that two sets share, the first one has none before it, and its test is enough."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    most = np.minimum(n - i, m - j)
    return (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (most * (num + den) >= num * (n + m))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(token, salt, n, c, pos) of the batches, in pieces that end where a run ends."""
    left: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(cols[0]):
            continue
        if left is not None:
            cols = tuple(np.concatenate(x) for x in zip(left, cols, strict=True))
        change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0))
        cut = change[-1] + 1 if len(change) else 0
        if cut:
            yield tuple(x[:cut] for x in cols)
        left = tuple(x[cut:] for x in cols)
    if left is not None:
        yield left


def _scan(num: int, den: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, salt, n, c, pos in _runs(batches):
            edges = np.concatenate(([0], np.flatnonzero((np.diff(token) != 0) | (np.diff(salt) != 0)) + 1, [len(token)]))
            size = np.repeat(np.diff(edges), np.diff(edges))
            last = np.repeat(edges[1:], np.diff(edges))
            at = np.arange(len(token))
            small = (size <= short) & (salt == 0)
            for gap in range(1, short):  # all pairs of short runs, by distance
                i = at[small & (at + gap < last)]
                if not len(i):
                    break
                i = i[_alike(n[i], n[i + gap], pos[i], pos[i + gap], num, den)]
                if len(i):
                    yield _pairs(c[i], c[i + gap])
            big = np.flatnonzero(~small)
            if len(big):
                hub = np.zeros(len(token), bool)
                ends = edges[1:]
                for a, b in zip(edges[:-1], ends, strict=True):
                    if small[a]:
                        continue
                    h = a
                    while h < b:  # sorted by size: a star over all that can be linked to its centre, then the next
                        stop = h + int(np.searchsorted(n[h:b] * num, n[h] * den, "right"))
                        hub[h] = True
                        if stop > h + 1:
                            yield _pairs(np.full(stop - h - 1, c[h]), c[h + 1 : stop])
                        h = stop
                    if b > a + 1:
                        yield _pairs(c[a : b - 1], c[a + 1 : b])
                yield _rows(_FOUND, c[big], pa.nulls(len(big), pa.int64()), token[big], n[big], pos[big], hub[big] & (salt[big] > 0))

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    k = len(a)
    return _rows(_FOUND, np.minimum(a, b), np.maximum(a, b), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.bool_()))


_FOUND_DDL = "a long, b long, token long, n long, pos int, hub boolean"


def _scanned(postings: DataFrame, num: int, den: int) -> DataFrame:
    return postings.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "c").mapInArrow(_scan(num, den, SHORT), _FOUND_DDL)


# -- 4. filters and verification ------------------------------------------------------------------------------

_PAIRS = _schema(a=pa.int64(), b=pa.int64())


def _suffix_filter(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (batch.column(i) for i in range(6))
            most = (den - num) * (n.to_numpy() + m.to_numpy()) // (num + den)  # of the symmetric difference
            stay = [i for i, (s, t) in enumerate(zip(x.to_pylist(), y.to_pylist(), strict=True)) if differing_bits(s, t) <= most[i]]
            yield _rows(_PAIRS, a.take(pa.array(stay, pa.int64())), b.take(pa.array(stay, pa.int64())))

    return run


def _sets(k: int):
    schema = _schema(c=pa.int64(), tokens=pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, tokens, size = [], [], 0
            for own, digest, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                if _digest(s) == digest:
                    c.append(own), tokens.append(s.tobytes())
                    size += s.nbytes
                if size > 1 << 24:
                    yield _rows(schema, c, tokens)
                    c, tokens, size = [], [], 0
            yield _rows(schema, c, tokens)

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((s, t))
                both.sort(kind="stable")  # two sorted runs: a merge
                common = int((both[1:] == both[:-1]).sum())
                if common * den >= num * (len(s) + len(t) - common):
                    stay.append(i)
            yield _rows(_PAIRS, batch.column(0).take(pa.array(stay, pa.int64())), batch.column(1).take(pa.array(stay, pa.int64())))

    return run


def _filtered(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that pass the suffix filter."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias("n" + x), F.col("signature").alias("s" + x))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_suffix_filter(num, den), "a long, b long")


def _across(num: int, den: int):
    """Pairs of rows (token, i, j, block, c, n, pos, root, signature) of one run (token, i, j), sorted by n, whose
    roots differ and blocks are i and j, and that pass all filters. Pairs that fail are never made into rows."""

    def pairs(block, c, n, pos, root, sig, i, j) -> pa.RecordBatch:
        words = [np.frombuffer(s, np.uint64) for s in sig]
        size = np.array([len(w) for w in words])
        folded: dict[int, np.ndarray] = {}
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in range(len(c)):
            stop = int(np.searchsorted(n * num, n[x] * den, "right"))
            y = np.arange(x + 1, stop)
            other = i + j - block[x] if i != j else i
            y = y[(root[y] != root[x]) & (block[y] == other)]
            y = y[_alike(np.full(len(y), n[x]), n[y], np.full(len(y), pos[x]), pos[y], num, den)]
            if not len(y):
                continue
            s = int(size[x])
            if s not in folded:
                folded[s] = np.stack([_folded(w, s) if len(w) >= s else np.zeros(s, np.uint64) for w in words])
            y = y[size[y] >= s]  # n is sorted, and signatures grow with n
            differ = np.bitwise_count(folded[s][y] ^ words[x]).sum(axis=1)
            y = y[differ <= (den - num) * (n[x] + n[y]) // (num + den)]
            a.append(np.full(len(y), c[x])), b.append(c[y])
        left, right = np.concatenate(a), np.concatenate(b)
        return _rows(_PAIRS, np.minimum(left, right), np.maximum(left, right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush():
            if len(held) > 1:
                block, c, n, pos, root = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:5])
                yield pairs(block, c, n, pos, root, [h[5] for h in held], key[1], key[2])

        for batch in batches:
            for token, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (token, i, j) != key:
                    yield from flush()
                    key, held = (token, i, j), []
                held.append(rest)
        yield from flush()

    return run


def _folded(w: np.ndarray, size: int) -> np.ndarray:
    while len(w) > size:
        w = w[: len(w) // 2] ^ w[len(w) // 2 :]
    return w


def _linked(near: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """The pairs (a, b) of classes whose sets are similar enough, as a written table; None if no pair may be."""
    near = written(near, "near")
    if near.isEmpty():
        return None
    needed = near.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(classes, "c").select("c", "doc_id", "digest")
    texts = docs.join(needed, "doc_id").select("c", "text", "digest")
    sets = written(texts.mapInArrow(_sets(k), "c long, tokens binary").dropDuplicates(["c"]), "sets")
    side = lambda x: sets.select(F.col("c").alias(x), F.col("tokens").alias("t" + x))
    return written(near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_verify(num, den), "a long, b long"), "links")


# -- 6. numbers of links --------------------------------------------------------------------------------------


def _common(tokens: list[np.ndarray], pairs_of) -> np.ndarray:
    """How many tokens the sets share, by row and column; only those columns of a row that pairs_of(row) gives."""
    rows = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, token, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    keep = times[token] > 1  # what one set has alone is common to none
    rows, token = rows[keep], np.unique(token[keep], return_inverse=True)[1]
    common = np.zeros((len(tokens), len(tokens)), np.int32)
    for low in range(0, int(token.max(initial=-1)) + 1, 1 << 15):
        own = (token >= low) & (token < low + (1 << 15))
        at, bit = rows[own], token[own] - low
        words = np.zeros((len(tokens), int(bit.max(initial=0)) // 64 + 1), np.uint64)
        np.bitwise_or.at(words, (at, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        for x in range(len(tokens)):
            y = pairs_of(x)
            if len(y):
                common[x, y] += np.bitwise_count(words[y] & words[x]).sum(axis=1, dtype=np.int32)
    return common


_LINKS = _schema(c=pa.int64(), k=pa.int64())


def _count_links(num: int, den: int):
    """Rows (root, i, j, block, c, n, size, tokens) of pairs of blocks, sorted by the first three and n, to (c, how
    many documents of other classes in the two blocks it is linked with)."""

    def counted(held: list[tuple], i: int, j: int) -> Iterator[pa.RecordBatch]:
        block, c, n, size = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:4])
        tokens = [np.frombuffer(h[4], np.uint64) for h in held]

        def pairs_of(x: int) -> np.ndarray:
            y = np.arange(x + 1, int(np.searchsorted(n * num, n[x] * den, "right")))
            return y if i == j else y[block[y] != block[x]]

        common = _common(tokens, pairs_of)
        linked = np.zeros(common.shape, bool)
        for x in range(len(c)):
            y = pairs_of(x)
            linked[x, y] = common[x, y] * den >= num * (n[x] + n[y] - common[x, y])
        linked |= linked.T
        yield _rows(_LINKS, c, linked @ size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for root, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, i, j) != key:
                    if len(held) > 1:
                        yield from counted(held, *key[1:])
                    key, held = (root, i, j), []
                held.append(tuple(rest))
        if len(held) > 1:
            yield from counted(held, *key[1:])

    return run


def _within(members: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(c, k): the links of members (root, c, n, size, doc_id, digest) of whole components, counted in blocks."""
    many = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / MEMBER_TOKENS)).cast("int").alias("blocks"))
    sets = written(docs.join(members.select("c", "doc_id", "digest"), "doc_id").select("c", "text", "digest").mapInArrow(_sets(k), "c long, tokens binary").dropDuplicates(["c"]), "member-sets")
    own = members.join(many, "root").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("root", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "c", "n", "size").join(sets, "c")
    own = own.select("root", "i", "j", "block", "c", "n", "size", "tokens").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "n", "c")
    return own.mapInArrow(_count_links(num, den), "c long, k long")


def _n_links(links: DataFrame, root: DataFrame, classes: DataFrame, long_runs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(c, k): with how many documents of other classes each class is linked."""
    touched = written(long_runs.join(root.withColumnRenamed("node", "c"), "c").select("root").distinct(), "touched")
    own = root.join(touched, "root", "left_semi")
    rest = links.join(own.select(F.col("node").alias("a")), "a", "left_anti")
    sized = classes.select(F.col("c").alias("other"), "size")
    both = rest.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("other")), F.struct(F.col("b").alias("c"), F.col("a").alias("other")))).alias("e")).select("e.*")
    k_of = both.distinct().join(sized, "other").select("c", F.col("size").alias("k"))
    if not touched.isEmpty():
        members = own.withColumnRenamed("node", "c").join(classes.select("c", "n", "size", "doc_id", "digest"), "c")
        k_of = k_of.union(written(_within(written(members, "members"), docs, k, num, den), "member-links"))
    return k_of.groupBy("c").agg(F.sum("k").alias("k"))


# -- the whole ------------------------------------------------------------------------------------------------


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, count_links: bool) -> DataFrame:
    """(doc_id, key, n_shingles, first, n_links) for each row; key is a digest of the text, first the smallest
    (doc_id, key) of its component, null for rows that are linked with nothing, not even themselves."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranks = spark.sparkContext.broadcast(shingle_ranks(docs, "text", words))
    keyed = docs.select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")
    rows = written(keyed.mapInArrow(_describe(ranks, words, num, den), _DOCS_DDL), "rows")
    same = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("size"), *(F.first(c).alias(c) for c in ("n", "prefix", "suspect", "signature"))
    )
    classes = written(same.withColumn("c", F.monotonically_increasing_id()).withColumn("doc_id", F.col("first.doc_id")), "classes")

    found = written(_scanned(_postings(classes), num, den), "runs")
    hubs = found.where("hub").select("token", F.lit(0).alias("salt"), "n", F.col("a").alias("c"), "pos")
    pairs = found.where("b IS NOT NULL").select("a", "b").union(_scanned(hubs, num, den).where("b IS NOT NULL").select("a", "b")).distinct()
    links = _linked(_filtered(pairs, classes, num, den), classes, docs, words, num, den)
    root = components(links) if links is not None else None

    long_runs = found.where("b IS NULL").select("token", F.col("a").alias("c"), "n", "pos")
    if not long_runs.isEmpty():
        own = long_runs.join(root.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")) if root is not None else long_runs.withColumn("root", F.col("c"))
        own = written(own, "long-runs")
        open_ = own.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo < hi")
        # A run longer than RUN is cut into blocks, and each pair of blocks is a run of its own.
        own = own.join(written(open_.select("token", F.ceil(F.col("m") / RUN).cast("int").alias("blocks")), "open-runs"), "token")
        own = own.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        own = own.join(classes.select("c", "signature"), "c").select("token", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "c", "n", "pos", "root", "signature")
        near = own.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "c").mapInArrow(_across(num, den), "a long, b long").distinct()
        more = _linked(near, classes, docs, words, num, den)
        if more is not None:
            links = links.union(more) if links is not None else more
            root = components(links)

    labelled = classes.select("digest", "c", "first", "size")
    if root is not None:
        labelled = labelled.join(root.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        labelled = labelled.drop("first").join(labelled.groupBy("root").agg(F.min("first").alias("first")), "root")
        if count_links:
            labelled = labelled.join(_n_links(links, root, classes, long_runs, docs, words, num, den), "c", "left")
    k = F.coalesce("k", F.lit(0)) if count_links and root is not None else F.lit(0)
    labelled = labelled.select("digest", "first", (F.col("size") - 1 + k).cast("long").alias("n_links"))
    linked = rows.select("doc_id", "key", F.col("n").alias("n_shingles"), "digest").join(labelled, "digest", "left")
    alone = F.col("doc_id").isNull()
    return linked.select("doc_id", "key", "n_shingles", F.when(~alone, F.col("first")).alias("first"), F.when(alone, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))


def similarity_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs: texts are linked if
    den * intersection >= num * union of their shingle sets; component_id is the smallest id reachable, n_links the
    number of other rows it is linked with.

    * Null texts and texts without words have empty sets and are linked with nothing; so are rows with a null
      id, whose component_id is null. A text with fewer words than a shingle is one shingle.
    * Rows with the same id each keep their own set and are not linked by the id; equal texts always are.
    * An empty table gives an empty result; further columns of docs are not looked at.
    * A very long text is hashed in one piece, some 100 bytes a word.
    """
    rows = _grouped(docs, id_col, text_col, words, num, den, True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), "n_links")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: of those with its smallest id the one whose text has the smallest digest.
    Rows that repeat an id and a text are one document and one of them stays, rows that repeat an id alone are not.
    Rows with a null id and texts without words all stay."""
    rows = _grouped(docs, id_col, text_col, words, num, den, False)
    own = rows.where("first IS NOT NULL").select(F.struct("doc_id", "key").alias("own"), "first")
    later = written(own.where("own <> first").select("own").distinct(), "later")
    twice = written(own.where("own = first").groupBy("own").count().where("count > 1").select("own"), "repeated")
    this = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text_col)).alias("key"))
    stay = docs.join(later, this == F.col("own"), "left_anti")
    if twice.isEmpty():
        return stay
    once = stay.join(twice, this == F.col("own"), "left_semi").withColumn("__hs_own", this).dropDuplicates(["__hs_own"]).drop("__hs_own")
    return stay.join(twice, this == F.col("own"), "left_anti").unionByName(once)
