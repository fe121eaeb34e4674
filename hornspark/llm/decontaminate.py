"""Benchmark decontamination (operator 8): template canonicalisation.

Words lose punctuation at their ends and upper case. Texts are compared in three forms: *same* (words as they are),
*typed* (numbers and units after them become placeholders) and *named* (so do names: all words with an initial
capital, wherever they stand). A run of names, or of number words, is one placeholder. Each window of template
words of an item is kept in the forms that say enough: windows poor in literal words only as they are.

Windows are hash-joined: a bitmap of the benchmark's window hashes, of bounded size, goes to the documents, whose
windows that may match become rows, and these are joined with the benchmark's windows by hash. The benchmark itself
is never sent anywhere. Matches of a text and an item are aligned, and the values that stand in the slots must
correspond one to one over all that counts: then it's the item, verbatim or with new parameters.

Whether a text holds an item depends on the text alone, so that results are kept by a digest of the text: copies of
a document are one document here.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written
from .hashing import _PLACE, chunks, mix, word_hashes

WINDOW = 8
#: A window with fewer literal words than this is compared as it is; in items that are one window, one fewer will do.
LITERAL = 4
#: An item is found by this share of its windows in one alignment, or by RUN words in a row.
COVERAGE = 0.5
RUN = 13
#: Words by which two parts of an item may be moved apart and still count together.
DRIFT = 2
#: An item with several windows is found by this many of them at least.
LEAST = 3
#: The bitmap has this many bits for a window, and 2 ** these for the smallest and the largest benchmark: 8 KB to 16 MB.
BITS, LEAST_BITS, MOST_BITS = 128, 16, 27
#: Units, which count as such after a number.
UNITS = (
    "% percent mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes oz ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur km/h kmh mph hz khz mhz w kw kwh v volts j kj cal kcal degrees celsius fahrenheit"
).split()
#: Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = [*ONES, *TENS, "hundred", "thousand", "million", "billion", "dozen", *(f"{t}-{o}" for t in TENS for o in ONES[1:10])]

WORD, NUMBER, NAME, UNIT = range(4)
SAME, TYPED, NAMED = range(3)
_TYPE = mix(np.arange(11, 15, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
_FORM = mix(np.arange(21, 24, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_BIT = np.left_shift(1, np.arange(8)).astype(np.uint8)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;,"]] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, in UTF-8."""
    low = np.where(_UPPER[data], data + 32, data).astype(np.uint8)
    if len(data) > 1:
        low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32
    return low


def _hashes(texts: list[str]) -> np.ndarray:
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    return np.sort(np.array([word_hashes(r, np.array([0, len(r)]), lower=False)[0][0] for r in raw], np.uint64))


_UNIT_HASHES, _NUMBER_HASHES = _hashes(UNITS), _hashes(NUMBERS)


class Form:
    """One form of some texts: for each template word its hash, value, type and whether it is literal (a word, no
    placeholder or punctuation), and where each text's words begin."""

    def __init__(self, form: int, template: np.ndarray, value: np.ndarray, kind: np.ndarray, literal: np.ndarray, at: np.ndarray) -> None:
        self.form, self.template, self.value, self.kind, self.literal, self.at = form, template, value, kind, literal, at

    def windows(self, length: int) -> np.ndarray:
        """The hash of each window of length words; those that run over a text's end mean nothing."""
        n = max(0, len(self.template) - length + 1)
        total = np.full(n, np.uint64(length) + _FORM[self.form], np.uint64)
        for j in range(length):
            total += self.template[j : j + n] * _PLACE[j]
        return mix(total)

    def slots(self, p: int, length: int) -> bytes:
        """The values in the slots of the window at p, in order."""
        own = slice(p, p + length)
        return self.value[own][self.kind[own] != WORD].tobytes()


def forms(data: np.ndarray, offsets: np.ndarray) -> list[Form]:
    """The texts' forms, by SAME, TYPED and NAMED."""
    low = _lowered(data)
    _, starts, ends = word_hashes(data, offsets)
    begin, last = starts.copy(), ends - 1
    while len(move := np.flatnonzero(_PUNCT[data[begin]] & (begin < last))):
        begin[move] += 1
    while len(move := np.flatnonzero(_PUNCT[data[last]] & (last > begin))):
        last[move] -= 1
    # The cores laid out one after another, hashed as words of their own.
    size = last + 1 - begin
    edges = np.concatenate(([0], np.cumsum(size)))
    core = low[np.repeat(begin - edges[:-1], size) + np.arange(edges[-1])]
    value, kept, _ = word_hashes(core, edges, lower=False)
    assert len(kept) == len(starts)
    at = np.searchsorted(starts, offsets)
    # Whether a word goes on what the word before began: not over the end of a text, sentence or clause.
    joins = np.ones(len(starts), bool)
    joins[at[:-1][at[:-1] < len(starts)]] = False
    if len(starts) > 1:
        joins[1:] &= ~_STOP[data[ends[:-1] - 1]]
    plain = np.full(len(starts), WORD, np.int8)
    typed = plain.copy()
    spelled = np.isin(value, _NUMBER_HASHES)
    typed[_DIGIT[data[begin]] | spelled] = NUMBER
    after = np.concatenate(([False], typed[:-1] == NUMBER)) & joins if len(starts) else joins
    typed[after & np.isin(value, _UNIT_HASHES) & (typed == WORD)] = UNIT
    # Names begin in upper case and go on in lower case; what is all in upper case is shouted.
    head = data[begin] if len(begin) else data[:0]
    letter = np.minimum(begin + (head == 0xC3), max(0, len(low) - 1))
    changed = np.concatenate(([0], np.cumsum(low != data)))
    capital = (low[letter] != data[letter]) & (changed[last + 1] - changed[begin] == 1) & (size > 1 + (head == 0xC3))
    named = np.where(capital & (typed == WORD), NAME, typed)
    joins[:1] = False
    before = np.concatenate(([False], spelled[:-1])) if len(starts) else spelled
    number_run = joins & spelled & before
    name_run = joins & (named == NAME) & (np.concatenate(([False], named[:-1] == NAME)) if len(starts) else joins)
    mark = _PUNCT[head]
    return [_form(SAME, value, plain, mark, np.zeros(len(starts), bool), at), _form(TYPED, value, typed, mark, number_run, at), _form(NAMED, value, named, mark, number_run | name_run, at)]


def _form(form: int, value: np.ndarray, kind: np.ndarray, mark: np.ndarray, merged: np.ndarray, at: np.ndarray) -> Form:
    if merged.any():
        first = np.flatnonzero(~merged)
        group = np.cumsum(~merged) - 1
        place = np.arange(len(value)) - first[group]
        value = np.add.reduceat(mix(value + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
        kind, mark, at = kind[first], mark[first], np.concatenate((group, [len(first)]))[at]
    else:
        value = mix(value)
    return Form(form, np.where(kind == WORD, value, _TYPE[kind]), value, kind, (kind == WORD) & ~mark, at)


_WINDOWS = pa.schema([("hash", pa.int64()), ("length", pa.int32()), ("item", pa.int64()), ("form", pa.int32()), ("q", pa.int32()), ("slots", pa.binary()), ("n", pa.int32()), ("least", pa.int32())])


def _item_windows(coverage: float):
    """Items (item, text) to their windows, each in all forms that say enough; n of them in a form, of which least
    must be found. Items of one or two words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                for f in forms(raw, np.array([0, len(raw)])):
                    length = min(WINDOW, len(f.template))
                    if length < 3:
                        continue
                    hashes = f.windows(length)
                    literal = np.concatenate(([0], np.cumsum(f.literal)))
                    enough = (literal[length:] - literal[:-length] >= LITERAL - (len(hashes) == 1)) | (f.form == SAME)
                    n = int(enough.sum())
                    least = max(min(math.ceil(coverage * n), RUN - length + 1), min(LEAST, len(hashes)))
                    rows += [(int(hashes[q].view(np.int64)), length, item, f.form, q, f.slots(q, length), n, least) for q in np.flatnonzero(enough).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 8, _WINDOWS, strict=True)], schema=_WINDOWS)

    return run


_HITS = pa.schema([("digest", pa.binary()), ("hash", pa.int64()), ("p", pa.int32()), ("slots", pa.binary())])


def _marked(bitmap: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return bitmap[(cell >> np.uint64(3)).astype(np.int64)] & _BIT[(cell & np.uint64(7)).astype(np.int64)]


def _find(bits, size: int, lengths: list[int]):
    """Documents (digest, text) to their windows whose hash is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bits.value
        for batch in batches:
            digests = batch.column(0)
            for first, last, data, offsets in chunks(batch.column(1)):
                row, hash_, place, slots = [], [], [], []
                for f in forms(data, offsets):
                    for length in lengths:
                        hashes = f.windows(length)
                        hit = np.flatnonzero(_marked(bitmap, hashes >> np.uint64(64 - size)))
                        hit = hit[_marked(bitmap, hashes[hit] & np.uint64((1 << size) - 1)) > 0]
                        r = np.searchsorted(f.at, hit, "right") - 1
                        inside = hit + length <= f.at[r + 1]
                        for p, i in zip(hit[inside].tolist(), r[inside].tolist(), strict=True):
                            row.append(first + i), hash_.append(int(hashes[p].view(np.int64)))
                            place.append(p - int(f.at[i])), slots.append(f.slots(p, length))
                yield pa.RecordBatch.from_arrays([digests.take(pa.array(row, pa.int64())), pa.array(hash_, pa.int64()), pa.array(place, pa.int32()), pa.array(slots, pa.binary())], schema=_HITS)

    return run


def _slots_agree(pairs: list[tuple[bytes, bytes]]) -> bool | None:
    """Whether the slots' values are the item's; None if they don't correspond one to one."""
    there, back, equal = {}, {}, True
    for a, b in pairs:
        for k in range(0, len(a), 8):
            x, y = a[k : k + 8], b[k : k + 8]
            if there.setdefault(x, y) != y or back.setdefault(y, x) != x:
                return None
            equal &= x == y
    return equal


_FOUND = pa.schema([("digest", pa.binary()), ("item", pa.int64()), ("n_windows", pa.int64()), ("item_windows", pa.int64()), ("verbatim", pa.bool_())])


def _judge():
    """Matches (digest, item, form, n, least, p, q, slots, item's slots), sorted by the first two, to what is found.

    In each form and alignment, with what DRIFT moves apart, the item's windows that are there are counted if their
    slots agree; where they don't, the alignment is tried alone."""

    def best(rows: list[tuple]) -> tuple[int, int, bool] | None:
        found = None
        by_form = defaultdict(lambda: defaultdict(list))
        total = {}
        for form, n, least, p, q, own, its in rows:
            by_form[form][p - q].append((q, its, own))
            total[form] = (n, least)
        for form, shifts in by_form.items():
            n, least = total[form]
            for shift in shifts:
                near = [m for d in range(-DRIFT, DRIFT + 1) for m in shifts.get(shift + d, ())]
                for matches in (near, shifts[shift]):
                    count = len({m[0] for m in matches})
                    if count < least:
                        break
                    equal = _slots_agree([m[1:] for m in matches])
                    if equal is not None:
                        if found is None or (equal, count / n) > (found[2], found[0] / found[1]):
                            found = (count, n, equal)
                        break
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def flush() -> None:
            if held and (x := best(held)) is not None:
                out.append((*key, *x))

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, _FOUND, strict=True)], schema=_FOUND)

        for batch in batches:
            for digest, item, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (digest, item) != key:
                    flush()
                    key, held = (digest, item), []
                held.append(tuple(rest))
            yield rows()
            out.clear()
        flush()
        yield rows()

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _bitmap(windows: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(a bitmap, the 2-logarithm of its size): the cells of each window's first and last bits are marked."""
    size = min(MOST_BITS, max(LEAST_BITS, int(BITS * n - 1).bit_length()))
    cells = F.array(F.shiftrightunsigned("hash", 64 - size), F.col("hash").bitwiseAND(F.lit((1 << size) - 1)))
    marked = windows.select(F.explode(cells).alias("cell")).select(F.shiftright("cell", 3).alias("byte"), F.expr("shiftleft(1, int(cell & 7))").alias("bit"))
    bitmap = np.zeros(1 << (size - 3), np.uint8)
    for r in marked.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # one row for each byte at most
        bitmap[r["byte"]] = r["bits"]
    return bitmap, size


def found_texts(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, coverage: float) -> DataFrame | None:
    """(digest, item_id, n_windows, item_windows, verbatim) of the texts that hold items, as a written table; None if
    the benchmark has no window. Items with equal texts are looked for once."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    items = written(items.withColumn("item", F.xxhash64("text", F.md5("text"))), "items")
    one = items.groupBy("item").agg(F.first("text").alias("text"))
    windows = written(one.mapInArrow(_item_windows(coverage), "hash long, length int, item long, form int, q int, slots binary, n int, least int"), "windows")
    some = windows.agg(F.count("*").alias("n"), F.collect_set("length").alias("lengths")).first()  # WINDOW - 2 lengths at most
    if not some["n"]:
        return None
    bitmap, size = _bitmap(windows, some["n"])
    texts = docs.where(F.col(text_col).isNotNull()).select(_digest(F.col(text_col)).alias("digest"), F.col(text_col).cast("string").alias("text"))
    hits = texts.mapInArrow(_find(spark.sparkContext.broadcast(bitmap), size, sorted(some["lengths"])), "digest binary, hash long, p int, slots binary")
    # Copies of a text have the same hits; they are dropped before the join.
    hits = written(hits.distinct(), "hits")
    matches = hits.withColumnRenamed("slots", "own").join(windows, "hash").where(F.length("own") == F.length("slots"))
    matches = matches.select("digest", "item", "form", "n", "least", "p", "q", "own", "slots")
    found = matches.repartition("digest", "item").sortWithinPartitions("digest", "item").mapInArrow(_judge(), "digest binary, item long, n_windows long, item_windows long, verbatim boolean")
    return written(found.join(items.select("item", "item_id").distinct(), "item").drop("item"), "found")


_DDL = "doc_id long, item_id long, n_windows long, item_windows long, verbatim boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, verbatim) for each benchmark item that a document holds.

    n_windows of the item's item_windows template windows are in one place of the document, in the form that fits
    best; verbatim: their numbers, names and units are the item's, else they were replaced consistently.

    * An item is found by a share of coverage of its windows, or by RUN words in a row.
    * Null and empty texts hold nothing. Items of fewer than 3 words can't be found. Items whose windows all hold
      too few literal words are found verbatim only.
    * Rows with a null id are reported with it. Repeated rows are reported each; so are repeated items, once for
      each id. With an empty table on either side there are no rows.
    * Very long texts are hashed in one piece; only their windows that may match leave the task.
    """
    found = found_texts(docs, benchmark, text_col, item_col, item_text, coverage)
    if found is None:
        return docs.sparkSession.createDataFrame([], _DDL)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), _digest(F.col(text_col)).alias("digest"))
    return rows.join(found, "digest").select("doc_id", "item_id", "n_windows", "item_windows", "verbatim")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows that hold a benchmark item, with all columns; rows without a text stay."""
    found = found_texts(docs, benchmark, text_col, item_col, item_text, coverage)
    if found is None:
        return docs
    held = found.select(F.col("digest").alias("__hs_digest")).distinct()
    return docs.join(held, _digest(F.col(text_col)) == F.col("__hs_digest"), "left_anti")
