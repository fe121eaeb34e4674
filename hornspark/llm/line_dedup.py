"""Line dedup (operator 10), DataFrame functions only.

Lines are exploded in normalised form, hashed (MD5, 128 bits, so that 10^13 lines don't collide), documents
are counted per hash, and a hash over the threshold loses its lines everywhere but in its smallest document.
What moves: one 40-byte row per long line to count and find them, then the positions to drop and the texts,
once, by document. A line that a third of all rows hold is counted by partial aggregates, and in the join back
each key has one row on the other side, so that a skewed partition can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WS, lower_ascii, written


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
    n_lines_col: str | None = None,
    n_dropped_col: str | None = None,
    drop_emptied: bool = False,
) -> DataFrame:
    """All rows and columns of docs, text without repeated lines, plus the two counts where they are named.

    * A key shorter than min_chars code points never counts. A key in at least min_docs distinct ids stays in
      the smallest id only, there with all its lines.
    * Null and empty texts are one empty line and come out as "". A text that loses every line becomes "". With
      drop_emptied, rows go that had a word and have none left; those that had none stay.
    * Rows with a null id keep all lines and count as no document.
    * Rows with the same id are one document for counting; each row is reassembled on its own.
    * Other columns pass through, whatever their names.
    """
    # Lower-casing keeps line ends, so it's done once for the text.
    lines = F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), "\n", -1)
    narrow = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t"), lines.alias("l")).where("i IS NOT NULL")
    keys = narrow.select("i", "t", F.posexplode("l").alias("p", "line")).select("i", "t", "p", F.btrim("line", F.lit(WS)).alias("k"))
    keyed = keys.where(F.length("k") >= min_chars).select("i", "t", "p", F.unhex(F.md5("k")).alias("h"))

    if min_docs <= 2:
        counted = keyed.groupBy("h").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).where("lo < hi" if min_docs == 2 else "true")
    else:
        counted = keyed.select("h", "i").distinct().groupBy("h").agg(F.min("i").alias("lo"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    # A table of its own, so that both sides of the join are exchanges and a skewed one can be split.
    drops = (
        keyed.join(written(counted.select("h", "lo"), "repeated-lines"), "h")
        .where("i > lo")
        .groupBy(F.col("i").alias("__hs_i"), F.col("t").alias("__hs_t"))
        .agg(F.collect_set("p").alias("__hs_p"))
    )
    found = docs.join(drops, (docs[id_col] == F.col("__hs_i")) & (F.xxhash64(docs[text_col]) == F.col("__hs_t")), "left")
    found = found.withColumn("__hs_l", F.split(F.coalesce(docs[text_col], F.lit("")), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__hs_l") - 1), F.col("__hs_p"))
    text = F.when(F.col("__hs_p").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("__hs_l"), i)), "\n")
    )
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if n_lines_col:
        out.append(F.size("__hs_l").cast("long").alias(n_lines_col))
    if n_dropped_col:
        out.append(F.coalesce(F.size("__hs_p"), F.lit(0)).cast("long").alias(n_dropped_col))
    if drop_emptied:
        blank = lambda c: F.btrim(c, F.lit(WS)) == ""
        found = found.where(F.col("__hs_p").isNull() | ~blank(text) | blank(F.col(text_col)))
    return found.select(out)
