"""Packing (operator 9): concatenate and cut.

Pass 1 tokenises each partition, numbers its tokens from 0 and writes ids and running counts to the shared
folder; the totals of the partitions, one number each, are summed on the driver. Pass 2 adds each partition's
global offset and cuts every document at multiples of the sequence length. Nothing is shuffled, and a document
is cut by its own row alone, so neither long documents nor hot keys gather anywhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh_path

#: Fixed value: the split pattern of the byte-level BPE vocabularies.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept with their ids by one Python worker, and the longest that are kept: some 40 MB at most.
KEPT_WORDS, KEPT_LENGTH = 200_000, 32
#: Bytes of ids in one Arrow batch.
BATCH_BYTES = 16_000_000


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies spell bytes: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Ids of a byte-level BPE file, equal to those of the tokenizers library without special tokens added: the
    file's added tokens are cut out of a text wherever they stand in it, what is between them is encoded alone.

    The split pattern never joins what is before a single space between two non-space characters to what is
    after it, so texts are cut there and the ids of each word, with its space, are kept."""

    ODD = re.compile(r" \s|\s ")

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = model["added_tokens"]
        if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
            raise ValueError(f"added tokens that take more than their own text aren't supported: {odd}")
        spelled, special = byte_alphabet(), {t["content"]: t["id"] for t in added}
        ranks = {bytes(spelled[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.kind = np.dtype("<u2" if max([*ranks.values(), *special.values()]) < 65536 else "<u4")
        self.special = {t: np.array([i], self.kind).tobytes() for t, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.bpe = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        ids = self.plain(" " + word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if self.cut is not None and len(parts := self.cut.split(text)) > 1:
            return b"".join(self.special[p] if k % 2 else self.words(p) for k, p in enumerate(parts))
        return self.words(text)

    def words(self, text: str) -> bytes:
        if text.startswith(" ") or text.endswith(" ") or self.ODD.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))


def _tokenise(path: str, eos: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pid, at = WordEncoder(path), TaskContext.get().partitionId(), 0
        end = np.array([eos], encoder.kind).tobytes()
        for batch in batches:
            ids, where, first, size = [], [], 0, 0
            texts = batch.column(1)
            for k in range(len(texts)):
                ids.append(encoder.encode(texts[k].as_py() or "") + end)
                where.append(at)
                at += len(ids[-1]) // encoder.kind.itemsize
                size += len(ids[-1])
                if size >= BATCH_BYTES or k + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(ids)), pa.array([pid] * len(ids), pa.int32()), pa.array(where, pa.int64()),
                         pa.array([encoder.kind.itemsize] * len(ids), pa.int32()), pa.array(ids, pa.binary())],
                        ["doc_id", "pid", "at", "width", "ids"],
                    )
                    ids, where, first, size = [], [], k + 1, 0

    return run


def _cut(offsets: dict[int, int], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            size = 0
            keys, pids, ats, widths, texts = batch.columns
            for k in range(len(keys)):
                raw = np.frombuffer(texts[k].as_buffer(), f"<u{widths[k].as_py()}").astype("<u4")
                doc, g, n, start = keys[k].as_py(), offsets[pids[k].as_py()] + ats[k].as_py(), len(raw), 0
                while start < n:
                    here = (g + start) % length
                    stop = min(n, start + length - here)
                    for col, v in zip(cols, (doc, start, stop - start, raw[start:stop].tobytes(), n, (g + start) // length, here), strict=True):
                        col.append(v)
                    size += 4 * (stop - start)
                    start = stop
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
                        cols, size = [[] for _ in names], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, eos: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all rows of docs; ids is binary,
    little-endian unsigned 32-bit.

    tokenizer: path of a byte-level BPE file in the tokenizers library's format, on every machine. The text of an
    added token, such as an end-of-text mark, gives its id, as in the library. Each row's ids are followed by eos. Sequences are full but for the very last one, which is shorter; padding it to
    length, or leaving it where its size is a power of two, is up to the reader and takes no piece.

    * Null and empty texts are the eos alone; null ids stay null.
    * Repeated rows are packed once each; an empty table has no pieces.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.mapInArrow(_tokenise(tokenizer, eos), "doc_id long, pid int, at long, width int, ids binary").write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema("doc_id long, pid int, at long, width int, ids binary").parquet(path)
    totals = tokens.groupBy("pid").agg(F.max(F.col("at") + F.length("ids") / F.col("width")).cast("long").alias("n")).collect()  # one number per partition
    offsets, total = {}, 0
    for r in sorted(totals):
        offsets[r["pid"]] = total
        total += r["n"]
    return tokens.mapInArrow(_cut(offsets, length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
