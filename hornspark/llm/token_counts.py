"""Token counts (operator 3): count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton gives all pieces that end at each character, the longest first. The best path to a
character carries its score and its number of pieces, no back pointers, and only as many characters back as the
longest piece has. Ties are the tokenizer's: of equal scores the path with the longer last piece stays; unknown
characters are as many pieces as they have bytes. Short words are counted once and kept.

The public vocabulary files hold merge ranks, no probabilities. The log probability of a piece is that of its rank
by Zipf's law, ``1 / (rank + ZIPF)``, normalised over the pieces: nothing is trained, and a path of few frequent
pieces is the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words kept with their counts by one Python worker, and the longest that are kept: some 40 MB at most.
KEPT_WORDS, KEPT_LENGTH = 150_000, 32
MARK = "▁"
#: What is added to a rank in Zipf's law, as Mandelbrot has it.
ZIPF = 2.7
#: The score of control and byte pieces, which no text is to match.
NEVER = -10_000.0
#: Fixed value: how far the score of an unknown character is below the lowest of the vocabulary.
UNKNOWN_BELOW = 10.0


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(pieces with log probabilities, id of the unknown piece) of a sentencepiece model file, whose scores are
    merge ranks below 0. The unknown piece, control pieces and bytes have the score NEVER."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(model.get_piece_size())]
    weight = [0.0 if s else 1 / (1 - model.get_score(i) + ZIPF) for i, s in enumerate(special)]
    total = sum(weight)
    return [(model.id_to_piece(i), math.log(w / total) if w else NEVER) for i, w in enumerate(weight)], model.unk_id()


class Counter(dict):
    """Numbers of pieces of words, by the rules of a unigram tokenizer with byte fallback that marks spaces and
    splits before them."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int) -> None:
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_BELOW
        self.back = max(len(p) for p, _ in pieces) + 1

    def __missing__(self, word: str) -> int:
        n = self.pieces(MARK + word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n

    def pieces(self, text: str) -> int:
        """The number of pieces of the best path over text."""
        size = self.back
        score, count = [0.0] * size, [0] * size  # by character, modulo size
        matches = self.automaton.iter(text)
        end, piece = next(matches, (-1, None))
        for e in range(len(text)):
            best, number, single = None, 0, False
            while end == e:  # the longest first
                length, own, unknown = piece
                at = (e + 1 - length) % size
                s = own + score[at]
                single |= length == 1
                if best is None or s > best:
                    best, number = s, count[at] + (len(text[e + 1 - length : e + 1].encode()) if unknown else 1)
                end, piece = next(matches, (-1, None))
            if not single:
                at = e % size
                s = self.unknown_score + score[at]
                if best is None or s > best:
                    best, number = s, count[at] + len(text[e].encode("utf-8", "surrogatepass"))
            score[(e + 1) % size], count[(e + 1) % size] = best, number
        return count[len(text) % size]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        words = text[1:].split(" ") if text[0] == " " else text.split(" ")
        return sum(map(self.__getitem__, words))


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row of docs, whole texts.

    model: path, on every machine, of a sentencepiece file whose pieces and ranks are the unigram vocabulary.

    * Null and empty texts have 0 tokens; null ids stay null. Repeated rows are counted each; an empty table has none.
    * Spaces are marked and words begin with their mark, as if a space stood before the text; characters that no
      piece has, other white space among them, count a token for each byte. The text of a control piece or a byte
      piece is ordinary text.
    * Time grows with the text's length, memory doesn't: a text without spaces is one word, which isn't kept.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*vocabulary(model))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([counter.count(t.as_py() or "") for t in batch.column(1)], pa.int64())], schema=_COUNTS)

    return rows.mapInArrow(run, "doc_id long, n_tokens long")
