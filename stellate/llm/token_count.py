"""Token counts under a unigram vocabulary, without making the tokens.

A Viterbi pass per word: an Aho-Corasick automaton enumerates the pieces that end at
each character, and dynamic programming carries the best score and the number of
pieces that reach it. Ties follow the tokenizer's rule: candidates for an end come by
ascending start, and a later one must score strictly higher to win, so of equal
scores the one whose last piece is longest stays. A character that no piece covers
costs the least score of the vocabulary less ten, and counts as its UTF-8 bytes where
the vocabulary has byte pieces, else a run of such characters as one piece.

A text is read as the tokenizer does: spaces become U+2581 and one more is put in
front. Pieces hold that mark at their start only, so words are counted alone and the
counts of frequent ones are kept. That equals one pass over the whole text as long
as sums of scores are exact, which holds for the public vocabularies' whole numbers.

Defined cases: null or empty text has 0 tokens; repeated rows count each on its own;
texts are never cut.
"""

from __future__ import annotations

import re
from collections import namedtuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Kept, held, map_batches, text_rows

#: pieces: (text, score) of ordinary pieces; byte_pieces: whether uncovered characters count by bytes.
Vocabulary = namedtuple("Vocabulary", "pieces byte_pieces")

MARK = "▁"
#: Fixed value: what the tokenizer takes off the least score for an uncovered character.
UNKNOWN_PENALTY = 10.0
#: Bytes of words kept with their counts in each worker.
WORD_BYTES = 96 << 20
SHORT_WORD = 64


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces and scores of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary([(model.id_to_piece(i), model.get_score(i)) for i in plain], any(model.is_byte(i) for i in ids))


class Counter(Kept):
    """Counts of words, kept for short ones."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        super().__init__(WORD_BYTES)
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} holds the space mark after other characters")
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary.pieces) - UNKNOWN_PENALTY
        self.covered = {piece for piece, _ in vocabulary.pieces if len(piece) == 1}
        self.by_bytes = vocabulary.byte_pieces
        self.words = re.compile(f"{MARK}+[^{MARK}]*").findall

    def __missing__(self, word: str) -> int:
        count = self.viterbi(MARK + word)
        return self.keep(word, count, len(word)) if len(word) <= SHORT_WORD else count

    def viterbi(self, text: str) -> int:
        if not self.covered.issuperset(text):
            return self.viterbi_with_gaps(text)
        # The automaton gives matches by ascending end, and longest first among those of
        # one end: by ascending start.
        best, count = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
        for end, (length, score) in self.automaton.iter(text):
            start = end + 1 - length
            if (sum_ := best[start] + score) > best[end + 1]:
                best[end + 1], count[end + 1] = sum_, count[start] + 1
        return count[-1]

    def viterbi_with_gaps(self, text: str) -> int:
        n, least = len(text), float("-inf")
        best, count = [0.0] + [least] * n, [0] * (n + 1)
        #: Whether the best path to here ends in an uncovered character.
        open_run = [False] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        single = [False] * n
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
            single[end] |= match[0] == 1
        for end in range(n):
            to = end + 1
            for length, score in ends[end]:
                start = to - length
                if (sum_ := best[start] + score) > best[to]:
                    best[to], count[to], open_run[to] = sum_, count[start] + 1, False
            if not single[end] and (sum_ := best[end] + self.unknown) > best[to]:
                more = len(text[end].encode("utf-8", "surrogatepass")) if self.by_bytes else int(not open_run[end])
                best[to], count[to], open_run[to] = sum_, count[end] + more, True
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        words = text.split(" ")
        # Where spaces run together, a run belongs to the word after it.
        if "" in words:
            return sum(self[word[1:]] if word[1:2] != MARK else self.viterbi(word) for word in self.words(MARK + text.replace(" ", MARK)))
        return sum(map(self.__getitem__, words))


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and n_chars (code points) of whole texts; one row per row of `docs`, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter = held(("counts", shipped.value), lambda: Counter(shipped.value))  # keeps its words from task to task
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, chars = [counter.count(t) for t in texts], [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(chars, pa.int64())], names=["doc_id", "n_tokens", "n_chars"])

    return map_batches(text_rows(docs, id_col, text_col), run, "doc_id bigint, n_tokens bigint, n_chars bigint")
