"""Byte-level BPE encoding and decoding.

Words are encoded one at a time with a contiguous rank array: a list of the ids of
the word's parts and, beside it, a list of the merge ranks of adjacent parts. The
least rank is found by scanning, the boundary there is deleted, and the ranks of the
two pairs that touch the new part are looked up anew. Long words, for which scanning
would cost a square, take the same merges in the same order from a heap.

Results equal those of the `tokenizers` library for the same JSON file with
``add_special_tokens=False`` (and for decoding ``skip_special_tokens=False``).

Defined cases: a null text counts as empty; an empty text has no ids and decodes to
the empty string; repeated rows are encoded each on its own; texts are never cut; ids
that form no valid UTF-8 decode to replacement characters.
"""

from __future__ import annotations

import heapq
import json
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .common import Kept, held, map_batches, text_rows

#: Fixed value: the pattern by which the public byte-level vocabulary splits texts.
#: White space is spelled out, since libraries differ on the control characters.
SPACE = r"[\t-\r \x85\xa0  -     　]"
NOT_SPACE = SPACE.replace("[", "[^")
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?{SPACE.replace('[', r'[^').replace(']', r'\p{L}\p{N}]')}+"
)
PATTERN = WORD_PATTERN + rf"|{SPACE}+(?!{NOT_SPACE})|{SPACE}+"
#: Words of more bytes than this are merged with a heap.
SHORT_WORD = 96
#: Bytes of words, and of pieces of words, kept with their ids in each worker; beyond this it starts anew.
WORD_BYTES, PIECE_BYTES = 64 << 20, 8 << 20

#: Below this character the split by the pattern is known to agree with the tokenizer's.
LAST_AGREED = "\u0530"

NONE = 1 << 60
PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, by its rule:
    printable Latin-1 stands for itself, the others for 256, 257 and so on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(rest)}


class Irregular(Exception):
    """A text's spaces need the slower split."""


class Words(Kept):
    """The ids, as little-endian bytes, of words that follow a single space."""

    def __init__(self, tokenizer: ByteBpe, before: str):
        super().__init__(WORD_BYTES)
        self.tokenizer, self.before = tokenizer, before

    def __missing__(self, word: str) -> bytes:
        if not word or self.tokenizer.starts_with_space(word):
            raise Irregular
        piece = self.before + word
        # Letters alone are one piece, which need not be kept a second time.
        ids = self.tokenizer.merged_bytes(piece) if word.isalpha() and (word.isascii() or max(word) < LAST_AGREED) else self.tokenizer.encode_chunk(piece)
        return self.keep(word, ids, len(word) + len(ids)) if len(word) <= SHORT_WORD else ids


class Pieces(Kept):
    """The ids, as little-endian bytes, of the pieces that the pattern finds."""

    def __init__(self, tokenizer: ByteBpe):
        super().__init__(PIECE_BYTES)
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> bytes:
        packed = self.tokenizer.merged_bytes(piece)
        return self.keep(piece, packed, len(piece) + len(packed)) if len(piece) <= SHORT_WORD else packed


class ByteBpe:
    """Encoder and decoder for a byte-level BPE file of the `tokenizers` library."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, letters = spec["model"], _byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        vocab = model["vocab"]
        self.byte_id = [0] * 256
        for letter, byte in letters.items():
            self.byte_id[byte] = vocab[letter]
        self.merged, self.rank = [], {}
        for rank, (left, right) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self.rank[vocab[left] << 20 | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.latin_pieces = regex.compile(PATTERN).findall
        self.library_pieces = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.piece_ids, self.merge_piece = Pieces(self), lambda piece: self.merge(piece.encode())
        self.chunks = regex.compile(rf"{SPACE}*{NOT_SPACE}+|{SPACE}+").findall
        self.starts_with_space = regex.compile(SPACE).match
        self.after_space, self.whole = Words(self, " "), Words(self, "")

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: least rank first, leftmost among equals."""
        ids, rank = [self.byte_id[b] for b in word], self.rank.get
        if len(ids) > SHORT_WORD:
            return self._merge_long(ids)
        ranks = [rank(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NONE:
            at = ranks.index(least)
            ids[at] = self.merged[least]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(ids[at] << 20 | ids[at + 1], NONE)
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 20 | ids[at], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank.get
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = self.merged[r], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((i, after[i]), (before[i], i)):
                if a >= 0 and b < n and (r := rank(ids[a] << 20 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x, kept in zip(ids, alive) if kept]

    def merged_bytes(self, piece: str) -> bytes:
        """The ids of a piece as little-endian bytes."""
        ids = self.merge_piece(piece)
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def pieces(self, chunk: str) -> list[str]:
        """The words of a chunk. Beyond Latin and Greek and Cyrillic letters, libraries' tables
        of letters differ with their Unicode versions; there the tokenizer's own split is asked."""
        if max(chunk) < LAST_AGREED:
            return self.latin_pieces(chunk)
        return [chunk[start:end] for _, (start, end) in self.library_pieces(chunk)]

    def encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.piece_ids.__getitem__, self.pieces(chunk)))

    def _encode_plain(self, text: str) -> bytes:
        # A boundary lies before every single space between words.
        first, _, rest = text.partition(" ")
        if first and rest:
            try:
                return self._lookup(first) + b"".join(map(self.after_space.__getitem__, rest.split(" ")))
            except Irregular:
                pass
        # In any text, one lies before every run of white space.
        return b"".join(map(self._lookup, self.chunks(text)))

    def _lookup(self, chunk: str) -> bytes:
        try:
            return self.whole[chunk]
        except Irregular:
            return self.encode_chunk(chunk)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.special and any(token in text for token in self.special):
            return b"".join(
                np.array([self.special[part]], "<u4").tobytes() if n % 2 else self._encode_plain(part)
                for n, part in enumerate(self.split_special(text))
                if part
            )
        return self._encode_plain(text)

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def byte_bpe(tokenizer_json: str) -> ByteBpe:
    """The encoder of a worker, which keeps its words from task to task."""
    return held(("bpe", tokenizer_json), lambda: ByteBpe(tokenizer_json))


def read_tokenizer(path: str) -> str:
    """A tokenizer file's text; the driver reads it and ships it, so executors need no such file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (binary: little-endian unsigned 32-bit integers) of whole texts.

    With `decoded`, also the text that the ids decode to. One row per row of `docs`;
    no shuffle; the only state is a worker's bounded cache of words.
    """
    rows = text_rows(docs, id_col, text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches):
        bpe = byte_bpe(shipped.value)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            out = [batch.column(0), pa.array([len(x) >> 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                out.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]
    return map_batches(rows, run, "doc_id bigint, n_tokens bigint, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded text of rows that hold ids as `encode` writes them; null ids decode to ''."""
    rows = encoded.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{ids_col}`"), F.lit(b"")).alias("ids"))
    shipped = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches):
        bpe = byte_bpe(shipped.value)
        for batch in batches:
            texts = [bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return map_batches(rows, run, "doc_id bigint, decoded string")


def ids_array(ids):
    """A column of ids as an array of integers, from the binary form."""
    digits, n = F.hex(ids), (F.octet_length(ids) / 4).cast("int")
    pair = lambda i, k: F.substring(digits, i * 8 + (2 * k + 1), F.lit(2))
    number = lambda i: F.conv(F.concat(*(pair(i, k) for k in (3, 2, 1, 0))), 16, 10).cast("bigint")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).otherwise(F.array().cast("array<bigint>"))
