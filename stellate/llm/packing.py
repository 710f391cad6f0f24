"""Packing token sequences by vector bin packing.

Every document's ids, with the end id after them, are cut into whole sequences and one
remainder. Remainders are items with three demands: tokens, one segment, and
loss-bearing tokens. Sequences are bins with a limit on each. The dot-product
heuristic fills one bin at a time: of a bounded pool of open items that fit it, the
one whose demands, as shares of the limits, have the greatest dot product with what
the bin has left goes in. When none fits, or when the bin may take only one more segment,
an item is cut so that the bin is filled. A partition's last tokens, which fill no whole
sequence, are cut at powers of two, where sequences need no padding.

Rows whose `loss_col` is false bear no loss, as prompts of instruction data do, nor do the
ids of `no_loss_ids`; so an example's demands are three numbers, not one.

Partitions are packed apart, so there is no shuffle and memory is bounded by the pool;
sequence ids hold the partition's number in their upper bits.

Defined cases: a null text counts as empty and yields the end id alone; repeated rows
are packed each on its own; an empty table gives no pieces. Every id lies in exactly
one piece, and in a sequence the pieces follow without gaps. The sequence length must
be a power of two, and a segment limit that binds leaves a sequence padded.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LAST_AGREED, NOT_SPACE, SPACE, WORD_PATTERN, ByteBpe, Irregular, read_tokenizer
from .common import held, map_batches, text_rows

#: Open items a partition holds at most; each is shorter than a sequence.
POOL = 512
#: Characters of a text that are encoded at once, to the end of their last word.
BLOCK = 1 << 16
#: The characters, as of a class, for which splits may differ between libraries: from LAST_AGREED on, without white space.
BEYOND = LAST_AGREED + r"-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\U0010ffff"

SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class Packer:
    """Packs items into sequences; hands out finished pieces.

    An item is [doc, ids, start, doc_tokens, bears]; `loss` gives the loss-bearing tokens of
    ids, where it is not all of them; an item that does not bear has none.
    """

    def __init__(self, first_sequence: int, tokens: int, segments: int, loss_tokens: int, loss=None, pool: int = POOL):
        if tokens & (tokens - 1) or min(segments, loss_tokens) < 1:
            raise ValueError("the sequence length must be a power of two and every limit positive")
        self.limits = np.array([tokens, segments, loss_tokens], float)
        self.tokens, self.sequence, self.loss, self.most = tokens, first_sequence, loss, pool
        self.items: list = []
        self.demands = np.zeros((pool, 3))
        self.out: list[tuple] = []

    def demand(self, ids: bytes, bears: bool) -> tuple[int, int, int]:
        n = len(ids) >> 2
        return n, 1, 0 if not bears else n if self.loss is None else self.loss(ids)

    def place(self, item, offset: int, length: int) -> None:
        """Writes the first `length` ids of an item into the open sequence and takes them off it."""
        doc, ids, start, total, _ = item
        self.out.append((doc, start, length, ids[: length * 4], total, self.sequence, offset))
        item[1], item[2] = ids[length * 4 :], start + length

    def close(self) -> None:
        self.sequence += 1

    def add(self, doc, ids: bytes, bears: bool = True) -> None:
        total, start = len(ids) >> 2, 0
        while total - start >= self.tokens:
            whole = ids[start * 4 : (start + self.tokens) * 4]
            n = self.fitting(whole, bears, self.tokens, self.limits[2])  # fewer if they would bear too much loss
            self.out.append((doc, start, n, whole[: n * 4], total, self.sequence, 0))
            self.close()
            start += n
        item = [doc, ids[start * 4 :], start, total, bears]
        if item[1]:
            if len(self.items) == self.most:
                self.fill()
            self.demands[len(self.items)] = self.demand(item[1], bears)
            self.items.append(item)

    def fitting(self, ids: bytes, bears: bool, tokens: int, loss: float) -> int:
        """The most leading ids that need no more than these tokens and loss-bearing tokens."""
        n = min(len(ids) >> 2, int(tokens))
        if not bears:
            return n
        if self.loss is None:
            return min(n, int(loss))
        low, high = 0, n
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.loss(ids[: mid * 4]) <= loss else (low, mid - 1)
        return low

    def take(self, at: int) -> list:
        last = len(self.items) - 1
        item, self.items[at], self.demands[at] = self.items[at], self.items[last], self.demands[last]
        self.items.pop()
        return item

    def fill(self) -> None:
        """Fills and closes one sequence from the pool."""
        left, offset = self.limits.copy(), 0
        while self.items and left[0] >= 1 and left[1] >= 1 and left[2] >= 1:
            demands = self.demands[: len(self.items)]
            score = (demands / self.limits) @ (left / self.limits)
            score[(demands > left).any(axis=1)] = -1.0
            if left[1] < 2:  # the last segment: only an item that fills the sequence may go in whole
                score[demands[:, 0] < left[0]] = -1.0
            at = int(score.argmax())
            if score[at] < 0:  # cut the item of which the most can go in
                room = demands[:, 0] * np.minimum(1.0, left[2] / np.maximum(demands[:, 2], 1e-9))
                at = int(np.minimum(room, left[0]).argmax())
                item = self.items[at]
                n = self.fitting(item[1], item[4], left[0], left[2])
                if not n:
                    break
                self.place(item, offset, n)
                self.demands[at] = self.demand(item[1], item[4]) if item[1] else 0
                if not item[1]:
                    self.take(at)
                offset, left = offset + n, left - [n, 1, 0]
                if item[4]:
                    left[2] -= self.demand(self.out[-1][3], True)[2]
                continue
            used, item = demands[at].copy(), self.take(at)
            self.place(item, offset, int(used[0]))
            offset, left = offset + int(used[0]), left - used
        self.close()

    def finish(self) -> None:
        """Packs what the pool holds. The last tokens go to sequences of a power of two."""
        while self.items and self.demands[: len(self.items), 0].sum() >= self.tokens:
            self.fill()
        room = self.tokens
        while self.items:
            most = np.sort(self.demands[: len(self.items), 0])[::-1]  # what the segments of one sequence can hold
            while room > most[: int(self.limits[1])].sum():
                room //= 2
            saved, self.limits = self.limits, np.array([room, self.limits[1], min(self.limits[2], room)], float)
            self.fill()
            self.limits = saved


class StretchBpe(ByteBpe):
    """An encoder that hands text to the tiktoken library in stretches of many words.

    Most words of a large table are seen too seldom for kept ids to save work, and a call for
    each of them costs more than its merges. Where a stretch has no run of white space before a
    word, the pattern needs no look ahead, and the library finds words and merges in one pass.
    """

    def __init__(self, tokenizer_json: str):
        super().__init__(tokenizer_json)
        self.blocks = re.compile(rf"[\s\S]{{1,{BLOCK}}}{SPACE}*{NOT_SPACE}*").findall
        self.runs = re.compile(rf"{SPACE}{{2,}}").finditer
        narrow = SPACE.replace("[", f"[^{BEYOND}")
        self.beyond = re.compile(f"[{BEYOND}]").search
        self.parts = re.compile(
            rf"((?:{SPACE}*+{narrow}++(?![{BEYOND}]))*+(?:{SPACE}++\Z)?)((?:{SPACE}*+{narrow}*+[{BEYOND}]{NOT_SPACE}*+)*+)"
        ).findall

    def _encode_plain(self, text: str) -> bytes:
        # Blocks end where a word does; they bound what one call makes.
        return b"".join(map(self._encode_block, self.blocks(text) if len(text) > BLOCK else [text]))

    def _encode_block(self, block: str) -> bytes:
        if block.isascii() or not self.beyond(block):
            return self._encode_agreed(block)
        # A boundary lies before every run of white space: only the words on which libraries may differ go apart.
        return b"".join(self._encode_agreed(agreed) + self._encode_apart(apart) for agreed, apart in self.parts(block))

    def _encode_apart(self, text: str) -> bytes:
        if text.startswith(" "):
            try:
                return b"".join(map(self.after_space.__getitem__, text[1:].split(" ")))
            except Irregular:
                pass
        return super()._encode_plain(text)

    def _encode_agreed(self, text: str) -> bytes:
        # Of a run of white space before a word, the last character goes with the word or is a piece of its own.
        cuts = [0, *(run.end() - 1 for run in self.runs(text) if run.end() < len(text)), len(text)]
        ids = self.merge_stretch(text) if len(cuts) == 2 else [i for a, b in zip(cuts, cuts[1:]) for i in self.merge_stretch(text[a:b])]
        return struct.pack(f"<{len(ids)}I", *ids)


def _encoder(tokenizer_json: str) -> ByteBpe:
    """The encoder, with merges by the tiktoken library where ids stand in the order of merges."""
    import tiktoken

    bpe = StretchBpe(tokenizer_json)
    ranks = {b: i for i, b in enumerate(bpe.bytes_of) if b and i not in bpe.special.values()}
    by_rank = [bpe.bytes_of[i] for i in bpe.merged]
    if sorted(bpe.merged) != bpe.merged or len(set(by_rank)) < len(by_rank):
        return ByteBpe(tokenizer_json)
    merges = lambda pattern: tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    bpe.merge_piece, bpe.merge_stretch = merges(r"[\s\S]+"), merges(rf"{WORD_PATTERN}|{SPACE}+")
    return bpe


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, tokens: int = 2048, segments: int = 8, loss_tokens: int = 2048,
    no_loss_ids: tuple[int, ...] = (), loss_col: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of `docs`: doc_id, start, length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset. A null in `loss_col` counts as true."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        bpe = held(("packing", shipped.value), lambda: _encoder(shipped.value))
        loss = (lambda ids: len(ids) // 4 - int(np.isin(np.frombuffer(ids, "<u4"), no_loss_ids).sum())) if no_loss_ids else None
        packer = Packer(TaskContext.get().partitionId() << 40, tokens, segments, loss_tokens, loss)
        for batch in batches:
            for doc, text, bears in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(doc, bpe.encode(text) + end, bears)
            if len(packer.out) >= 2000:
                yield rows(packer.out)
                packer.out.clear()
        packer.finish()
        yield rows(packer.out)

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types)], names=names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.binary() if n == "ids" else pa.int64() for n in names]
    bears = F.lit(True) if loss_col is None else F.coalesce(F.col(f"`{loss_col}`").cast("boolean"), F.lit(True))
    return map_batches(text_rows(docs, id_col, text_col, bears.alias("bears")), run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
