"""Packing of token sequences by vector bin packing, within the partitions as they are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.tokens import WordEncoder, slices

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("loss_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


class _Pool:
    """Pieces that wait for a sequence, as parallel arrays; at most ``size``."""

    def __init__(self, size: int):
        self.tokens = np.zeros(size)
        self.loss = np.zeros(size)
        self.masked = np.zeros(size)
        self.items: list = [None] * size
        self.free = list(range(size))[::-1]

    def __len__(self) -> int:
        return len(self.items) - len(self.free)

    def put(self, item: tuple) -> None:
        k = self.free.pop()
        self.items[k] = item
        self.tokens[k], self.loss[k], self.masked[k] = item[2], item[5], item[6]

    def take(self, k: int) -> tuple:
        item = self.items[k]
        self.items[k], self.tokens[k], self.loss[k], self.masked[k] = None, 0.0, 0.0, 0.0
        self.free.append(k)
        return item


class Packer:
    """Fills sequences one after another under limits on tokens, segments and loss-bearing tokens.

    An item is (doc_id, start, length, ids, doc_tokens, loss, masked): its first ``masked`` ids bear
    no loss. Of the waiting items that fit all three limits, the one goes in whose demand vector has the largest dot
    product with what the sequence has left, both as shares of the limits. When none fits whole and
    tokens are left, the waiting item whose head fills most of the gap within the limits is cut there.
    Items over a limit are cut before they wait: a head of ``max_tokens`` ids within the loss limit is a sequence of its own; a
    head that reaches the loss limit first waits for others without loss, and a masked stretch is cut so that a
    sequence that holds it has room for ``max_loss`` ids of loss beside it. What is left at the end is cut into sequences of powers of two,
    which need no padding.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, waiting: int, base: int):
        if min(max_tokens, max_segments, max_loss, waiting) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=float)
        self.pool, self.sequence = _Pool(waiting), base
        self.out: list[tuple] = []

    def add(self, item: tuple) -> None:
        """Take in one document: what is over a limit is cut off its front, the rest waits."""
        tokens, loss = int(self.limits[0]), int(self.limits[2])
        while item[2] > tokens or item[5] > loss:
            masked = item[6]
            n = (tokens - loss if loss < tokens else tokens) if masked >= tokens else min(tokens, masked + loss)
            head, item = _cut(item, n)
            if n == tokens:
                self._emit([head])
            else:
                self._wait(head)
        self._wait(item)

    def _wait(self, item: tuple) -> None:
        while not self.pool.free:
            self._fill()
        self.pool.put(item)

    def finish(self) -> None:
        full = self.limits[0]
        while len(self.pool) and self.pool.tokens.sum() >= full:
            self._fill()
        while len(self.pool):
            self._fill(last=True)

    def _fill(self, last: bool = False) -> None:
        pool, left, row = self.pool, self.limits.copy(), []
        while left[0] > 0 and left[1] > 0:
            fits = (pool.tokens > 0) & (pool.tokens <= left[0]) & (pool.loss <= left[2])
            share = left / self.limits**2
            k = int(np.argmax(np.where(fits, pool.tokens * share[0] + share[1] + pool.loss * share[2], -1.0)))
            if not fits[k]:
                heads = np.minimum(np.minimum(left[0], pool.masked + left[2]), pool.tokens - 1)
                k = int(np.argmax(heads))
                n = int(heads[k])
                if n <= 0:
                    break
                head, rest = _cut(pool.take(k), n)
                pool.put(rest)
                row.append(head)
                left -= (head[2], 1, head[5])
                continue
            item = pool.take(k)
            row.append(item)
            left -= (item[2], 1, item[5])
        if last and left[0] > 0:
            self._powers(row)
        else:
            self._emit(row)

    def _powers(self, row: list[tuple]) -> None:
        total = sum(x[2] for x in row)
        for bit in range(total.bit_length() - 1, -1, -1):
            size, part = 1 << bit, []
            if not total & size:
                continue
            while size:
                item = row.pop(0)
                if item[2] > size:
                    item, rest = _cut(item, size)
                    row.insert(0, rest)
                part.append(item)
                size -= item[2]
            self._emit(part)

    def _emit(self, row: list[tuple]) -> None:
        offset = 0
        for doc_id, start, length, ids, doc_tokens, loss, _ in row:
            self.out.append((doc_id, start, length, ids, doc_tokens, loss, self.sequence, offset))
            offset += length
        self.sequence += 1


def _cut(item: tuple, n: int) -> tuple[tuple, tuple]:
    doc_id, start, length, ids, doc_tokens, loss, masked = item
    rest = max(0, masked - n)
    in_head = n - min(masked, n)
    head = (doc_id, start, n, ids[: 4 * n], doc_tokens, in_head, masked - rest)
    return head, (doc_id, start + n, length - n, ids[4 * n :], doc_tokens, loss - in_head, rest)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    max_tokens: int = 2048,
    max_segments: int = 256,
    max_loss: int = 2048,
    waiting: int = 256,
    masked: str | None = None,
) -> DataFrame:
    """Pieces of all documents placed into sequences.

    A document is the ids of its whole text (null: empty) and ``end_id``. ``masked`` names a column with
    how many of its first ids bear no loss (null or none: all bear loss). Columns: doc_id, start, length, ids (unsigned
    32-bit little-endian), doc_tokens, loss_tokens, sequence_id, offset. No sequence exceeds a limit,
    and each id lies in one piece.

    Every partition is packed as it is read, in its order, without a shuffle: a task holds
    ``waiting`` pieces of at most ``max_tokens`` ids besides the document at hand, and a repeated task gives the same
    sequences. Sequence ids are unique: partition number times 2**33, plus a count. Padding is needed only
    where ``max_segments`` very short documents, or loss limits, close a sequence; the last one of a partition is cut into powers of two.
    Limits under 1 raise. An empty table gives no rows; a null or repeated doc_id is carried through; other columns are left out.
    """
    mask = F.lit(0) if masked is None else F.greatest(F.lit(0), F.coalesce(F.col(masked), F.lit(0)))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), mask.cast("long").alias("masked"))
    names = PIECES.names

    def run(batches):
        encoder = WordEncoder.of(tokenizer_path)
        packer = Packer(max_tokens, max_segments, max_loss, waiting, TaskContext.get().partitionId() << 33)
        end = int(end_id).to_bytes(4, "little")
        for batch in slices(batches):
            rows = batch.to_pydict()
            for doc_id, ids, m in zip(rows["doc_id"], encoder.encode(rows["text"]), rows["masked"], strict=True):
                ids += end
                n = len(ids) // 4
                m = min(m, n)
                packer.add((doc_id, 0, n, ids, n, n - m, m))
            if packer.out:
                yield _batch(packer, names)
        packer.finish()
        if packer.out:
            yield _batch(packer, names)

    return source.mapInArrow(run, PIECES)


def _batch(packer: Packer, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*packer.out, strict=True))
    packer.out = []
    kinds = {"ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names=names)
