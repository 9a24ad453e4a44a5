"""Token ids in files: a static range asymmetric numeral system over independent interleaved blocks.

A file set is a Parquet folder of containers. A container holds up to ``segment`` ids in document order, one
shared frequency table, the documents it covers, and blocks. Each block interleaves ``lanes``
states, starts from its own states, and has a checksum of its ids and checkpoints in
its middle, so that blocks, and parts of blocks, decode independently of one another.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.tokens import WordEncoder, arrow_schema, slices

#: States stay in [2**31, 2**63); they shed and take 32 bits at a time.
LOW, WORD = np.uint64(1 << 31), np.uint64(32)
PRECISION = 18
LANES, BLOCK, SPAN = 32, 16384, 256

CONTAINER = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("container", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_ids_in", T.ArrayType(T.LongType())),
        T.StructField("doc_starts", T.ArrayType(T.LongType())),
        T.StructField("doc_sizes", T.ArrayType(T.LongType())),
        T.StructField("doc_whole", T.ArrayType(T.BooleanType())),
        T.StructField("cut", T.BooleanType()),
        T.StructField("symbols", T.BinaryType()),
        T.StructField("frequencies", T.BinaryType()),
        T.StructField("words", T.BinaryType()),
        T.StructField("states", T.BinaryType()),
        T.StructField("offsets", T.BinaryType()),
        T.StructField("checksums", T.ArrayType(T.LongType())),
        T.StructField("steps", T.LongType()),
    ]
)


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): the distinct ids, and shares of 2**PRECISION, at least 1 each, that sum to it."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << PRECISION
    if len(symbols) > total // 2:
        raise ValueError("more distinct ids than the table can hold")
    f = np.maximum(1, counts * (total - len(symbols)) // len(ids))
    f[int(np.argmax(f))] += total - int(f.sum())
    return symbols.astype(np.uint32), f.astype(np.uint32)


def encode_blocks(ids: np.ndarray, symbols: np.ndarray, frequencies: np.ndarray) -> tuple:
    """(words, states, offsets, checksums, steps) of all blocks of a container.

    Ids go to lanes in turn, and all lanes of all blocks advance together, last ids first. Each block
    is filled up with the commonest symbol. ``states`` has the lanes' states in front of every SPAN steps,
    ``offsets`` the place in ``words`` to read from there.
    """
    n_blocks = -(-len(ids) // BLOCK)
    steps = -(-len(ids) // (n_blocks * LANES))
    per_block = steps * LANES
    fill = symbols[int(np.argmax(frequencies))]
    padded = np.full(n_blocks * per_block, fill, dtype=np.uint32)
    padded[: len(ids)] = ids
    ranks = np.zeros(int(symbols[-1]) + 1, dtype=np.int32)
    ranks[symbols] = np.arange(len(symbols))
    rank = ranks[padded].reshape(n_blocks, steps, LANES)
    freq = frequencies.astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    shift, bound = np.uint64(PRECISION), np.uint64(1 << (63 - PRECISION))
    x = np.full((n_blocks, LANES), LOW, dtype=np.uint64)
    shed = np.zeros((steps, n_blocks, LANES), dtype=np.uint32)
    full = np.zeros((steps, n_blocks, LANES), dtype=bool)
    marks = []
    for s in range(steps - 1, -1, -1):
        r = rank[:, s]
        f = freq[r]
        over = x >= bound * f
        shed[s], full[s] = x & np.uint64(0xFFFFFFFF), over
        x = np.where(over, x >> WORD, x)
        q = x // f
        x = (q << shift) + (x - q * f) + start[r]
        if s % SPAN == 0:
            marks.append(x)
    states = np.stack(marks[::-1], axis=1)
    by_block, where = full.transpose(1, 0, 2), shed.transpose(1, 0, 2)
    words = where[by_block]
    size = by_block.sum(axis=2)
    before = np.concatenate([[0], np.cumsum(size.ravel())[:-1]]).reshape(size.shape)
    offsets = before[:, ::SPAN].astype(np.uint64)
    checks = [zlib.crc32(padded[b * per_block : min(len(ids), (b + 1) * per_block)].tobytes()) for b in range(n_blocks)]
    return words.tobytes(), states.tobytes(), offsets.tobytes(), checks, steps


def decode_blocks(n_ids: int, symbols: np.ndarray, frequencies: np.ndarray, words: np.ndarray, states: np.ndarray, offsets: np.ndarray, checksums: list[int], steps: int) -> np.ndarray:
    """The ids; every checkpoint of every block is decoded side by side, then the checksums are compared."""
    n_blocks = len(checksums)
    spans = -(-steps // SPAN)
    x = states.reshape(n_blocks * spans, LANES).copy()
    at = offsets.astype(np.int64).reshape(n_blocks * spans).copy()
    freq = frequencies.astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slot_rank = np.repeat(np.arange(len(symbols)), frequencies)
    words = np.concatenate([words, np.zeros(LANES, dtype=words.dtype)]).astype(np.uint64)
    mask, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    out = np.zeros((n_blocks * spans, SPAN, LANES), dtype=np.uint32)
    for s in range(min(SPAN, steps)):
        slot = x & mask
        r = slot_rank[slot]
        out[:, s] = symbols[r]
        x = freq[r] * (x >> shift) + slot - start[r]
        need = x < LOW
        place = at[:, None] + np.cumsum(need, axis=1) - 1
        x = np.where(need, (x << WORD) | words[np.minimum(np.maximum(place, 0), len(words) - 1)], x)
        at += need.sum(axis=1)
    ids = out.reshape(n_blocks, spans * SPAN, LANES)[:, :steps].reshape(-1)
    per_block = steps * LANES
    for b, want in enumerate(checksums):
        if zlib.crc32(np.ascontiguousarray(ids[b * per_block : min(n_ids, (b + 1) * per_block)]).tobytes()) != want:
            raise ValueError(f"block {b}: the checksum differs")
    return ids[:n_ids]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, segment: int = 1 << 20) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write containers in ascending doc_id order to ``path``.

    The texts are range-partitioned by doc_id once (nulls first; equal ids by their texts' hashes) and each task encodes,
    models and writes its own range, holding one container's ids. A container ends in front of a document that would
    not fit; only a document of more than ``segment`` ids runs on over containers. Container order is (part, container). An empty table writes an empty file set.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # a repeated id can be cut between its texts; their hashes stand for them in the bounds
    h = F.xxhash64("text")
    dealt = source.repartitionByRange("doc_id", h).sortWithinPartitions("doc_id", h, "text")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encoder, part = WordEncoder.of(tokenizer_path), TaskContext.get().partitionId()
        held: list[tuple] = []
        size = first = container = number = 0
        for batch in slices(batches):
            rows = batch.to_pydict()
            for doc_id, data in zip(rows["doc_id"], encoder.encode(rows["text"]), strict=True):
                data += end
                start, n = 0, len(data) // 4
                if size + n > segment and held:
                    yield _container(part, container, first, held)
                    first, container, size, held = first + size, container + 1, 0, []
                while start < n:
                    take = min(n - start, segment - size)
                    held.append((number, doc_id, start, take, data[4 * start : 4 * (start + take)], take == n))
                    start, size = start + take, size + take
                    if size == segment:
                        yield _container(part, container, first, held)
                        first, container, size, held = first + size, container + 1, 0, []
                number += 1
        if held:
            yield _container(part, container, first, held)

    dealt.mapInArrow(run, CONTAINER).write.parquet(path)


def _container(part: int, container: int, first: int, held: list[tuple]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join([h[4] for h in held]), dtype=np.uint32)
    symbols, frequencies = frequency_table(ids)
    words, states, offsets, checks, steps = encode_blocks(ids, symbols, frequencies)
    row = (part, container, first, len(ids), [h[1] for h in held], [h[0] for h in held], [h[2] for h in held], [h[3] for h in held], [h[5] for h in held], not all(h[5] for h in held), _squeeze(symbols), zlib.compress(frequencies.tobytes()), words, states, offsets, checks, steps)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow_schema(CONTAINER).types, strict=True)], names=CONTAINER.names)


def _squeeze(symbols: np.ndarray) -> bytes:
    """Ascending ids as compressed differences."""
    return zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype(np.uint32).tobytes())


PIECE = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("number", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.LongType()),
        T.StructField("in_part", T.LongType()),
        T.StructField("whole", T.BooleanType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file set: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit little-endian).

    Containers decode independently; only documents that run over a container's end are brought together, and
    only their containers are read for that.
    One total per written part comes together to give the starts. A damaged block raises.
    """
    rows = spark.read.schema(CONTAINER).parquet(path)
    names = PIECE.names

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                symbols = np.cumsum(np.frombuffer(zlib.decompress(r["symbols"]), dtype=np.uint32), dtype=np.uint32)
                frequencies = np.frombuffer(zlib.decompress(r["frequencies"]), dtype=np.uint32)
                ids = decode_blocks(r["n_ids"], symbols, frequencies, np.frombuffer(r["words"], dtype=np.uint32), np.frombuffer(r["states"], dtype=np.uint64), np.frombuffer(r["offsets"], dtype=np.uint64), r["checksums"], r["steps"])
                data, sizes = ids.tobytes(), r["doc_sizes"]
                at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                columns = [[r["part"]] * len(sizes), r["doc_ids_in"], r["doc_ids"], r["doc_starts"], [r["first"] + a - s for a, s in zip(at, r["doc_starts"], strict=False)], r["doc_whole"], [data[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow_schema(PIECE).types, strict=True)], names=names)

    sums = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each written part
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    whole = rows.mapInArrow(run, PIECE).where("whole").select("part", "doc_id", "in_part", "ids")
    joined = rows.where("cut").mapInArrow(run, PIECE).where("not whole").groupBy("part", "number").agg(F.first("doc_id").alias("doc_id"), F.min("in_part").alias("in_part"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    joined = joined.select("part", "doc_id", "in_part", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    docs = whole.unionByName(joined).join(F.broadcast(bases), "part")
    return docs.select("doc_id", (F.col("base") + F.col("in_part")).alias("start"), (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")
