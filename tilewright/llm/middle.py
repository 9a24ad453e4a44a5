"""Fill-in-the-middle examples cut from texts that are kept as seekable frames.

A text is stored as independent zstandard frames of its UTF-8 bytes. Each frame has the numbers of units (lines) that start, of
code points and of bytes in front of it, so that the place of any unit is found by decompressing one frame. An
output is a list of frames too: frames that no cut goes through are taken over as they are, the others
are written anew, and what reads an output streams its frames in order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.tokens import arrow_schema, slices, without

FRAME_BYTES = 1 << 16
LEVEL = 3
#: Sentinels in front of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
FRAME = T.ArrayType(T.StructType([*[T.StructField(n, T.LongType()) for n in ("units", "chars", "bytes")], T.StructField("data", T.BinaryType())]))
STORED = [T.StructField("n_units", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("marked", T.BooleanType()), T.StructField("frames", FRAME)]


class Codec:
    """One compressor and decompressor for each Python worker, and the frame that was opened last."""

    kept: Codec | None = None

    def __init__(self):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.last: tuple[bytes, bytes] = (b"", b"")

    @classmethod
    def of(cls) -> Codec:
        cls.kept = cls.kept or cls()
        return cls.kept

    def open(self, data: bytes) -> bytes:
        if self.last[0] is not data:
            self.last = (data, self.unpack(data))
        return self.last[1]


def code_points(data: bytes) -> int:
    """How many code points start in these UTF-8 bytes."""
    return len(data) if data.isascii() else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def frames_of(data: bytes, codec: Codec, size: int = FRAME_BYTES) -> list[tuple[int, int, int, bytes]]:
    """The frames of a text's bytes: (units that start before, code points before, bytes before, compressed bytes)."""
    out, units, chars = [], 0, 0
    for at in range(0, len(data), size):
        part = data[at : at + size]
        out.append((units, chars, at, codec.pack(part)))
        # a unit starts at the text's first byte and behind every line feed, with which it is counted
        units += part.count(b"\n") + (at == 0)
        chars += code_points(part)
    return out


def to_frames(docs: DataFrame, size: int = FRAME_BYTES, sentinels: tuple[str, ...] = SENTINELS, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with n_units, n_chars, n_bytes, marked (a sentinel occurs in the text) and frames in place of the text.

    Units are lines, ``[^\\n]*\\n|[^\\n]+``. A null text is an empty one, without frames. Columns of these names are replaced.
    """
    keep = [c for c in without(docs, [f.name for f in STORED]) if c.lower() != text.lower()]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], *STORED])

    def run(batches):
        codec, marks = Codec.of(), [s.encode() for s in sentinels]
        for batch in slices(batches, 256):
            made: list[tuple] = []
            for value in batch.column(batch.num_columns - 1):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                units = data.count(b"\n") + (bool(data) and not data.endswith(b"\n"))
                made.append((units, code_points(data), len(data), any(m in data for m in marks), [dict(zip(("units", "chars", "bytes", "data"), f, strict=True)) for f in frames_of(data, codec, size)]))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), list(arrow_schema(schema))[-len(STORED) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def unit_start(frames: list[dict], unit: int, n_units: int, codec: Codec) -> tuple[int, int, int]:
    """(frame, place in it, code points before) of where a unit starts, by decompressing that frame only; the end of the text behind the last unit."""
    if unit >= n_units:
        return len(frames), 0, -1
    k = bisect_right([f["units"] for f in frames], unit) - 1
    data, left, at = codec.open(frames[k]["data"]), unit - frames[k]["units"], 0
    if k == 0:
        left -= 1  # the first unit starts without a line feed before it
    if left >= 0:
        at = int(np.flatnonzero(np.frombuffer(data, np.uint8) == 10)[left]) + 1
    # behind a frame's last byte the next one starts
    return (k, at, frames[k]["chars"] + code_points(data[:at])) if at < len(data) else (k + 1, 0, frames[k]["chars"] + code_points(data))


class Output:
    """A list of compressed frames that grows from bytes and from frames of others, which are not opened."""

    def __init__(self, codec: Codec, size: int):
        self.codec, self.size, self.frames, self.loose = codec, size, [], bytearray()

    def add(self, data: bytes) -> None:
        self.loose += data
        if len(self.loose) >= self.size:
            self.close()

    def close(self) -> None:
        if self.loose:
            self.frames.append(self.codec.pack(bytes(self.loose)))
            self.loose = bytearray()

    def copy(self, frames: list[dict], start: tuple[int, int], stop: tuple[int, int]) -> None:
        """The bytes from one place (frame, byte in it) to another."""
        for k in range(start[0], min(stop[0] + 1, len(frames))):
            a, b = (start[1] if k == start[0] else 0), (stop[1] if k == stop[0] else None)
            if b == 0:
                break
            if a == 0 and b is None and (len(frames) > 1 or not self.loose):
                self.close()
                self.frames.append(frames[k]["data"])
            else:
                self.add(self.codec.open(frames[k]["data"])[a:b])


def _hash_part(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(stored: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS, size: int = FRAME_BYTES, id_col: str = "doc_id") -> DataFrame:
    """Examples of the texts that ``to_frames`` stored: its rows with form, prefix_chars, middle_chars and the output's frames in place of the text's.

    With n units, the prefix ends behind the smaller and the middle behind the larger of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, where h1 to h4 are
    the first four 8-digit groups of the sha256 of ``seed:id`` (null id: nothing behind the colon). The form is ``plain`` (the text as it is; both
    lengths null) for an empty text, one that holds a sentinel, and if ``h3 % 100 >= rate``; otherwise ``spm`` if ``h4 % 100 < spm_rate``, else ``psm``.
    Only frames with a cut in them are decompressed. Rows stand alone, so ties, repeats and empty tables need no rule.
    """
    keep = without(stored, ["form", "prefix_chars", "middle_chars", "output", "frames"])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [_hash_part(F.col("_digest"), k) for k in range(4)]
    many = F.col("n_units") + 1
    plain = (F.col("n_bytes") == 0) | F.col("marked") | (h[2] % 100 >= rate)
    form = F.when(plain, F.lit("plain")).when(h[3] % 100 < spm_rate, F.lit("spm")).otherwise(F.lit("psm"))
    source = stored.withColumn("_digest", digest)
    source = source.select(*[F.col(f"`{c}`") for c in keep], form.alias("form"), F.least(h[0] % many, h[1] % many).alias("_from"), F.greatest(h[0] % many, h[1] % many).alias("_to"), "frames")
    added = [T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.ArrayType(T.BinaryType()))]
    schema = T.StructType([*source.schema.fields[:-3], *added])
    at = {n: source.columns.index(n) for n in ("n_units", "n_chars", "form", "_from", "_to", "frames")}

    def run(batches):
        codec, marks = Codec.of(), [s.encode() for s in sentinels]
        for batch in slices(batches, 128):
            made: list[tuple] = []
            for n_units, n_chars, kind, low, high, frames in zip(*[batch.column(k).to_pylist() for k in at.values()], strict=True):
                out = Output(codec, size)
                ends = (0, 0), (len(frames), 0)
                if kind == "plain":
                    out.copy(frames, *ends)
                    lengths = (None, None)
                else:
                    cuts = [unit_start(frames, k, n_units, codec) for k in (low, high)]
                    chars = [n_chars if c < 0 else c for _, _, c in cuts]
                    one, two = ((k, b) for k, b, _ in cuts)
                    parts = {0: (ends[0], one), 1: (two, ends[1]), 2: (one, two)}
                    for k in (0, 1, 2) if kind == "psm" else (1, 0, 2):
                        out.add(marks[k])
                        out.copy(frames, *parts[k])
                    lengths = (chars[0], chars[1] - chars[0])
                out.close()
                made.append((*lengths, out.frames))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), list(arrow_schema(schema))[-3:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def find_marks(frames: list[bytes], marks: list[bytes], codec: Codec, seen=None) -> tuple[list[int], list[int]]:
    """(where each sentinel stands first, where each frame starts and the last ends), in bytes; ``seen`` gets every frame's bytes in order.

    Frames are streamed: of those before, only as many bytes are kept as a sentinel that runs over a border may need.
    """
    found, starts, tail, at = [-1] * len(marks), [0], b"", 0
    reach = max(map(len, marks), default=1) - 1
    for frame in frames:
        data = codec.open(frame)
        if seen:
            seen(data)
        held = tail + data
        for k, m in enumerate(marks):
            if found[k] < 0 and (p := held.find(m)) >= 0:
                found[k] = at - len(tail) + p
        at += len(data)
        starts.append(at)
        tail = held[-reach:] if reach else b""
    return found, starts


def restored(frames: list[bytes], form: str, marks: list[bytes], codec: Codec, seen=None) -> Iterator[bytes]:
    """The text of an output, from its frames and form alone, part by part."""
    if form == "plain":
        for frame in frames:
            data = codec.open(frame)
            if seen:
                seen(data)
            yield data
        return
    found, starts = find_marks(frames, marks, codec, seen)
    order = sorted(range(3), key=lambda k: found[k])
    stop = {k: found[order[i + 1]] if i < 2 else starts[-1] for i, k in enumerate(order)}
    for k in (0, 2, 1):
        a, b = found[k] + len(marks[k]), stop[k]
        i = bisect_right(starts, a) - 1
        while a < b:
            data = codec.open(frames[i])
            part = data[a - starts[i] : b - starts[i]]
            yield part
            a, i = starts[i + 1], i + 1


def digests(outputs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of ``fill_in_middle`` with output_sha256 and restored_sha256 (the text rebuilt from output and form) in place of the output, frame by frame."""
    source = outputs.select(*[F.col(f"`{c}`") for c in without(outputs, ["output", "output_sha256", "restored_sha256"])], "output")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())])
    form_at = source.columns.index("form")

    def run(batches):
        codec, marks = Codec.of(), [s.encode() for s in sentinels]
        for batch in slices(batches, 128):
            made = []
            for form, frames in zip(batch.column(form_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                whole, text = hashlib.sha256(), hashlib.sha256()
                for part in restored(frames, form, marks, codec, whole.update):
                    text.update(part)
                made.append((whole.hexdigest(), text.hexdigest()))
            columns = [pa.array(c, pa.string()) for c in zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def output_texts(outputs: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with the output as a text."""
    source = outputs.select(*[F.col(f"`{c}`") for c in without(outputs, ["output"])], "output")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("output", T.StringType())])

    def run(batches):
        codec = Codec.of()
        for batch in slices(batches, 128):
            said = [b"".join([codec.open(f) for f in frames]).decode() for frames in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
