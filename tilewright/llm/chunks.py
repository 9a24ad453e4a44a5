"""Document fingerprints from content-defined chunks."""

from __future__ import annotations

import base64
import hashlib
import json
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.tokens import arrow_schema, slices

#: Bytes that the rolling hash looks back on.
WINDOW = 32
PAIRS = np.dtype([("digest", "<u8"), ("length", "<u4")])


def gear_table(seed: int = 7) -> np.ndarray:
    """256 random 32-bit numbers, one for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR over the last 32 bytes, each shifted by its distance, modulo 2**32."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def chunk_ends(data: bytes, low: int, mid: int, high: int) -> list[int]:
    """Ends of the chunks: normalised chunking between ``low`` and ``high`` bytes.

    Up to ``mid`` bytes a boundary needs two more zero bits of the hash than ``mid`` alone would ask for, beyond it
    two fewer, which draws lengths towards ``mid``. The hash depends on 32 bytes only, fewer than
    ``low``, so a boundary inside a shifted passage stays where it was.
    """
    size = len(data)
    if size <= low:
        return [size] if size else []
    bits = int(math.log2(mid))
    h = gear_hashes(np.frombuffer(data, dtype=np.uint8))
    top = np.uint32(32 - (bits - 2))
    easy = np.flatnonzero(h >> top == 0)
    hard = easy[h[easy] >> np.uint32(32 - (bits + 2)) == 0].tolist()
    easy = easy.tolist()
    ends, at, i, j = [], 0, 0, 0
    while size - at > low:
        end = min(size, at + high)
        while i < len(hard) and hard[i] + 1 < at + low:
            i += 1
        if i < len(hard) and hard[i] + 1 <= at + mid:
            end = hard[i] + 1
        else:
            while j < len(easy) and easy[j] + 1 <= at + mid:
                j += 1
            if j < len(easy) and easy[j] + 1 < end:
                end = easy[j] + 1
        ends.append(end)
        at = end
    if at < size:
        ends.append(size)
    return ends


def fingerprint(data: bytes, low: int = 40, mid: int = 128, high: int = 512) -> np.ndarray:
    """The distinct (digest, length) pairs of the chunks, sorted; equal texts give equal arrays."""
    ends = chunk_ends(data, low, mid, high)
    out = np.empty(len(ends), dtype=PAIRS)
    at, digest = 0, xxhash.xxh3_64_intdigest
    out["digest"] = [digest(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    out["length"] = np.diff(np.array([at, *ends]))
    return np.unique(out)


def encode(pairs: np.ndarray) -> str:
    """A fingerprint as text: base64 of 8 bytes digest and 4 bytes length a chunk."""
    return base64.b64encode(pairs.tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=PAIRS)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Bytes in chunks that both have, over the bytes of the smaller set; 1 if both are empty, 0 if one is."""
    wa, wb = int(a["length"].sum(dtype=np.int64)), int(b["length"].sum(dtype=np.int64))
    if not wa or not wb:
        return float(wa == wb)
    both = np.isin(a["digest"], b["digest"], assume_unique=True)
    return min(1.0, float(a["length"][both].sum(dtype=np.int64)) / min(wa, wb))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (part, is_next, doc_id, text) dealt and sorted so that each document's follower stands after it.

    The order is descending doc_id (nulls last; equal ids by text). Parts of about equal size come from approximate quantiles of
    the ids, whatever values they have; rows of one id stay together. The first documents of each part are also sent, marked
    ``is_next``, to the end of the part before it, and the very first to the end of the last. The texts move once.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("doc_id").cast("long")
    # fewer numbers than parts come to the driver
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(docs.agg(F.percentile_approx(key, shares, max(10_000, 50 * parts))).first()[0] or [])) if shares else []
    part = F.when(key.isNull(), len(bounds)).otherwise(_count_above(bounds, key))
    first = docs.groupBy(part.alias("part")).agg(F.max(key).alias("first")).orderBy("part").collect()
    targets = [(after["first"], before["part"]) for before, after in zip(first, first[1:] + first[:1], strict=True)]
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), part.alias("part"))
    heads = spark.createDataFrame(targets, "head long, target int")
    follow = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))
    follow = follow.select(F.col("target").alias("part"), F.lit(True).alias("is_next"), "doc_id", "text")
    both = rows.select("part", F.lit(False).alias("is_next"), "doc_id", "text").unionByName(follow)
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "is_next", F.desc_nulls_last("doc_id"), "text")


def _count_above(bounds: list[int], key: Column) -> Column:
    """How many of the ascending bounds are above the key; looked up in groups, so that a row meets few of them."""
    size = max(1, math.isqrt(len(bounds)))
    down = bounds[::-1]
    groups = [down[i : i + size] for i in range(0, len(down), size)]
    if not groups:
        return F.lit(0)
    kind = "array<bigint>"
    lists = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    # groups that lie above the key as a whole, then the place in the next one
    whole = F.size(F.filter(F.lit([g[-1] for g in groups]).cast(kind), lambda b: b > key))
    within = F.size(F.filter(F.coalesce(F.get(lists, whole), F.array().cast(kind)), lambda b: b > key))
    # the last group may be short
    return F.least(F.lit(len(bounds)), whole * size + within)


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def fingerprints(docs: DataFrame, text: str = "text", low: int = 40, mid: int = 128, high: int = 512) -> DataFrame:
    """Add ``fingerprint`` to every document: the encoded chunk set of its whole text.

    A null or empty text has the empty fingerprint. A column of that name is replaced. Rows stand alone.
    """

    def column(texts):
        for batch in texts:
            yield batch.map(lambda t: encode(fingerprint((t or "").encode(), low, mid, high)))

    from collections.abc import Iterator

    import pandas as pd

    column.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("fingerprint", F.pandas_udf(column, "string")(F.coalesce(F.col(text), F.lit(""))))


def edit_likeness(docs: DataFrame, low: int = 40, mid: int = 128, high: int = 512) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    The last floor(n/2) code points are replaced by the first as many (or all) of the next document in
    descending doc_id; the last one's next is the first. A lone document follows itself. ``near_edited``
    and ``near_next`` are containments by length. Null texts count as empty; null ids come last and
    stay null; equal ids are ordered by text. An empty table gives no rows; other columns are left out.
    A task streams its sorted rows and holds two texts at a time.
    """
    names = RESULT.names

    def run(batches):
        held, out = None, []
        for batch in slices(batches, 256):
            rows = batch.to_pydict()
            for part, is_next, doc_id, text in zip(rows["part"], rows["is_next"], rows["doc_id"], rows["text"], strict=True):
                if held is not None and held[0] == part:
                    mark = fingerprint(text.encode(), low, mid, high)
                    out.append(compare(held, text, mark))
                    held = None if is_next else (part, doc_id, text, mark)
                elif not is_next:
                    held = (part, doc_id, text, fingerprint(text.encode(), low, mid, high))
                else:
                    held = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow_schema(RESULT).types, strict=True)], names=names)
                out = []

    def compare(held, following, following_mark):
        _, doc_id, text, mark = held
        half = len(text) // 2
        edited = (text[: len(text) - half] + following[:half]).encode()
        edited_mark = fingerprint(edited, low, mid, high)
        return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), encode(mark), encode(edited_mark), containment(mark, edited_mark), containment(mark, following_mark))

    return with_next(docs).select("part", "is_next", "doc_id", "text").mapInArrow(run, RESULT)


def likeness(a: Column, b: Column) -> Column:
    """Containment of two columns of encoded fingerprints."""

    def score(x, y):
        import pandas as pd

        return pd.Series([None if p is None or q is None else containment(decode(p), decode(q)) for p, q in zip(x, y, strict=True)])

    import pandas as pd

    score.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, "double")(a, b)
