"""Token counts of a document's sections, from one encoding of the whole text."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.tokens import arrow_schema, slices

RULES = ("majority", "start", "end")
_KEPT: dict = {}


class SpanEncoder:
    """Token spans in characters under a byte-level rank vocabulary; the tokens of a text cover it without gaps."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    @staticmethod
    def of(path: str, pattern: str) -> SpanEncoder:
        if path not in _KEPT:
            _KEPT[path] = SpanEncoder(path, pattern)
        return _KEPT[path]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token; one that holds part of a character's bytes spans that character."""
        ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        if len(text) == (ends[-1] if len(ends) else 0):
            return starts, ends
        data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Each line with its line feed is a section; an empty text has one, empty."""
    sizes = np.array([len(x) + 1 for x in text.split("\n")], dtype=np.int64)
    sizes[-1] -= 1
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def attribute(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(owner, crossing): for each token the section it counts for, or -1, and whether its span leaves that section.

    Sections are disjoint, ascending and may have gaps or be empty. "start" gives a token to the section of its first
    character, "end" to that of its last, "majority" to the one with most of its characters, the earlier of equals.
    """
    n = len(lows)
    if not n or not len(starts):
        return np.full(len(starts), -1), np.zeros(len(starts), dtype=bool)

    def holding(at: np.ndarray) -> np.ndarray:
        # of sections that start at one place, all but the last are empty
        k = np.searchsorted(lows, at, side="right") - 1
        return np.where((k >= 0) & (at < highs[np.maximum(k, 0)]), k, -1)

    first, last = holding(starts), holding(ends - 1)
    owner = last if rule == "end" else first.copy()
    if rule == "majority":
        for i in np.flatnonzero((first != last) | (first < 0)).tolist():
            a = int(np.searchsorted(highs, starts[i], side="right"))
            b = int(np.searchsorted(lows, ends[i], side="left"))
            part = np.minimum(highs[a:b], ends[i]) - np.maximum(lows[a:b], starts[i])
            owner[i] = a + int(np.argmax(part)) if len(part) and part.max() > 0 else -1
    inside = (owner >= 0) & (starts >= lows[np.maximum(owner, 0)]) & (ends <= highs[np.maximum(owner, 0)])
    return owner, ~inside


COUNTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("section", T.LongType()),
        T.StructField("start_char", T.LongType()),
        T.StructField("end_char", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_crossing", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, sections: str | None = None, rule: str = "majority") -> DataFrame:
    """Tokens of each section of each document, from one encoding of its whole text.

    ``sections`` names a column array<struct<start, end>> of disjoint character ranges (sorted here; cut to
    the text; null entries and a null array count as none); by default each line with its line feed is one. Tokens are intervals of characters,
    joined with the sections by their sorted bounds; one that crosses a bound goes to one section by ``rule`` (see
    ``attribute``), so no token counts twice. Columns: doc_id, section (from 0; -1 for tokens that lie in no section, only where there are any),
    start_char, end_char, n_tokens, n_crossing (of those, how many leave the section), doc_tokens. Overlapping sections raise.

    A null text counts as empty. Repeated rows are counted each. An empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    own = F.lit(None).cast("array<struct<start:bigint,end:bigint>>") if sections is None else F.transform(sections, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), own.alias("sections"))
    by_line = sections is None

    def run(batches):
        encoder = SpanEncoder.of(ranks_path, pattern)
        for batch in slices(batches, 256):
            rows, out = batch.to_pydict(), []
            for doc_id, text, given in zip(rows["doc_id"], rows["text"], rows["sections"], strict=True):
                if by_line:
                    lows, highs = line_sections(text)
                else:
                    ranges = sorted((min(max(0, s["start"]), len(text)), min(max(0, s["end"]), len(text))) for s in given or [] if s is not None and s["start"] is not None and s["end"] is not None and s["start"] <= s["end"])
                    lows, highs = (np.array([r[k] for r in ranges], dtype=np.int64) for k in (0, 1))
                    if len(lows) > 1 and (highs[:-1] > lows[1:]).any():
                        raise ValueError(f"sections of document {doc_id} overlap")
                starts, ends = encoder.spans(text)
                owner, crossing = attribute(starts, ends, lows, highs, rule)
                n = np.bincount(owner[owner >= 0], minlength=len(lows))
                c = np.bincount(owner[(owner >= 0) & crossing], minlength=len(lows))
                k = len(lows)
                out.append((np.full(k, doc_id if doc_id is not None else 0), np.arange(k), lows, highs, n, c, np.full(k, len(starts)), np.full(k, doc_id is None)))
                if (gap := int((owner < 0).sum())) > 0:
                    out.append((*[np.array([v]) for v in (doc_id or 0, -1, 0, len(text), gap, 0, len(starts))], np.array([doc_id is None])))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                arrays = [pa.array(columns[0].astype(np.int64), mask=columns[-1]), *[pa.array(c.astype(np.int64)) for c in columns[1:-1]]]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema(COUNTS))

    return source.mapInArrow(run, COUNTS)
