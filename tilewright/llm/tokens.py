"""Token ids of whole texts, with what a Python worker has already encoded kept at hand."""

from __future__ import annotations

import os
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ODD = "\x1c\x1d\x1e\x1f"
_CHUNK = re.compile(r"[^ \t\n\r\f\v]+")
_KEPT: dict = {}
_CACHES: list[dict] = []


def only(cache: dict) -> dict:
    """Make room for one cache of this Python worker: all others are emptied, since a worker may serve several operators in turn."""
    if not any(c is cache for c in _CACHES):
        _CACHES.append(cache)
    for other in _CACHES:
        if other is not cache:
            other.clear()
    return cache


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts under a word-bound BPE vocabulary of the ``tokenizers`` library.

    Valid for vocabularies whose pre-tokens never hold white space, so that the ids of a text are
    those of its white-space-delimited chunks one after another. Chunks seen before come from a
    dictionary of at most ``limit`` entries, emptied when full; others are encoded by the library:
    a Latin word, alone or with ASCII marks after it, by its model directly (word and marks are a pre-token
    each), everything else by its whole pipeline. A chunk's ids never depend on what was encoded before.
    """

    def __init__(self, path: str, limit: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = _byte_letters()
        plain = [c for c in map(chr, range(0x250)) if c.isalpha() and c.lower().isalpha()]
        self.lower = {ord(c): "".join([letters[b] for b in c.lower().encode()]) for c in plain}
        direct = '"end_of_word_suffix":"</w>"' in self.tokenizer.to_str().replace(" ", "").replace('\\"', '"')
        self.known = _Known(self, limit, re.compile(f"([{''.join(plain)}]+)([!-/:-@\\[-`{{-~]*)").fullmatch if direct else lambda chunk: None)

    @staticmethod
    def of(path: str) -> WordEncoder:
        """The encoder of this Python worker; made once."""
        if path not in _KEPT:
            _KEPT[path] = WordEncoder(path)
        only(_KEPT[path].known)
        return _KEPT[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids = self.known.__getitem__
        return [b"".join(map(ids, _CHUNK.findall(t) if any(c in t for c in _ODD) else t.split())) for t in texts]


class _Known(dict):
    """Chunks to their packed ids, made when first asked for."""

    def __init__(self, encoder: WordEncoder, limit: int, parts):
        self.limit, self.parts, self.lower, self.marks = limit, parts, encoder.lower, {"": b""}
        self.word, self.whole = encoder.tokenizer.model.tokenize, encoder.tokenizer.encode

    def __missing__(self, chunk: str) -> bytes:
        found = self.parts(chunk)
        if found is None:
            ids = _pack(self.whole(chunk, add_special_tokens=False).ids)
        else:
            word, marks = found.groups()
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {"": b""}
                self.marks[marks] = _pack([t.id for t in self.word(marks)])
            ids = _pack([t.id for t in self.word(word.lower() if word.isascii() else word.translate(self.lower))]) + self.marks[marks]
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = ids
        return ids


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def arrow_schema(schema: T.StructType):
    """The Arrow schema of rows that a ``mapInArrow`` function returns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def slices(batches, rows: int = 512):
    """The record batches of a partition in parts of at most ``rows`` rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` but those whose names, in any case, are taken."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]
