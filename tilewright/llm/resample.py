"""Importance resampling: documents are drawn with a probability that follows how much they look like a target.

Hashed n-gram counts of all documents and of all target texts give every bucket a gain; a document's weight is its mean gain; adding a
reproducible Gumbel number to the weight and taking the highest sums draws without replacement. Texts are taken apart by Arrow kernels.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.tokens import slices
from tilewright.plans.order import prefix_sum
from tilewright.plans.staging import stage

#: Fixed value: what separates words, once A-Z are lower-cased.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def word_rows(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts as one dictionary array, and the row of each; nulls have none."""
    # a copy first: ascii_lower of a slice spoils its text
    own = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    split = pc.split_pattern_regex(pc.ascii_lower(own), BETWEEN)
    words, rows = pc.list_flatten(split), pc.list_parent_indices(split)
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some).dictionary_encode(), rows.filter(some).to_numpy(zero_copy_only=False)


def ngram_buckets(texts: pa.Array, ngrams: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text; and for each n the rows of all n-grams, repeats counted, and their buckets.

    An n-gram is a pair of an (n-1)-gram and the word behind it, both as indices; the checksum of a distinct pair
    goes on from that of its first half.
    """
    words, rows = word_rows(texts)
    sizes = np.bincount(rows, minlength=len(texts))
    said = [w.encode() for w in words.dictionary.to_pylist()]
    index = words.indices.to_numpy().astype(np.int64)
    gram, crcs = index, [zlib.crc32(w) for w in said]
    found = [(rows, _spread(crcs, gram, buckets))]
    for n in range(2, ngrams + 1):
        here = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
        # the (n-1)-grams of a row start at all of its words but the last n - 2; `gram` has one place for every word
        pair = gram[here] * max(1, len(said)) + index[here + n - 1]
        distinct, at = np.unique(pair, return_inverse=True)
        first, last = np.divmod(distinct, max(1, len(said)))
        seeds = [zlib.crc32(b" ", c) for c in crcs]
        crcs = list(map(zlib.crc32, map(said.__getitem__, last.tolist()), map(seeds.__getitem__, first.tolist())))
        gram = np.zeros(len(rows), dtype=np.int64)
        gram[here] = at
        found.append((rows[here], _spread(crcs, at, buckets)))
    return sizes, found


def _spread(crcs: list[int], at: np.ndarray, buckets: int) -> np.ndarray:
    return (np.array(crcs, dtype=np.int64) % buckets)[at] if len(at) else np.zeros(0, dtype=np.int64)


def bucket_counts(docs: DataFrame, ngrams: int, buckets: int, text: str = "text") -> np.ndarray:
    """How many n-grams of 1 to ``ngrams`` words of all whole texts fall in each bucket; one count a bucket and task is shuffled, ``buckets`` numbers come to the driver."""

    def run(batches):
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, 256):
            for _, found in ngram_buckets(batch.column(0), ngrams, buckets)[1]:
                counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets, in doubles."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gains: np.ndarray, ngrams: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the floored mean gain over its n-grams, 0 without any."""

    def run(batches):
        for batch in slices(batches, 256):
            n = batch.num_rows
            words, found = ngram_buckets(batch.column(1), ngrams, len(gains))
            many, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for rows, buckets in found:
                # rows ascend, so each text is one segment
                ends = np.searchsorted(rows, np.arange(n + 1))
                upto = np.concatenate([[0], np.cumsum(gains[buckets])])
                many += np.diff(ends)
                total += upto[ends[1:]] - upto[ends[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(many), pa.array(np.where(many > 0, total // np.maximum(many, 1), 0))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, ngrams: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """Draw ``percent`` % of the documents of ``min_words`` words or more: (doc_id, n_words, n_features, weight, score, rank) of every row.

    A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of whole texts (null: none); n-grams are all runs of 1 to ``ngrams`` words joined by one
    space, and fall into the bucket of their crc32. score is weight + floor(-1000 ln(-ln((h + 0.5) / 2**32))) with h from the sha256 of ``seed:doc_id`` (null id:
    nothing behind the colon). rank counts from 1 by descending score, ties to the smaller id (null first; rows alike in both in any order), and is null for
    rows not drawn. Counts cover all rows of both tables; an empty target or table is fine. Two passes over the texts;
    numbers only are shuffled, and ranks come from one range sort.
    """
    gains = bucket_gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stage(weights(docs, gains, ngrams).withColumn("score", F.col("weight") + gumbel), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    ranked = prefix_sum(able, [F.desc("score"), F.col("doc_id")], out="_at")
    ranked = ranked.withColumn("rank", F.when(F.col("_at") < drawn, F.col("_at") + 1)).drop("_at")
    return ranked.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
