"""Exact duplicates: rows are grouped by a 128-bit hash of their content, and bytes are compared inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.plans.staging import Staged

#: Groups of more than one in so many rows are hot; so there are at most as many, and they are broadcast.
HOT_SHARE = 2048


def content_hash(text: Column) -> Column:
    """128 bits of a text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(
    docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, key: Callable[[Column], Column] = content_hash, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex of the normalised text in UTF-8).

    Texts are equal when identical after ``normalise`` (default: no change; null counts as empty). Of equal texts the row with the ``keep``
    ("smallest" or "largest") id stays. Rows are grouped by ``key``, and by their bytes within a key: each task hands on every distinct text once, so
    copies merge before the shuffle and a group of any size is a few rows. Ids and sizes go back to the rows by the hash alone, or, where
    different texts share one (a collision), by the text itself. Groups of more than 1/2048 of the rows, at most 2048, are broadcast; the
    others are joined by hash.

    Null ids come after all others: a row with one stays only if no equal text has an id, and then all such rows stay. Rows that repeat
    an id and its text are one document with one verdict. An empty table gives none; other columns are not looked at.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    best = F.min if keep == "smallest" else F.max
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(normalise(plain), F.lit("")).alias("t") if normalise else plain.alias("t"))
    hashed = rows.withColumn("h", key(F.col("t")))
    texts = hashed.groupBy("h", "t").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    with Staged() as staged:
        groups = staged(texts.groupBy("h").agg(F.count("*").alias("n_texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")), "groups")
        clashing = groups.where("n_texts > 1").select("h")
        slim = staged.keep(staged(hashed.select("doc_id", "h", F.sha2("t", 256).alias("text_sha256")), "hashes"))
        total = slim.count()
        whole = groups.where("n_texts = 1").drop("n_texts")
        hot = staged.keep(staged(whole.where(F.col("group_size") * HOT_SHARE > total), "hot"))
        rest = staged.keep(staged(whole.where(F.col("group_size") * HOT_SHARE <= total), "rest"))
        many, few = F.broadcast(hot), F.broadcast(hot.select("h"))
        found = slim.join(many, "h").unionByName(slim.join(few, "h", "left_anti").join(rest, "h"))
        if not clashing.isEmpty():
            apart = staged.keep(staged(hashed.join(clashing, "h", "left_semi"), "clashing"))
            each = apart.groupBy("h", "t").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            found = found.unionByName(apart.join(each, ["h", "t"]).select("h", "doc_id", F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
