"""A corpus pipeline of four stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import language
from tilewright.llm.neardup import near_duplicates, text_key
from tilewright.llm.packing import pack
from tilewright.llm.quality import quality
from tilewright.llm.queries import tokenizer_path
from tilewright.plans.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the histograms reject go."""
    return quality(docs).where("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no learned language (score 0: too few of its common 3-grams), go; where no row has a lang, no language is learned and all documents stay."""
    model = language.train(docs)
    if not model.languages:
        return docs.select(*COLUMNS)
    found = language.identify(docs.select(*COLUMNS), model)
    return found.where("lang_pred <> 'und' and score >= 0.2").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8) the smallest doc_id stays.

    Each row has the verdict on its own text. Rows with a null doc_id stay, all of them. Different texts under one id are
    judged apart; rows of one id with the same set of shingles (so also equal rows) are one document: the least text, lang, source and n_chars
    stays. Texts without words have no set, and are merged only where id and text agree.
    """
    kept = near_duplicates(docs, keys=True).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id"), "text_key", "set_key").distinct()
    rows = docs.select(*COLUMNS, text_key().alias("_key"))
    own = rows.join(kept, (F.col("doc_id").cast("long") == F.col("_id")) & F.col("_key").eqNullSafe(F.col("text_key")))
    # repeats of an id merge partly before the shuffle, however many there are
    rest = F.struct("text", "lang", "source", "n_chars")
    merged = own.groupBy("doc_id", F.coalesce("set_key", "_key").alias("_same")).agg(F.min(rest).alias("_row")).select("doc_id", "_row.*")
    return merged.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left, placed into sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("language id", language_id), ("near dedup", near_dedup), ("packing", packing)]
#: The language model, the links and the packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
