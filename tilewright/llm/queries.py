"""The registered queries of this subpackage; each reads its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import chat, chunks, language, middle, neardup, oracles, pieces, tokencounts, tokenfile
from tilewright.llm.exact import exact_duplicates
from tilewright.llm.licenses import license_scan
from tilewright.llm.packing import pack
from tilewright.llm.quality import quality
from tilewright.llm.resample import resample
from tilewright.plans.staging import scratch_dir, stage


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file lies; the folder is the same on every executor."""
    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = license_scan(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.edit_likeness(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_written(stage(chat.written_out(turns.unionByName(added)), "examples", compression="zstd"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return tokenfile.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    digest = F.sha2("text", 256)
    coded = pieces.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text", digest.alias("text_sha256")), path)
    # the digest stands for the text from here on, so that texts are not sent through the second pass
    back = pieces.decode_pieces(coded.drop("text"), path)
    ids = F.concat_ws(",", F.col("piece_ids").cast("array<string>"))
    found = F.sha2("decoded", 256)
    return back.select("doc_id", F.size("piece_ids").cast("long").alias("n_ids"), F.crc32(ids.cast("binary")).alias("ids_crc32"), found.alias("decoded_sha256"), found.eqNullSafe(F.col("text_sha256")).alias("round_trip"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stage(middle.to_frames(table(spark, sf_dir, "documents").select("doc_id", "text")), "frames", compression="none")
    d = middle.digests(middle.fill_in_middle(stored))
    return d.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_features", "weight", "score", "rank")


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


#: Fixed value: the pattern that splits text for the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
QUERIES = {
    f.__name__: f
    for f in (
        op1_language, op2_neardup, op3_quality, op4_licenses, op5_fingerprints, op6_chat, op7_token_files, op8_packing, op9_pieces, op10_token_counts,
        op11_middle, op12_resample, op13_exact,
    )
}
#: The other methods (kernels, chunks, vocabularies, packing, regular expressions by the hundred) have no SQL; the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_neardup": oracles.near_duplicates(4, 80), "op3_quality": oracles.quality(), "op6_chat": oracles.chat(), "op11_middle": oracles.middle(), "op12_resample": oracles.resample(),
    "op13_exact": oracles.exact(),
}
