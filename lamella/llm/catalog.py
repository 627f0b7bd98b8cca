"""The queries of this subpackage over the driver's tables, one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import bpe, chat, decontaminate, fill_middle, lexical, line_dedup, passages, pii, quality, secrets, simhash, token_files, warc
from lamella.llm._common import fresh_path, read_table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    records = warc.read(warc.write(read_table(spark, sf_dir, "pages"), folder), folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classes(read_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))))).alias("x")).select("conv_id", "x.*")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_turns(chat.canonical_turns(turns)))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents"), fresh_path(spark, "token-files")
    return token_files.read_index(spark, token_files.write(docs, folder), folder)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("spans")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(read_table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read_table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(read_table(spark, sf_dir, "documents")))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_quality that SQL can tell."""
    return op10_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op11_pii that SQL can tell."""
    return op11_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_secrets that SQL can tell."""
    return op7_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_passages, op3_chat, op4_token_files, op5_bpe, op6_simhash, op7_secrets, op8_decontaminate, op9_line_dedup, op10_quality, op11_pii, op12_lexical, op13_fill_middle, quality_base, secrets_base, pii_base)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE_SQL, "op3_chat": chat.ORACLE_SQL, "op8_decontaminate": decontaminate.ORACLE_SQL, "op9_line_dedup": line_dedup.ORACLE_SQL, "op12_lexical": lexical.ORACLE_SQL, "op13_fill_middle": fill_middle.ORACLE_SQL, "quality_base": quality.BASE_SQL, "secrets_base": secrets.BASE_SQL, "pii_base": pii.BASE_SQL}
