"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import host_rules, recompress
from .common import shared_path, table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer_path(), size=2048, end_id=1)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, seed=42, tau=4)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import scored

    return scored(table(spark, sf_dir, "documents"), depth=6)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import found

    rows = found(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "valid", "error")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "source", "lang", "p_low", "p_toxic", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recompress import without_repeats

    rows = without_repeats(table(spark, sf_dir, "documents"), window=20)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .host_rules import host_rules

    return host_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_ALL = (op1_lm_score, op2_warc, op3_pii, op4_quality, op5_token_counts, op6_substring_dedup, op7_decontamination, op8_host_rules, op9_packing, op10_simhash)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op6_substring_dedup": recompress.SQL, "op8_host_rules": host_rules.SQL}
