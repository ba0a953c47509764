"""The registered queries of this subpackage: thin wrappers over the operators
with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymart.llm.common import table
from delaymart.llm.decontam import contaminated
from delaymart.llm.exact import exact_dedup
from delaymart.llm.filteraudit import audit_documents
from delaymart.llm.licenses import licence_paragraphs
from delaymart.llm.lines import near_lines
from delaymart.llm.mixing import mix
from delaymart.llm.neardup import near_duplicates
from delaymart.llm.packing import pack
from delaymart.llm.phrases import collocations
from delaymart.llm.quality import classify
from delaymart.llm.sharding import shard, text_key
from delaymart.llm.substrings import repeated_spans
from delaymart.llm.wrapper import main_text

N_SHARDS = 40
VOCABULARY = "word_bpe_49k.json"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes, ordered by text then id."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        text_key(F.col("text")).alias("key"))
    out = shard(rows, N_SHARDS, ["key", "doc_id"], "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the scorer's chance of being bad and the decision."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate component (5 words, 0.85)."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=5, percent=85, rows=9)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the id that stays of their equal texts (A-Z lower-cased)."""
    out = exact_dedup(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents with the earliest equal or near line."""
    return near_lines(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence paragraph of all documents with its family."""
    return licence_paragraphs(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it holds a copy of."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated spans of all documents, with where each occurred first."""
    return repeated_spans(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words the mix takes of each."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of all documents in token sequences of 2048."""
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each source, in every order."""
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of 2 to 4 words of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_html_extraction": op10_html_extraction,
    "op11_packing": op11_packing,
    "op12_filter_audit": op12_filter_audit,
    "op13_phrase_mining": op13_phrase_mining,
}
