"""The corpus pipeline: five stages from raw documents to sharded training rows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies
them to the documents table, writing each result as Parquet under
``spark.checkpoint.dir`` and reading it back as the next stage's documents. All
stages but the last return the columns they got, whatever they are; the last
adds ``shard`` and ``slot``. Names that begin with ``__`` are kept for the stages.

Defined cases: documents without words are rejected by the classifier; of
repeated rows one passes the near-duplicate stage; null ids and sources take
part as values of their own; rows that share an id, or have none, are judged
near-duplicates or contaminated one by one; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymart.llm.common import cut, small, table, with_row_id
from delaymart.llm.decontam import drop_contaminated
from delaymart.llm.mixing import mix
from delaymart.llm.neardup import near_duplicates
from delaymart.llm.quality import keep_good
from delaymart.llm.sharding import shard, text_key

N_SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.8) one row with the smallest
    id stays (null after all others), of repeated rows without words one does."""
    rows = cut(with_row_id(docs), "rows")
    found = near_duplicates(rows, id_col="__row", percent=80, rows=7).select(
        "__row", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("__group"))
    found = found.join(rows.select("__row", F.col("doc_id").alias("__id"), F.sha2("text", 256).alias("__sha")), "__row")
    bare = F.col("__group").isNull()
    found = cut(found.select("__row", "__id", "__group", F.when(bare, F.col("__id")).alias("__bare_id"),
                             F.when(bare, F.col("__sha")).alias("__bare_text")), "near-duplicates")
    first = F.min(F.struct(F.col("__id").isNull().alias("__null"), "__id", "__row")).alias("__first")
    kept = found.groupBy("__group", "__bare_id", "__bare_text").agg(first).select(F.col("__first.__row").alias("__row"))
    drop = cut(found.select("__row").join(kept, "__row", "left_anti"), "near-dropped")
    return rows.join(small(drop, drop.count(), 16), "__row", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: never, once or twice. Decided
    by row, so rows that share an id, or have none, are taken each on its own."""
    rows = cut(with_row_id(docs), "rows")
    taken = mix(rows, row_col="__row").where("copies > 0").select("__row", F.col("copies").cast("int").alias("__copies"))
    rows = rows.join(taken, "__row")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 40 shards of near-equal bytes, with their place in the shard."""
    rows = docs.withColumn("__bytes", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long"))
    rows = rows.withColumn("__key", text_key(F.col("text")))
    return shard(rows, N_SHARDS, ["__key", "doc_id"], "__bytes").drop("__key", "__bytes")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("shard_rows", shard_rows)]
# The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharded rows that all stages leave of the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
