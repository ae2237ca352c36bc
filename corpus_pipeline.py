"""The corpus pipeline: stages that each call one operator of loanlife.llm.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the
last return the columns of ``documents``. Ids that repeat are treated as one document by the
near-duplicate stage; columns beyond those of ``documents`` pass through all filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlife.llm.contamination import without_items
from loanlife.llm.near_duplicates import near_duplicates
from loanlife.llm.pieces import encoding_digests, read_model
from loanlife.llm.quality import score, train
from loanlife.llm.repeats import remove_repeats
from loanlife.llm.words import fresh
from loanlife.support import materialize

TOKENIZER = "piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels not held out, rejects go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = [fresh(base, docs.columns) for base in ("score", "predicted")]
    return score(docs, model, None, *names).where(F.col(names[1]) == 1).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    name = fresh("kept_id", docs.columns)
    return docs.join(kept.withColumnRenamed("doc_id", name).hint("shuffle_hash"),
                     F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand elsewhere, too, are cut out of the texts.

    ``n_chars`` of changed texts follows. No document goes: one that was nothing but repeats has an
    empty text.
    """
    before = fresh("before", docs.columns)
    out = remove_repeats(docs.withColumn(before, F.xxhash64("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(
            F.xxhash64("text") == F.col(before), F.col("n_chars"))
            .otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 75 % or more of a benchmark item's shingles go."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document left."""
    import public_tokenizers
    return encoding_digests(docs, read_model(public_tokenizers.path(TOKENIZER)))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage),
          ("repeats", repeats_stage), ("contamination", contamination_stage),
          ("encoding", encoding_stage)]

# No SQL form of the classifier exists; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
