"""From raw documents to token files: quality, near-duplicates, benchmark leaks, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it to the shared folder and rereads it for the next stage.
All stages but the last return the columns of ``documents``. SQL can express none of them whole, so ORACLE_SQL is None and the tests
compare with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from isotherma.llm import decontaminate, importance, mixing, superminhash, token_files
from isotherma.session import shared_folder, stored, tune

MIX_WEIGHTS = [3, 1, 2]
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 1.5, 2.0, 17
TOKENIZER = "byte_bpe_50k.json"
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return importance.resample(docs, labels).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    tune(spark)
    return superminhash.one_per_group(docs, superminhash.Rule(5, 80)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_leaks(docs, benchmark).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    tune(spark)
    return mixing.repeated(mixing.mix(docs, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token files, and per document what is read back from them: doc_id, start, n_tokens and ids_crc32."""
    import public_tokenizers

    folder = f"{shared_folder(tune(spark))}/tokens-{uuid.uuid4().hex}"
    token_files.write_shards(docs, folder, tokenizer or public_tokenizers.path(TOKENIZER))
    return token_files.read_documents(spark, folder)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
