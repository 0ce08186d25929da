"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, mixture, token store.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
rereads it as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import decontamination, mixing, quality, queries, simhash
from gaugeworks.llm.common import drop_scratch, scratch_freed, stored_at, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's reference distributions reject go; null and blank texts do.
    Repeated rows are judged alike, a null language is one of its own."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts (five-word shingles, similarity 0.8) the smallest doc_id stays, null ones last.
    Null and blank texts are one group; of rows that share doc_id and text one stays."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and blank texts hold none. Repeated rows are judged alike."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it (up to 3 times). Texts without words are never taken; a null source
    is one of its own; rows that share doc_id and size are taken alike."""
    whole = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    mixed = mixing.mix(whole, whole_documents=True, keep=("_row",))
    times = (F.col("copies") + (F.col("part_to") > 0).cast("long")).cast("int")
    return mixed.where(times > 0).select("_row", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")).select("_row.*")


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of what is left, read back: one row per document, null doc_ids first; null texts have the end id only."""
    return queries.stored_tokens(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
    ("token_store", token_store),
]

#: SQL has neither the tokenizer nor the fingerprints' hash: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's scratch and its input go once its output is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch_freed(spark) as made:
            docs, out = stored_at(stage(spark, docs, sf_dir), name)
            made.remove(out)
            made += [path] if path else []
        path = out
    result = STAGES[-1][1](spark, docs, sf_dir)
    drop_scratch(spark, path)
    return result
