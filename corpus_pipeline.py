"""A corpus pipeline of four stages: toxic documents go, of near copies one stays, repeated
paragraphs go, and what is left is packed into sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written and read again
as the next one's docs.  All but the last return the columns of documents.  Null texts and texts
without words pass the first three stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.llm.op2_toxicity import toxic_score, trained_on
from curalith.llm.op4_best_fit_packing import pack_documents
from curalith.llm.op6_paragraph_minhash import without_repeats
from curalith.llm.op7_ngram_jaccard_join import jaccard_components
from curalith.llm.storage import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half, by a grammar learned from labels of documents."""
    grammar = trained_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxic_score(grammar)(F.col("text")) < 0.5)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group that is connected by links of 0.8 in
    five-word shingles; equal rows of one doc_id stay once."""
    found = jaccard_components(docs)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone_id")).distinct()
    kept = docs.join(gone.hint("merge"), docs["doc_id"] == F.col("_gone_id"), "left_anti")
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def drop_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs that stand, equal or nearly so, in an earlier one."""
    return without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_near_copies),
    ("substring_dedup", drop_repeated_paragraphs),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned weights, banding and a genetic search have no SQL form; the stages are tested on their own.
ORACLE_SQL = None
