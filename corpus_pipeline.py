"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Tables that a stage has settled for its output are deleted
when the next stage starts: by then the output is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.llm import budget_mix, shingle_join, suffix_dedup, toxicity_cnn
from duskline.llm.common import prepare, table
from duskline.llm.queries import token_digests
from duskline.session import release, settled, settled_scope

_LEFT: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        release(spark, _LEFT)
        with settled_scope() as made:
            out = work(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    return run


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from labelled rows outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels").where(~toxicity_cnn.held_out(F.col("doc_id")))
    return toxicity_cnn.classify(docs, labels).where(F.col("_tx_score") < toxicity_cnn.CUT).select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more, candidates by SimHash and Golay keys
    and completed from bands), the document with the smallest id stays."""
    return shingle_join.near_groups(docs).where("_sj_first").select(*docs.columns)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents of which nothing is left go."""
    cut = suffix_dedup.remove_repeats(docs)
    left = cut.where(F.col("text").isNull() | (F.size("_sd_spans") == 0) | (F.length("_sd_text") > 0))
    text = F.when(F.size("_sd_spans") > 0, F.col("_sd_text")).otherwise(F.col("text"))
    return left.withColumns({"text": text, "n_chars": F.when(F.size("_sd_spans") > 0, F.length("_sd_text").cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document stands as often as the mix takes it."""
    sized = docs.withColumn("_bm_words", budget_mix.word_count(F.col("text")))
    mixed = budget_mix.mix(sized, "_bm_words")
    return mixed.where("_bm_copies > 0").withColumn("_bm_copy", F.explode(F.sequence(F.lit(1), F.col("_bm_copies")))).select(*docs.columns)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left and the bytes they decode to, as digests."""
    return token_digests(docs.select("doc_id", "lang", "source", "text"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mixing), ("tokens", tokens)]
#: A trained classifier, fingerprints and knapsack tables are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    with settled_scope() as made:
        for _, stage in STAGES:
            docs = settled(stage(spark, docs, sf_dir))
            release(spark, made, keep=[docs])
    return docs
