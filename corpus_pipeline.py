"""The corpus pipeline: quality, toxicity, near duplicates, decontamination, tokens.

Each stage works on all that the one before it kept and returns the columns of documents, the last its own. A
row is known by a key of its doc_id and text, so rows whose doc_id repeats or is null are judged each on their
own. Null and empty texts pass through the stages as empty texts; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkorekta.llm import bpe, common, decontaminate, quality, simhash, toxicity
from sparkorekta.llm.queries import _tokenizer

#: Scratch folders of the stage before; it has been written when the next one begins.
_spent: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop_scratch(spark, _spent)
        mark = common.scratch_mark()
        out = work(spark, docs, sf_dir)
        _spent[:] = common.made_since(mark)
        return out

    return run


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the co-trained classifier keeps. Without labels every document stays (its score is 0.5)."""
    found = quality.classify(spark, docs, common.table(spark, sf_dir, "labels"))
    return _kept(docs, found.where("not keep").select("row"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity of 0.3 or more; without labels none (nothing is known of toxicity then)."""
    labels = common.table(spark, sf_dir, "labels")
    if labels.where("toxic is not null and doc_id is not null").isEmpty():
        return docs
    model = toxicity.train(spark, docs, labels)
    return _kept(docs, toxicity.score(spark, _keyed(docs), model, 0.3).where("predicted = 1").select(F.col("doc_id").alias("row")))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8): that with the smallest doc_id.

    Texts without words are one group. Of rows that are equal in doc_id and text one stays.
    """
    kept = _kept(docs, simhash.copies(spark, docs, 5, 0.8))
    # Only keys are grouped, not texts.
    again = docs.groupBy(common.row_key().alias("row")).agg(F.count("*").alias("n")).where("n > 1").select("row")
    if again.isEmpty():
        return kept
    rest = kept.withColumn("__row", common.row_key()).join(again, F.col("__row") == again.row, "left_semi").dropDuplicates(["__row"]).select(*docs.columns)
    return _kept(kept, again).unionByName(rest)


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontaminate.contamination(spark, _keyed(docs), common.table(spark, sf_dir, "benchmark"))
    return _kept(docs, found.select(F.col("doc_id").alias("row")))


def _keyed(docs: DataFrame) -> DataFrame:
    """row keys as doc_id, and the texts."""
    return docs.select(common.row_key().alias("doc_id"), "text")


def _kept(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rejected rows (common.row_key)."""
    gone = rejected.distinct()
    return docs.withColumn("__row", common.row_key()).join(gone, F.col("__row") == gone.row, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.digests(docs, _tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", _stage(quality_filter)), ("toxicity", _stage(toxicity_filter)), ("near_duplicates", _stage(near_duplicate_filter)), ("decontamination", _stage(decontamination_filter)), ("tokens", _stage(tokens))]

#: Trained models and 64-bit hashes: SQL can't express the stages; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    written: list[str] = []
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = common.scratch(spark, f"stage-{name}")
            out.write.parquet(path)
            _spent[:] = [p for p in _spent if p != path]
            docs = spark.read.schema(out.schema).parquet(path)
            written.append(path)
            common.drop_scratch(spark, written[:-1])
            written = written[-1:]
    return out
