"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .linear import Ftrl, dense

BITS = 20
#: Labelled documents that the model is fitted on at most (about: a hash threshold makes the sample).
TRAIN_DOCS = 12_000
EPOCHS = 5
#: Punctuation and digits part words.
_CUT = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_SALT = [np.uint64(x) for x in (0x1B873593CC9E2D51, 0x38B34AE5E6546B64, 0x85EBCA6BC2B2AE35, 0x27D4EB2F165667C5)]


class Grams:
    """Hashed features of a text: words, their first letters, pairs of neighbours, pairs with one word between."""

    def __init__(self):
        self.words = common.WordHashes(seed=3, prefix=5)

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().encode().translate(_CUT).split()
        if not words:
            return np.empty(0, np.int64)
        w, stem = self.words.columns(words).T
        # Word hashes are uniform already: odd multipliers part the kinds, and the top bits of a sum depend on both words.
        mixed = np.concatenate([w * _SALT[0], stem * _SALT[1], w[:-1] * _SALT[2] + w[1:] * _SALT[0], w[:-2] * _SALT[3] + w[2:] * _SALT[1]])
        return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, usable=None, keep: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, the columns to keep, and label of about `most` labelled documents (all, if there are fewer), chosen by a hash of doc_id.

    A doc_id with several labels has the largest. The sampled labels are at most about `most` rows, so they are broadcast.
    """
    own = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    own = (own if usable is None else own.where(usable)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    n = own.count()
    if n > most:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * most / n))
    return docs.select("doc_id", *keep).join(F.broadcast(own), "doc_id")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable=None, most: int = TRAIN_DOCS) -> tuple:
    """Sparse weights (indices, values, bias) fitted in one task on the bounded sample; without labels all weights are 0.

    Texts become hashed features where they are read, so the fitting task gets at most 2**BITS integers a document.
    """

    def features(batches):
        grams = Grams()
        for whole in batches:
            for at in range(0, whole.num_rows, common.SLICE_ROWS):
                batch = whole.slice(at, common.SLICE_ROWS)
                found = [np.unique(grams(text or "")).astype(np.int32) for text in batch.column(1).to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found))), batch.column(2)], names=["doc_id", "x", "label"])

    def fit(batches):
        rows = []
        for batch in batches:
            x, ends = batch.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            rows += [(x[ends[k] : ends[k + 1]].copy(), 1.0, float(label)) for k, label in enumerate(batch.column(2).to_pylist())]
        if rows:
            index, value, bias = Ftrl(BITS, alpha=0.5, l1=4.0).fit(rows, EPOCHS).model()
            yield pa.RecordBatch.from_pydict({"i": [index.tolist()], "w": [value.tolist()], "b": [bias]})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = labelled_sample(own, labels, "toxic", most, usable).mapInArrow(features, "doc_id long, x array<int>, label int")
    got = sample.repartition(1).sortWithinPartitions("doc_id", F.hash("x"), "label").mapInArrow(fit, "i array<long>, w array<double>, b double").first()
    return (got["i"], got["w"], got["b"]) if got else ([], [], 0.0)


def score(spark: SparkSession, docs: DataFrame, model: tuple, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold), one row per input row.

    Whole texts are scored; null and empty ones get the bias alone. Each feature counts once a text, so
    repeated words and lengths do not add up. Other columns are ignored; repeated rows get equal scores, a null
    doc_id stays null, an empty table gives no rows.
    """
    sent = spark.sparkContext.broadcast((np.asarray(model[0], np.int32), np.asarray(model[1], np.float64), model[2]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        (w, bias), grams = dense(sent.value, BITS), Grams()
        for whole in batches:
            for at in range(0, whole.num_rows, common.SLICE_ROWS):
                batch = whole.slice(at, common.SLICE_ROWS)
                out = []
                for text in batch.column(1).to_pylist():
                    index = grams(text or "")
                    out.append(bias + w[np.unique(index[w[index] != 0])].sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(out), -35, 35))))], schema=schema)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
