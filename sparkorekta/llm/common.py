"""Helpers shared by the operators: scratch tables, text access, connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import spread

#: Folders made by this driver, newest last; removed at exit or by drop_scratch().
_made: list[str] = []
_fallback: list[str] = []

#: Rows of an Arrow batch handled at once, so that long texts do not pile up as Python objects.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one of a few megabytes a core is dealt over all cores, as it may be one row group."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), 4 << 20)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary one where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors on other machines would not see a folder of the driver's")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="sparkorekta-"))
        atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
    return f"file://{_fallback[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root (not yet created)."""
    path = f"{shared_root(spark)}/sparkorekta-{uuid.uuid4().hex[:12]}-{name}"
    _made.append(path)
    return path


def scratch_mark() -> int:
    return len(_made)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch folders whose readers have ended."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _made:
            _made.remove(path)


def made_since(mark: int) -> list[str]:
    return _made[mark:]


@atexit.register
def _remove_local() -> None:
    for path in _made:
        if path.startswith(("file:", "/")):
            shutil.rmtree(local_path(path), ignore_errors=True)


def local_path(uri: str) -> str:
    """The file path of a shared folder that every worker mounts."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: this operator keeps memory-mapped or archive files; spark.checkpoint.dir must be a folder that all workers mount (file:)")
    return unquote(parts.path) if parts.scheme else uri


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors cost no recomputation."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, rows: int, per: int, least: int = 1) -> int:
    return max(least, -(-rows // per))


def text_bytes(col: str = "text"):
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """A 64-bit key of a row's id and text (null and empty texts count alike), for rows whose ids repeat or are null."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def let(value, then):
    """then(value) with value computed once: Catalyst would copy the expression to each place that uses it, into lambdas too."""
    return F.get(F.transform(F.array(value), then), 0)


def once(df: DataFrame, name: str, value) -> DataFrame:
    """df with a column that is computed once a row: a generator of one row, into which no later operator is folded."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def replace_file(tmp: str, path: str) -> None:
    """Commits a finished temporary file under its final name; a repeated task overwrites equal bytes."""
    with open(tmp, "rb+") as f:
        os.fsync(f.fileno())
    os.replace(tmp, path)


def components(spark: SparkSession, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: columns a, b (long); loops, nulls and repeats are ignored. Returns node, component (the
    smallest node reachable) for every node with an edge. A hub's neighbours are never gathered in one
    task: minima are map-side aggregates and the joins can be split by AQE. Each round is written to the
    shared folder; the number of rounds is logarithmic in the longest chain.
    """
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen, old = cut(spark, start, name), None, []
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mark = scratch_mark()
        large = cut(spark, large, name)
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(spark, small.union(low2.select("u", F.col("m").alias("v"))).distinct(), name)
        drop_scratch(spark, old)
        old = made_since(mark)
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(n: int):
    """A union-find over 0..n-1 whose unions are numpy arrays of pairs; returns (labels, unite)."""
    label = np.arange(n)

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        while len(a):
            la, lb = label[a], label[b]
            open_ = la != lb
            if not open_.any():
                return
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            np.minimum.at(label, high, low)
            while True:
                nxt = label[label]
                if np.array_equal(nxt, label):
                    break
                label = nxt

    return (lambda: label), unite


M64 = (1 << 64) - 1
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _K1
    x = x ^ (x >> np.uint64(27))
    x = x * _K2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words (bytes), each word hashed once while it stays in a bounded cache.

    prefix > 0 adds a second column, the hash of the word's first `prefix` bytes.
    """

    def __init__(self, limit: int = 400_000, seed: int = 7, prefix: int = 0):
        from xxhash import xxh64_intdigest

        self.limit, table = limit, np.empty((1 << 16, 1 + bool(prefix)), np.uint64)
        self.table = table

        class Rows(dict):
            def __missing__(rows, word):
                n = rows[word] = len(rows)
                if n >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[n, 0] = xxh64_intdigest(word, seed)
                if prefix:
                    self.table[n, 1] = xxh64_intdigest(word[:prefix], seed + 1)
                return n

        self.rows = Rows()

    def columns(self, words: list[bytes]) -> np.ndarray:
        if len(self.rows) > self.limit:
            self.rows.clear()
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        return self.table[at]

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return self.columns(words)[:, 0]
