"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

Both views of every document are turned into sparse features once. Each view learns from a bounded sample of
labelled rows. Then, in each round, all other documents are labelled by both views; what a view is sure of, by
its calibrated probability, trains the other one. A round is one pass over the features: each task goes on
from the models of the round before and the tasks' changes are averaged, weight by weight, over the rows that
moved it. At last both views are calibrated on labelled rows that neither was fitted on, and a logistic
combination of the two scores every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .linear import Ftrl, dense, platt
from .toxicity import labelled_sample

BITS = 18
#: Labelled documents of the training sample at most (about), co-training rounds, and the calibrated probability from which a view is sure.
TRAIN_DOCS, ROUNDS, SURE = 6_000, 3, 0.95
ALPHA, L1, EPOCHS = 0.3, 0.5, 4
#: Columns of the metadata view where docs has them; none is the text.
METADATA = ("lang", "source", "n_chars")
VIEWS = ("content", "meta")
_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_NO_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
_RUN = re.compile(rb"([a-zA0])\1+")


def capitals(text: str) -> int:
    """Upper-case letters of the whole text."""
    return len(text.encode().translate(None, _NO_CAPITALS)) if text.isascii() else sum(map(str.isupper, text))


class Content:
    """Hashed token shapes of a whole text, as shares of its tokens, with how much it repeats words and lines and its size."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.names = limit, {}

        class Shapes(dict):
            def __missing__(shapes, token):
                shape = _RUN.sub(rb"\1\1", token.translate(_SHAPE))
                found = shapes[token] = self.names.setdefault(shape, len(self.names))
                return found

        self.shapes = Shapes()
        self.words, self.known = common.WordHashes(limit=200_000, seed=9), []

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.encode().split()
        if not tokens:
            return np.array([0], np.int32), np.array([1.0])
        if len(self.shapes) > self.limit:
            self.shapes.clear()
            self.names.clear()
            self.known = []
        counted = Counter(tokens)
        n = len(tokens)
        at = np.fromiter(map(self.shapes.__getitem__, counted), np.int64, len(counted))
        sizes = np.fromiter(counted.values(), np.float64, len(counted))
        counts = np.bincount(at, sizes)
        used = np.flatnonzero(counts)
        if len(self.known) < len(self.names):
            self.known = list(self.names)
        shapes = {self.known[k]: counts[k] for k in used}
        # How much of the text its commonest words make up tells repeated words from prose.
        top = np.sort(sizes)[-max(1, n // 50) :].sum() / n
        lines = text.split("\n")
        step = lambda x: int(2 * math.log2(1 + x))
        marks = (b"distinct%d" % int(10 * len(counted) / n), b"top%d" % int(10 * top), b"size%d" % int(math.log2(n)), b"lines%d" % step(len(lines)), b"line%d" % step(len(text) / len(lines)), b"again%d" % int(10 * len(set(lines)) / len(lines)), b"upper%d" % int(20 * capitals(text) / len(text)))
        extra = {b"\x00" + m: 1.0 for m in marks}
        names = [*shapes, *extra]
        value = np.array([*(math.sqrt(k / n) for k in shapes.values()), *extra.values()])
        index = (self.words(names) >> np.uint64(64 - BITS)).astype(np.int32)
        index, at = np.unique(index, return_inverse=True)
        return index, np.bincount(at, value)


def metadata(docs: DataFrame, columns: tuple[str, ...] = METADATA) -> Column:
    """Hashed metadata fields (positions below 2**BITS): each column's value, numbers in steps, and pairs of columns; a null is a value of its own."""
    kinds, fields = dict(docs.dtypes), []
    for c in columns:
        if c in kinds:
            number = kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")
            value = F.floor(2 * F.log2(1 + F.abs(F.col(c)))).cast("string") if number else F.col(c).cast("string")
            fields.append(F.concat(F.lit(f"{c}="), F.coalesce(value, F.lit("\x00"))))
    pairs = [F.concat_ws("\x01", fields[i], fields[j]) for i in range(len(fields)) for j in range(i)]
    return F.array_sort(F.array_distinct(F.array(*[F.shiftrightunsigned(F.xxhash64(f), 64 - BITS).cast("int") for f in (*fields, *pairs)]))).cast("array<int>") if fields else F.array().cast("array<int>")


_FEATURES = "doc_id long, row long, ci array<int>, cv array<float>, mi array<int>"


def features(docs: DataFrame, columns: tuple[str, ...] = METADATA) -> DataFrame:
    """One row per input row: doc_id, row (common.row_key), ci and cv (features of the whole text and their values), mi (features of the metadata)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("ci", pa.list_(pa.int32())), ("cv", pa.list_(pa.float32())), ("mi", pa.list_(pa.int32()))])

    def run(batches):
        content = Content()
        for whole in batches:
            for at in range(0, whole.num_rows, common.SLICE_ROWS):
                batch = whole.slice(at, common.SLICE_ROWS)
                found = [content(t.decode("utf-8", "replace")) for t in batch.column(2).to_pylist()]
                ends = pa.array(np.cumsum([0, *[len(x) for x, _ in found]]), pa.int32())
                index, value = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                meta = batch.column(3)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(meta.value_lengths().to_numpy(zero_copy_only=False))]), pa.int32()), meta.flatten().cast(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(ends, pa.array(index, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value, pa.float32())), lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key().alias("row"), common.text_bytes().alias("b"), metadata(docs, columns).alias("mi")).mapInArrow(run, _FEATURES)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's begin and end."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _margins(model: tuple[np.ndarray, float], index: np.ndarray, value, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(model[0][index] * value)])
    return total[ends[1:]] - total[ends[:-1]] + model[1]


def _rows(batch: pa.RecordBatch, first: int):
    """Of the columns ci, cv, mi from `first` on: for each view, indices, values and ends."""
    (ci, ce), (cv, _), (mi, me) = (_lists(batch.column(first + k)) for k in range(3))
    return (ci, cv.astype(np.float64), ce), (mi, np.ones(len(mi)), me)


class View:
    """The state of a view's learner as it goes from round to round, and its calibration."""

    def __init__(self):
        self.learner, self.curve = Ftrl(BITS, alpha=ALPHA, l1=L1), (1.0, 0.0)

    def pack(self) -> tuple:
        used = np.flatnonzero(self.learner.n)
        return used, self.learner.z[used], self.learner.n[used], self.learner.z0, self.learner.n0, self.curve

    @classmethod
    def unpack(cls, state: tuple) -> View:
        out = cls()
        used, out.learner.z[state[0]], out.learner.n[state[0]], out.learner.z0, out.learner.n0, out.curve = state[0], state[1], state[2], state[3], state[4], state[5]
        return out

    def weights(self) -> tuple[np.ndarray, float]:
        return dense(self.learner.model(), BITS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _calibrated(views: list[View], held: list) -> np.ndarray:
    """Sets the views' curves from the held-out rows; their calibrated logits, a column a view."""
    y, logits = np.array([float(r[2]) for r in held]), []
    for v, view in enumerate(views):
        w = view.weights()
        margin = np.array([w[1] + float(np.sum(w[0][r[v][0]] * r[v][1])) for r in held])
        view.curve = platt(margin, y) if len(held) else (1.0, 0.0)
        logits.append(view.curve[0] * margin + view.curve[1])
    return np.stack(logits, axis=1)


def learn(rows: list[tuple]) -> list[View]:
    """Both views, fitted on three of four labelled rows (content, metadata, label) and calibrated on the others."""
    held, fit = rows[::4], [r for k, r in enumerate(rows) if k % 4]
    views = [View(), View()]
    for v, view in enumerate(views):
        view.learner.fit([(r[v][0], r[v][1], float(r[2])) for r in fit], EPOCHS, v)
    _calibrated(views, held)
    return views


def _combine(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of both calibrated logits and an offset (ridge logistic regression)."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0, 0.0
    x = np.concatenate([np.clip(x, -20, 20), np.ones((len(x), 1))], axis=1)
    t = np.array([0.5, 0.5, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (p - y) + 0.1 * (t - [0.5, 0.5, 0]))
        t -= step
    return tuple(map(float, t))


def _in_one_task(sample: DataFrame, work) -> list:
    """work(rows) of the labelled sample (bounded), in the order of doc_id; its pickled result."""
    import pickle

    def run(batches):
        rows = []
        for batch in batches:
            (ci, cv, ce), (mi, mv, me) = _rows(batch, 1)
            for k, label in enumerate(batch.column(4).to_pylist()):
                rows.append(((ci[ce[k] : ce[k + 1]].copy(), cv[ce[k] : ce[k + 1]].copy()), (mi[me[k] : me[k + 1]].copy(), mv[me[k] : me[k + 1]].copy()), label))
        if rows:
            yield pa.RecordBatch.from_pydict({"out": [pickle.dumps(work(rows))]})

    got = sample.repartition(1).sortWithinPartitions("doc_id", F.hash("ci", "cv"), "label").mapInArrow(run, "out binary").first()
    return pickle.loads(got["out"]) if got else None


def _round(spark: SparkSession, free: DataFrame, views: list[View]) -> tuple[list[View], list[int]]:
    """The views after all unlabelled documents have been labelled once, and how many rows each view was sure of."""
    sent = spark.sparkContext.broadcast([v.pack() for v in views])  # at most 2**BITS weights a view

    def run(batches):
        now, own = [View.unpack(x) for x in sent.value], [View.unpack(x) for x in sent.value]
        weights, rows = [v.weights() for v in now], [np.zeros((1 << BITS) + 1) for _ in now]
        for batch in batches:
            data = _rows(batch, 1)
            sure = []
            for v in (0, 1):
                p = _sigmoid(now[v].curve[0] * _margins(weights[v], *data[v]) + now[v].curve[1])
                sure.append(np.where(p >= SURE, 1.0, np.where(p <= 1 - SURE, 0.0, np.nan)))
            for v in (0, 1):
                index, value, ends = data[1 - v]
                # A row of which both are sure, but not alike, teaches nobody.
                teach = ~np.isnan(sure[v]) & (np.isnan(sure[1 - v]) | (sure[v] == sure[1 - v]))
                for k in np.flatnonzero(teach):
                    at = index[ends[k] : ends[k + 1]]
                    own[1 - v].learner.step(at, value[ends[k] : ends[k + 1]], sure[v][k])
                    rows[1 - v][at] += 1
                    rows[1 - v][-1] += 1
        for v in (0, 1):
            moved = np.flatnonzero(rows[v])
            if not len(moved):
                continue
            z = np.append(own[v].learner.z - now[v].learner.z, own[v].learner.z0 - now[v].learner.z0)
            n = np.append(own[v].learner.n - now[v].learner.n, own[v].learner.n0 - now[v].learner.n0)
            for s in range(0, len(moved), 20_000):
                at = moved[s : s + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v), pa.int32()), pa.array(at, pa.int32()), *[pa.array(x) for x in (z[at] * rows[v][at], n[at] * rows[v][at], rows[v][at])]], names=["view", "at", "z", "n", "k"])

    moved = free.select("doc_id", "ci", "cv", "mi").mapInArrow(run, "view int, at int, z double, n double, k double")
    # At most a row for each weight of both views comes back.
    got = moved.groupBy("view", "at").agg(F.sum("z").alias("z"), F.sum("n").alias("n"), F.sum("k").alias("k")).toArrow()
    sent.unpersist()
    view, at, z, n, k = (got.column(c).to_numpy() for c in ("view", "at", "z", "n", "k"))
    out, counts = [View.unpack(v.pack()) for v in views], []
    for v in (0, 1):
        mine = view == v
        i, dz, dn = at[mine], z[mine] / k[mine], n[mine] / k[mine]
        bias = i == 1 << BITS
        counts.append(int(k[mine][bias].sum()))
        out[v].learner.z[i[~bias]] += dz[~bias]
        out[v].learner.n[i[~bias]] += dn[~bias]
        out[v].learner.z0 += float(dz[bias].sum())
        out[v].learner.n0 += float(dn[bias].sum())
    return out, counts[::-1]


def train_on(spark: SparkSession, feats: DataFrame, labels: DataFrame, usable: Column | None = None, rounds: int = ROUNDS) -> dict:
    """The model from features() (written, as they are read once a round), fitted on about TRAIN_DOCS labelled rows and on all unlabelled ones.

    usable: the rows whose labels may be used. A document with a label, usable or not, is never pseudo-labelled.
    Without labels every score is 0.5.
    """
    sample = labelled_sample(feats, labels, "quality", TRAIN_DOCS, usable, ("ci", "cv", "mi"))
    sample = common.cut(spark, sample.select("doc_id", "ci", "cv", "mi", "label"), "quality-sample")
    views = _in_one_task(sample, learn)
    if views is None:
        return {"content": ([], []), "meta": ([], []), "rest": [0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.5, 0.5, 0.0], "sure": []}
    known = labels.where("quality is not null and doc_id is not null").select("doc_id").distinct()
    free = feats.join(known, "doc_id", "left_anti")
    sure = []
    for _ in range(rounds):
        views, counts = _round(spark, free, views)
        sure.append(counts)
        if not any(counts):
            break
        states = [v.pack() for v in views]

        def again(rows, states=states):
            now = [View.unpack(x) for x in states]
            _calibrated(now, rows[::4])
            return [v.curve for v in now]

        for view, curve in zip(views, _in_one_task(sample, again)):
            view.curve = curve
    states = [v.pack() for v in views]

    def finish(rows):
        now = [View.unpack(x) for x in states]
        held = rows[::4]
        return _combine(_calibrated(now, held), np.array([float(r[2]) for r in held]))

    mix, out = _in_one_task(sample, finish), {"sure": sure}
    weights = [v.weights() for v in views]
    for name, (w, _) in zip(VIEWS, weights):
        index = np.flatnonzero(w)
        out[name] = (index, w[index])
    out["rest"] = [weights[0][1], weights[1][1], *views[0].curve, *views[1].curve, *mix]
    return out


def score_on(spark: SparkSession, feats: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """score() from features()."""
    sent = spark.sparkContext.broadcast({k: model[k] for k in (*VIEWS, "rest")})
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), *[(c, pa.float64()) for c in ("content_score", "meta_score", "score")]])

    def run(batches):
        m = sent.value
        rest = m["rest"]
        views = [dense((*m[name], rest[v]), BITS) for v, name in enumerate(VIEWS)]
        for batch in batches:
            logit = np.stack([_margins(w, *x) for w, x in zip(views, _rows(batch, 2))], axis=1)
            logit = np.clip(logit * [rest[2], rest[4]] + [rest[3], rest[5]], -20, 20)
            p = _sigmoid(np.concatenate([logit, (logit @ np.array(rest[6:8]) + rest[8])[:, None]], axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(3)]], schema=schema)

    scored = feats.select("doc_id", "row", "ci", "cv", "mi").mapInArrow(run, "doc_id long, row long, content_score double, meta_score double, score double")
    return scored.withColumn("keep", F.col("score") >= threshold)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column | None = None, rounds: int = ROUNDS) -> dict:
    """train_on() with the features of docs written first."""
    return train_on(spark, common.cut(spark, features(docs), "quality-features"), labels, usable, rounds)


def score(spark: SparkSession, docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, row (common.row_key), content_score, meta_score, score, keep (score >= threshold): one row per input row.

    All whole texts are scored; null texts count as empty, a null language or source is a value of its own.
    Columns of the metadata that docs lacks are left out; other columns are ignored. Repeated rows get equal
    scores, a null doc_id stays null, an empty table gives no rows. Without labels every score is 0.5.
    """
    return score_on(spark, features(docs), model, threshold)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """score() of docs by the model trained on them: each text is read once."""
    feats = common.cut(spark, features(docs), "quality-features")
    return score_on(spark, feats, train_on(spark, feats, labels, usable), threshold)
