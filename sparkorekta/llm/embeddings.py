"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard, every shard queried, links verified in double precision.

Vectors of one label are dealt into shards of bounded size by a hash of their value; a task builds a shard's
graph and writes it to the shared folder. The vectors of the label are also dealt into blocks of bounded size,
and a block's task queries every shard, whose files it maps one after the other, so a vector is shuffled once
for each SPAN shards of its label. The beam of a search is widened for a query whose beam is full of
neighbours, and for all queries of a shard until an audit of some of them against brute force finds the asked
recall of pairs of different vectors. Found pairs are verified by cosine and united.
"""

from __future__ import annotations

import logging
import math
import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Vectors of a shard (about), of a block of queries, links of a node on upper levels (twice as many on the lowest), beams of building and of first searches.
SHARD_ROWS, BLOCK_ROWS, LINKS, BUILD_BEAM, FIRST_BEAM = 8192, 4096, 12, 48, 48
#: Shards of a label that one task queries with a block.
SPAN = 64
#: An audit compares queries with brute force, so many at a time, until it has seen this many pairs or asked this many queries, and wants this recall of them.
AUDIT_STEP, AUDIT_PAIRS, AUDIT_QUERIES, AUDIT_RECALL = 64, 100, 512, 0.995


class Graph:
    """An HNSW graph over unit vectors (rows of x). Searches run in step for many queries at once."""

    def __init__(self, x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 3):
        self.x = np.ascontiguousarray(x, np.float32)
        n, rnd = len(x), np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rnd.random(n)) / math.log(links)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # upper nodes first: the first node is the entry
        self.entry, self.levels = int(order[0]) if n else 0, []
        top = int(level.max(initial=0))
        self.degree = [2 * links if k == 0 else links for k in range(top + 1)]
        self.near = [np.full((n, d), -1, np.int32) for d in self.degree]
        self.count = [np.zeros(n, np.int64) for _ in self.degree]
        at, batch = 1, 1
        while at < n:  # nodes join in batches no larger than what is linked already
            rows = order[at : at + batch]
            self._join(rows, level[rows], order[:at], beam)
            at += len(rows)
            batch = min(max(1, at // 4), 256)

    def _join(self, rows, level, before, beam):
        for k in range(len(self.near) - 1, -1, -1):
            own = rows[level >= k]
            if not len(own):
                continue
            found, sims = self.search(self.x[own], beam, k)
            # Batch mates can't find each other in the graph, so they are compared directly.
            mates = self.x[own] @ self.x[own].T
            np.fill_diagonal(mates, -2)
            found = np.concatenate([found, np.broadcast_to(own, (len(own), len(own)))], axis=1)
            sims = np.concatenate([sims, mates], axis=1)
            for i, node in enumerate(own):
                self._link(int(node), found[i], sims[i], k)

    def _pick(self, found, sims, most):
        """Diverse neighbours: a candidate nearer to a picked one than to the node comes last."""
        order = np.argsort(-sims, kind="stable")
        order = order[(found[order] >= 0) & (sims[order] > -2)][: 2 * most]
        found, sims = found[order], sims[order]
        between = self.x[found] @ self.x[found].T
        picked, late = [], []
        for k in range(len(found)):
            (picked if not picked or between[k, picked].max() <= sims[k] else late).append(k)
            if len(picked) == most:
                break
        return found[(picked + late)[:most]]

    def _link(self, node, found, sims, k):
        near, count, degree = self.near[k], self.count[k], self.degree[k]
        picked = self._pick(found, sims, degree // 2 if k == 0 else degree)
        old = near[node, : count[node]]
        picked = np.unique(np.concatenate([old, picked]))[:degree] if len(old) else picked
        near[node, : len(picked)], count[node] = picked, len(picked)
        for other in picked.tolist():
            c = count[other]
            if node in near[other, :c]:
                continue
            if c < degree:
                near[other, c], count[other] = node, c + 1
            else:
                both = np.append(near[other], node)
                kept = self._pick(both, self.x[both] @ self.x[other], degree)
                near[other] = -1
                near[other, : len(kept)], count[other] = kept, len(kept)

    def save(self, base: str, **more: np.ndarray) -> None:
        """Writes the graph and more arrays as files base-*.npy, each under a temporary name first."""
        arrays = {"x": self.x, "head": np.array([self.entry, len(self.near)]), **{f"near{k}": a for k, a in enumerate(self.near)}, **more}
        for name, array in arrays.items():
            with open(tmp := f"{base}-{name}.{uuid.uuid4().hex}.tmp", "wb") as f:
                np.save(f, array)
            common.replace_file(tmp, f"{base}-{name}.npy")

    @classmethod
    def load(cls, base: str, *more: str) -> tuple:
        """The graph with mapped arrays, and the other arrays asked for."""
        read = lambda name: np.load(f"{base}-{name}.npy", mmap_mode="r")
        out = cls.__new__(cls)
        out.entry, levels = read("head").tolist()
        out.x, out.near = np.asarray(read("x")), [np.asarray(read(f"near{k}")) for k in range(levels)]
        return out, *map(read, more)

    def search(self, q: np.ndarray, beam: int, lowest: int = 0):
        """Nearest nodes of each query as ids and cosines, best first, -1 where fewer are found (beam columns)."""
        q = np.ascontiguousarray(q, np.float32)
        at = np.full((len(q), 1), self.entry)
        sims = q @ self.x[self.entry][:, None]
        for k in range(len(self.near) - 1, lowest, -1):
            at, sims = self._beam(q, at, sims, k, 1)
        return self._beam(q, at, sims, lowest, beam)

    def _beam(self, q, at, sims, k, beam):
        m, n = len(q), len(self.x)
        seen = np.zeros((m, n), bool)
        seen[np.arange(m)[:, None], at] = True
        ids, best = np.full((m, beam), -1), np.full((m, beam), -2.0, np.float32)
        ids[:, : at.shape[1]], best[:, : at.shape[1]] = at[:, :beam], sims[:, :beam]
        done = np.zeros((m, beam), bool)
        live = np.arange(m)
        wide = 1 if beam < 4 else 4
        while len(live):
            score = np.where(done[live] | (ids[live] < 0), -3.0, best[live])
            pick = np.argpartition(-score, wide - 1, axis=1)[:, :wide] if wide < beam else np.arange(beam)[None, :].repeat(len(live), 0)
            open_ = np.take_along_axis(score, pick, 1) > -3
            go = open_.any(axis=1)
            live, pick, open_ = live[go], pick[go], open_[go]
            if not len(live):
                break
            done[live[:, None], pick] = done[live[:, None], pick] | open_
            nodes = np.where(open_, np.take_along_axis(ids[live], pick, 1), -1)
            near = np.where(nodes[:, :, None] >= 0, self.near[k][nodes], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            found = near[r, c]
            seen[live[r], found] = True
            new = np.full(near.shape, -2.0, np.float32)
            new[r, c] = np.einsum("ij,ij->i", q[live[r]], self.x[found])
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_sims = np.concatenate([best[live], new], axis=1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], best[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
        order = np.argsort(-best, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)


def neighbours(graph: Graph, x: np.ndarray, q: np.ndarray, threshold: float, own: np.ndarray | None = None):
    """Pairs (query, node) with cosine >= threshold in double precision, pairs that the audit knows and of these found.

    x, q: unit vectors in double precision; own: the node that is the query itself, -1 if none is (no pair, and
    not counted). Beams are doubled for queries that end among neighbours, and for all until the audit passes.
    """
    slack = threshold - 1e-4
    beam, own = FIRST_BEAM, np.full(len(q), -1) if own is None else own
    # Queries spread over the block, until enough pairs are known to tell the recall from them.
    spread, audit, true, known = np.random.default_rng(5).permutation(len(q)), [], [], 0
    for s in range(0, min(len(q), AUDIT_QUERIES), AUDIT_STEP):
        some = spread[s : s + AUDIT_STEP]
        r, c = np.nonzero(q[some] @ x.T >= threshold)
        apart = own[some[r]] != c
        audit.append(some)
        true.append(some[r[apart]] * len(x) + c[apart])
        known += int(apart.sum())
        if known >= AUDIT_PAIRS:
            break
    true = np.concatenate(true)
    while True:
        out, todo, width = [], np.arange(len(q)), min(beam, len(x))
        while len(todo):
            again = []
            step = max(16, min(256, 40_000_000 // max(1, len(x) + 40 * width)))
            for s in range(0, len(todo), step):
                rows = todo[s : s + step]
                ids, sims = graph.search(q[rows], width)
                full = (sims[:, -1] >= slack) & (width < len(x))
                again.append(rows[full])
                r, c = np.nonzero((sims >= slack) & (ids >= 0) & ~full[:, None])
                out.append((rows[r], ids[r, c]))
            todo, width = np.concatenate(again), min(4 * width, len(x))
        a, b = (np.concatenate(z) for z in zip(*out))
        keep = (np.einsum("ij,ij->i", q[a], x[b]) >= threshold) & (own[a] != b)
        a, b = a[keep], b[keep]
        got = int(np.isin(true, a * len(x) + b).sum())
        if got >= AUDIT_RECALL * len(true) or beam >= len(x):
            return a, b, len(true), got
        beam *= 2


def _unit(column) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.98, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, span: int = SPAN) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link at a cosine >= threshold if their labels are equal and not null. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing; vectors of different lengths do not link. Equal
    vectors are one class that is searched once and counted as often as it occurs. Rows with equal vec_id are
    counted each. A null vec_id links like any other but names no component: its component is the smallest
    vec_id that is not null among those it reaches, null if there is none. The recall of the audits is logged.
    An empty table gives no rows; other columns are ignored.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False)) & F.col("label").isNotNull()
    v = F.transform("v", lambda c: c + F.lit(0.0))  # -0.0 and 0.0 are equal
    marked = common.cut(spark, own.select("vec_id", F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string")).alias("grp"), F.when(good, v).alias("v"), F.when(good, F.sha2(F.concat_ws(",", F.lit(""), F.col("label").cast("string"), F.transform(v, lambda c: c.cast("string"))), 256)).alias("cls")), "vectors")
    classes = marked.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("grp").alias("grp"), F.first("v").alias("v"))
    # A node is a number of the written row, so that rows without vec_id are nodes of their own.
    classes = common.cut(spark, classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    placed = classes.join(sizes, "grp").withColumn("shard", F.pmod(F.xxhash64("cls"), F.col("shards")).cast("int")).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int")).select("node", "m", "v", "grp", "shard", "shards", "block")
    folder = common.local_path(common.scratch(spark, "hnsw"))
    base = lambda grp, shard: f"{folder}/{uuid.uuid5(uuid.NAMESPACE_OID, grp).hex}-{shard}"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        x, grp, shard = _unit(pdf["v"]), pdf["grp"].iloc[0], int(pdf["shard"].iloc[0])
        os.makedirs(folder, exist_ok=True)
        Graph(x).save(base(grp, shard), unit=x, node=pdf["node"].to_numpy(), m=pdf["m"].to_numpy())
        return pd.DataFrame({"grp": [grp], "shard": [shard]})

    common.cut(spark, placed.groupBy("grp", "shard").applyInPandas(build, "grp string, shard int"), "vector-graphs")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        grp, q, mine = pdf["grp"].iloc[0], _unit(pdf["v"]), pdf["node"].to_numpy()
        first, last = int(pdf["span"].iloc[0]) * span, int(pdf["shards"].iloc[0])
        links, edges, audits = np.zeros(len(pdf), np.int64), [], np.zeros(2, np.int64)
        for shard in range(first, min(first + span, last)):
            graph, x, node, m = Graph.load(base(grp, shard), "unit", "node", "m")
            at = np.minimum(np.searchsorted(node, mine), len(node) - 1)
            a, b, known, got = neighbours(graph, x, q, threshold, np.where(node[at] == mine, at, -1))
            audits += known, got
            np.add.at(links, a, m[b])
            ids, pos = np.unique(np.concatenate([mine[a], node[b]]), return_inverse=True)
            label, unite = common.forest(len(ids))
            unite(pos[: len(a)], pos[len(a) :])
            low = ids[label()]  # a label is the smallest position of its component, and ids are sorted
            edges.append(np.stack([ids, low])[:, ids != low])
        a, b = np.concatenate(edges, axis=1)
        asked = pd.DataFrame({"a": mine, "b": mine, "links": links, "known": 0, "found": 0})
        joined = pd.DataFrame({"a": a, "b": b, "links": 0, "known": 0, "found": 0})
        return pd.concat([asked, joined, pd.DataFrame({"a": mine[:1], "b": mine[:1], "links": 0, "known": audits[:1], "found": audits[1:]})])

    asks = placed.select("node", "v", "grp", "block", "shards", F.explode(F.sequence(F.lit(0), F.floor((F.col("shards") - 1) / span).cast("int"))).alias("span"))
    found = asks.groupBy("grp", "block", "span").applyInPandas(search, "a long, b long, links long, known long, found long")
    found = common.cut(spark, found, "vector-links")
    known, got = found.agg(F.sum("known"), F.sum("found")).first()
    logging.getLogger(__name__).warning("audits: %s of %s pairs of different vectors found", got or 0, known or 0)
    united = common.components(spark, found.where("a <> b").select("a", "b"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    table = classes.select("cls", "rep", "m", "node").join(links, "node", "left").join(united, "node", "left").where("m > 1 or links > 0").withColumn("component", F.coalesce("component", "node"))
    lowest = table.groupBy("component").agg(F.min("rep").alias("component_id"))
    table = table.join(lowest, "component").select(F.col("cls").alias("k"), (F.coalesce("links", F.lit(0).cast("long")) + F.col("m") - 1).alias("n_links"), "component_id")
    out = marked.join(table, marked.cls == table.k, "left")
    # A linked row has the component of its class, which is null only where no vector of it has an id.
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
