"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank (the rank of a bit pattern in the reflected Gray sequence), cut into
groups, and each upper node keeps the bits that its whole group shares (a mask and a pattern). A search
adds up differences from the top: every node contributes only bits that no node above it has counted, and a
group is left as soon as the sum passes the radius.

The top level is made by Spark: groups of equal leading bits, whose Gray ranks are ranges. A fingerprint is
sent to the groups whose leading bits differ from its own in at most `radius` places (one direction of each
pair of groups). Below that, a task holds one group and searches it.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of lower-cased words, repeats included; fewer words: of the whole sequence; none: empty."""
    from xxhash import xxh64_intdigest as xx

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xx(line, 42)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.fromiter((xx(line[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(words) - size + 1)


def signature(h: np.ndarray, lanes: int = 1) -> np.ndarray:
    """lanes x 64 bits: bit i is 1 if set in over half the hashes. Lane 0 takes the hashes as they are, lane k a mixture of them."""
    if not len(h):
        return np.zeros(lanes, np.uint64)
    ones = np.zeros(lanes * 64, np.int64)
    step = 255 * 16
    add = np.arange(lanes, dtype=np.uint64) * np.uint64(GOLDEN)
    for s in range(0, len(h), step):
        x = h[s : s + step, None]
        if lanes > 1:
            x = np.concatenate([x, common.mix64(x + add[None, 1:])], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        if full:
            ones += bits[:full].reshape(-1, 255, lanes * 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if full < len(bits):
            ones += bits[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, size: int = 3, lanes: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp long (lane 0), n long (shingles), wide binary (all lanes; null for one lane). Null texts count as empty: fp 0, n 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("wide", pa.binary())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, common.SLICE_ROWS):
                batch = whole.slice(at, common.SLICE_ROWS)
                fp, n, wide = [], [], []
                for text in batch.column(1).to_pylist():
                    h = shingle_hashes(text, size)
                    if distinct and len(h) > 1:
                        h = np.unique(h)
                    sig = signature(h, lanes)
                    fp.append(int(sig[:1].view(np.int64)[0]))
                    n.append(len(h))
                    wide.append(sig.tobytes() if lanes > 1 else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(wide, pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_bytes(text_col).alias("b")).mapInArrow(run, "doc_id long, fp long, n long, wide binary")


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayTree:
    """The hierarchical index of one group of fingerprints (unsigned 64-bit, any order), or of signatures (rows of several lanes, in the Gray order of the first)."""

    def __init__(self, fps: np.ndarray, fanout: int = 16):
        self.order = np.argsort(gray_rank(fps if fps.ndim == 1 else fps[:, 0]), kind="stable")
        pattern, mask = fps[self.order], np.full(fps.shape, common.M64, np.uint64)
        levels = [(pattern, mask)]
        while len(pattern) > fanout:
            cuts = np.arange(0, len(pattern), fanout)
            one = np.bitwise_and.reduceat(pattern & mask, cuts)
            some = np.bitwise_or.reduceat(pattern, cuts)
            mask = np.bitwise_and.reduceat(mask, cuts) & ~(one ^ some)
            pattern = one & mask
            levels.append((pattern, mask))
        self.fanout, self.levels = fanout, levels[::-1]
        if fps.ndim > 1:
            # By lane: patterns, and the bits that a node's group shares and no node above it has counted.
            above = [np.zeros((1, fps.shape[1]), np.uint64), *[np.repeat(m, fanout, axis=0) for _, m in self.levels[:-1]]]
            self.by_lane = [(np.ascontiguousarray(p.T), np.ascontiguousarray((m & ~up[: len(m)]).T)) for (p, m), up in zip(self.levels, above)]

    def search(self, q: np.ndarray, radius: int):
        """Index pairs (query, member) whose fingerprints differ in at most radius bits."""
        top = len(self.levels[0][0])
        qi, node = np.repeat(np.arange(len(q)), top), np.tile(np.arange(top), len(q))
        diff, above = np.zeros(len(qi), np.uint8), None
        for k, (pattern, mask) in enumerate(self.levels):
            own = mask[node] if above is None else mask[node] & ~above
            diff = diff + np.bitwise_count((q[qi] ^ pattern[node]) & own)
            keep = diff <= radius
            qi, node, diff = qi[keep], node[keep], diff[keep]
            if k + 1 == len(self.levels):
                return qi, self.order[node]
            below = len(self.levels[k + 1][0])
            above = np.repeat(mask[node], self.fanout)
            node = (node[:, None] * self.fanout + np.arange(self.fanout)[None, :]).ravel()
            qi, diff = np.repeat(qi, self.fanout), np.repeat(diff, self.fanout)
            there = node < below
            qi, node, diff, above = qi[there], node[there], diff[there], above[there]
        return qi, node


    def near(self, q: np.ndarray, radius: int):
        """search() for signatures of several lanes; queries should lie near each other, as a group is left when the last of them leaves it.

        A node's bits are added by lanes. Among single signatures most sums pass the radius long before the
        last lane; the pairs that are left then are followed one by one.
        """
        q = np.ascontiguousarray(q.T)
        node = np.arange(len(self.levels[0][0]))
        diff = np.zeros((q.shape[1], len(node)), np.int16)
        for k, (pattern, own) in enumerate(self.by_lane):
            last = k + 1 == len(self.by_lane)
            for lane in range(0, len(q), 3):
                # Three lanes differ in at most 192 bits, which a byte holds.
                more = np.zeros(diff.shape, np.uint8)
                for one in range(lane, min(lane + 3, len(q))):
                    bits = own[one, node]
                    if bits.any():
                        apart = q[one][:, None] ^ pattern[one, node]
                        apart &= bits
                        more += np.bitwise_count(apart)
                diff += more
                if last and (lane or lane + 3 >= len(q)):
                    keep = diff <= radius
                    if lane + 3 >= len(q) or np.count_nonzero(keep) * 16 < keep.size:
                        qi, at = np.nonzero(keep)
                        at, sums = node[at], diff[qi, at]
                        for one in range(lane + 3, len(q)):
                            sums = sums + np.bitwise_count((q[one, qi] ^ pattern[one, at]) & own[one, at])
                            keep = sums <= radius
                            qi, at, sums = qi[keep], at[keep], sums[keep]
                        return qi, self.order[at]
            keep = (diff <= radius).any(axis=0)
            child = (node[keep][:, None] * self.fanout + np.arange(self.fanout)).ravel()
            there = child < len(self.levels[k + 1][0])
            node, diff = child[there], np.repeat(diff[:, keep], self.fanout, axis=1)[:, there]


def _star(ids: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    """A row for each linked id: it and the smallest id of its local component."""
    inv = label
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, inv, ids)
    a, b = ids, low[inv]
    keep = a != b
    return pd.DataFrame({"a": a[keep], "b": b[keep]})


def _prefix_masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << k for k in c) for d in range(min(radius, bits) + 1) for c in combinations(range(bits), d)]


def link(spark: SparkSession, fps: DataFrame, radius: int = 2, group_rows: int = 4096, step: int = 4) -> DataFrame:
    """Edges a, b that join the same fingerprints as all pairs within radius do (a spanning forest of each task's pairs).

    fps: rep long, fp long, distinct fps. A group of equal leading bits with over twice group_rows members is
    split by `step` more bits, and again, so no group grows with the data; a fingerprint follows into those parts
    whose leading bits still differ from its own in at most radius places.
    """
    n = fps.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / group_rows)))
    prefix = lambda d: F.shiftrightunsigned("fp", 64 - d) if d else F.lit(0).cast("long")
    index = fps.select("rep", "fp", prefix(bits).alias("grp"))
    masks = F.array(*[F.lit(m).cast("long") for m in _prefix_masks(bits, radius)])
    # Of two groups the fingerprints of the one with smaller leading bits visit the other.
    queries = fps.select("rep", "fp", prefix(bits).alias("own")).select("rep", "fp", "own", F.explode(F.filter(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m)), lambda g: g >= F.col("own"))).alias("grp"))
    queries = queries.select("rep", "fp", "grp", F.bit_count(F.col("grp").bitwiseXOR(F.col("own"))).alias("used"))
    rows = []
    while True:
        big = index.groupBy("grp").agg(F.count("*").alias("m")).where(F.col("m") > 2 * group_rows).select("grp")
        last = bits > 58 or (big := common.cut(spark, big, "simhash-crowded")).isEmpty()
        few, asks = (index, queries) if last else (index.join(big, "grp", "left_anti"), queries.join(big, "grp", "left_anti"))
        rows += [few.select("rep", "fp", "grp", F.lit(0).alias("kind"), F.lit(bits).alias("depth")), asks.select("rep", "fp", "grp", F.lit(1).alias("kind"), F.lit(bits).alias("depth"))]
        if last:
            break
        bits += step
        index = index.join(big, "grp", "left_semi").select("rep", "fp", prefix(bits).alias("grp"))
        low = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("d")) for m in _prefix_masks(step, radius)])
        deeper = F.transform(F.filter(low, lambda x: x.d + F.col("used") <= radius), lambda x: F.struct(F.shiftleft("grp", step).bitwiseOR(prefix(bits).bitwiseAND(F.lit((1 << step) - 1).cast("long")).bitwiseXOR(x.m)).alias("g"), (x.d + F.col("used")).alias("used")))
        queries = queries.join(big, "grp", "left_semi").select("rep", "fp", F.explode(deeper).alias("x")).where(F.col("x.g") >= prefix(bits)).select("rep", "fp", F.col("x.g").alias("grp"), "x.used")
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, rep, kind = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy(), pdf["kind"].to_numpy()
        members, asks = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        ids, inv = np.unique(rep, return_inverse=True)
        label, unite = common.forest(len(ids))
        tree = GrayTree(fp[members])
        for s in range(0, len(asks), 256):
            some = asks[s : s + 256]
            q, m = tree.search(fp[some], radius)
            unite(inv[some[q]], inv[members[m]])
        return _star(ids, label())

    return both.groupBy("depth", "grp").applyInPandas(search, "a long, b long")


def classes(spark: SparkSession, marks: DataFrame, key: str) -> DataFrame:
    """A row for each distinct key: key, rep (smallest doc_id), m (rows)."""
    return marks.groupBy(key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"), F.first("fp").alias("fp0"), F.first("n").alias("n"))


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fp long, component_id (smallest doc_id reachable over links of at most radius differing bits).

    Words are lower-cased (A-Z) and cut at ASCII white space; null and empty texts have fingerprint 0 and link
    like any other. Rows with equal doc_id count as one node; a null doc_id gets the component of its
    fingerprint, null if it has none. Other columns of docs are ignored. An empty table gives no rows.
    """
    marks = common.cut(spark, fingerprints(docs, size).select("doc_id", "fp", "n"), "simhash")
    groups = common.cut(spark, classes(spark, marks, "fp").select("fp", "rep", "m"), "simhash-groups")
    nodes = groups.where("rep is not null")
    found = common.components(spark, link(spark, nodes.select("rep", "fp"), radius))
    linked = nodes.join(found, nodes.rep == found.node, "left").where("m > 1 or component is not null")
    same_id = _shared_ids(spark, marks, linked)
    linked = linked.select(F.col("fp").alias("k"), F.coalesce("component", "rep").alias("component_id"))
    out = marks.join(linked, marks.fp == linked.k, "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out if same_id is None else out.join(same_id, "component_id", "left").select("doc_id", "fp", F.coalesce("root", "component_id").alias("component_id"))


def _shared_ids(spark: SparkSession, marks: DataFrame, linked: DataFrame) -> DataFrame | None:
    """Components to unite because rows of one doc_id lie in both; None where doc_ids are unique."""
    twice = marks.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null")
    if twice.isEmpty():
        return None
    own = marks.join(twice.select("doc_id"), "doc_id", "left_semi").join(linked.select("fp", F.coalesce("component", "rep").alias("c")), "fp", "left")
    edges = own.select(F.col("doc_id").alias("a"), F.coalesce("c", "doc_id").alias("b")).distinct()
    return common.components(spark, edges).select(F.col("node").alias("component_id"), F.col("component").alias("root"))


def jaccard_bits(threshold: float, lanes: int) -> int:
    """The most differing bits at which sets of equal size still have an estimated Jaccard similarity of threshold."""
    return int(math.acos(2 * threshold / (1 + threshold)) / math.pi * 64 * lanes)


def _tables(rows: int, threshold: float, bits_all: int, group_rows: int, miss: float) -> tuple[int, int]:
    """Leading bits and number of tables for a window of so many signatures: groups of about group_rows, and at most
    a part `miss` of the pairs at the threshold agrees on the leading bits of no table."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / group_rows)))
    agree = 1 - math.acos(2 * threshold / (1 + threshold)) / math.pi
    return (bits, math.ceil(math.log(miss) / math.log(1 - agree**bits))) if bits else (0, 1)


def _table_bits(tables: int, bits: int, bits_all: int) -> np.ndarray:
    """tables x bits positions in the signature; no position is used twice before all are used."""
    rounds = -(-tables * bits // bits_all)
    return np.concatenate([np.random.default_rng(k).permutation(bits_all) for k in range(max(1, rounds))])[: tables * bits].reshape(tables, bits)


class Sets:
    """Sorted shingle hashes of documents in files of a shared folder, mapped by the workers; a set is known by file, offset and size."""

    def __init__(self, folder: str):
        self.folder, self.open = folder, {}

    def map(self, name, kind=np.uint64) -> np.ndarray:
        if name not in self.open:
            path = f"{self.folder}/{name}"
            self.open[name] = np.memmap(path, kind, "r").view(np.ndarray) if os.path.getsize(path) else np.empty(0, kind)
        return self.open[name]

    def get(self, file: int, off: int, n: int) -> np.ndarray:
        return self.map(int(file))[off : off + n]

    def similar(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the sets at rows a and b of `at` (file, offset, size) have a Jaccard similarity of threshold, exactly."""
        out = np.empty(len(a), bool)
        for k, (i, j) in enumerate(zip(a, b)):
            x, y = self.get(*at[i]), self.get(*at[j])
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            out[k] = both + 1e-9 >= threshold * (len(x) + len(y) - both)
        return out


def _verify(sets: Sets, at: np.ndarray, a: np.ndarray, b: np.ndarray, node: np.ndarray, label, unite, threshold: float, chunk: int = 2048) -> None:
    """Unites the nodes of the pairs (rows a, b) that are similar; pairs whose nodes others have joined are not read."""
    while len(a):
        apart = label()[node[a]] != label()[node[b]]
        a, b = a[apart], b[apart]
        some, other = a[:chunk], b[:chunk]
        near = sets.similar(at, some, other, threshold)
        unite(node[some[near]], node[other[near]])
        a, b = a[chunk:], b[chunk:]


def shingle_sets(docs: DataFrame, folder: str, size: int, lanes: int) -> DataFrame:
    """doc_id, row (common.row_key), key (digest of the shingle set), fp, n (distinct shingles), wide, file, off: where the sorted set stands under folder."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("key", pa.binary()), ("fp", pa.int64()), ("n", pa.int64()), ("wide", pa.binary()), ("file", pa.int64()), ("off", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        # A repeated task writes a file of its own, so rows and file always belong together.
        os.makedirs(folder, exist_ok=True)
        file, off = TaskContext.get().taskAttemptId(), 0
        with open(f"{folder}/{file}", "wb") as out:
            for whole in batches:
                for first in range(0, whole.num_rows, common.SLICE_ROWS):
                    batch = whole.slice(first, common.SLICE_ROWS)
                    rows = []
                    for text in batch.column(2).to_pylist():
                        h = np.unique(shingle_hashes(text, size))
                        sig, raw = signature(h, lanes), h.tobytes()
                        rows.append((hashlib.blake2b(raw, digest_size=16).digest(), int(sig[:1].view(np.int64)[0]), len(h), sig.tobytes(), file, off))
                        out.write(raw)
                        off += len(h)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[2:])]], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key().alias("row"), common.text_bytes("text").alias("b")).mapInArrow(run, "doc_id long, row long, key binary, fp long, n long, wide binary, file long, off long")


def _shared_shingles(nodes: DataFrame, folder: str, bits: int) -> None:
    """Writes the shingles that two sets or more hold: sorted hashes and counts, a file for each of 2**bits ranges of hashes."""

    def shard_of(h):
        return h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64)

    def count(batches):
        sets = Sets(folder)

        def packed(held):
            h, c = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(shard_of(h), np.arange((1 << bits) + 1))
            full = [k for k in range(1 << bits) if cuts[k] < cuts[k + 1]]
            parts = [(k, h[cuts[k] : cuts[k + 1]].tobytes(), c[cuts[k] : cuts[k + 1]].astype(np.uint32).tobytes()) for k in full]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts), (pa.int32(), pa.binary(), pa.binary()))], names=["shard", "h", "c"])

        held, size = [], 0
        for batch in batches:
            for where in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                held.append(sets.get(*where))
                size += where[2]
                if size > 1_000_000:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        h, at = np.unique(np.frombuffer(b"".join(pdf["h"]), np.uint64), return_inverse=True)
        c = np.bincount(at, np.frombuffer(b"".join(pdf["c"]), np.uint32)).astype(np.int64)
        for name, values in ((f"h{shard}", h[c > 1]), (f"c{shard}", c[c > 1])):
            tmp = f"{folder}/{name}-{uuid.uuid4().hex}"
            values.tofile(tmp)
            common.replace_file(tmp, f"{folder}/{name}")
        return pd.DataFrame({"shard": [shard]})

    nodes.select("file", "off", "n").mapInArrow(count, "shard int, h binary, c binary").groupBy("shard").applyInPandas(merge, "shard int").count()


def _prefix_rows(nodes: DataFrame, folder: str, bits: int, threshold: float) -> DataFrame:
    """key, pos, comp, n, file, off: the shingles of each set's prefix that another set holds too, and their positions.

    In one order of all shingles (rarest first), sets with a similarity of the threshold share one of their first
    n - ceil(threshold n) + 1; a shingle of one set alone matches nothing.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("key", "pos", "comp", "n", "file", "off")])

    def run(batches):
        sets = Sets(folder)

        def rows(docs):
            h = np.concatenate([sets.get(*d[:3]) for d in docs])
            order = np.argsort(h)
            sorted_, c = h[order], np.zeros(len(h), np.int64)
            shard = sorted_ >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64)
            cuts = np.searchsorted(shard, np.arange((1 << bits) + 1))
            for k in range(1 << bits):
                if cuts[k] < cuts[k + 1] and os.path.exists(f"{folder}/h{k}") and len(known := sets.map(f"h{k}")):
                    q = sorted_[cuts[k] : cuts[k + 1]]
                    at = np.minimum(np.searchsorted(known, q), len(known) - 1)
                    c[order[cuts[k] : cuts[k + 1]]] = np.where(known[at] == q, sets.map(f"c{k}", np.int64)[at], 0)
            start, out = 0, []
            for file, off, n, comp in docs:
                own, count = h[start : start + n], c[start : start + n]
                start += n
                prefix, single = n - math.ceil(threshold * n - 1e-9) + 1, int((count == 0).sum())
                if single < prefix:
                    first = np.lexsort((own, count))[single:prefix]
                    out.append(np.stack([own[first].view(np.int64), np.arange(single, single + len(first)), *[np.full(len(first), x) for x in (comp, n, file, off)]]))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], schema=schema) if out else None

        held, size = [], 0
        for batch in batches:
            for d in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                held.append(d)
                size += d[2]
                if size > 500_000:
                    if (found := rows(held)) is not None:
                        yield found
                    held, size = [], 0
        if held and (found := rows(held)) is not None:
            yield found

    return nodes.select("file", "off", "n", "comp").mapInArrow(run, "key long, pos long, comp long, n long, file long, off long")


def prefix_links(spark: SparkSession, nodes: DataFrame, folder: str, threshold: float, shard_shingles: int = 2_000_000, crowd: int = 16_384, bucket_rows: int = 20_000) -> DataFrame:
    """Edges a, b that join all components (comp) of which two sets have an exact Jaccard similarity >= threshold.

    nodes: comp, n, file, off. An exact join: whatever shares a shingle of its prefix meets, unless one component
    already holds all of that shingle's sets, and is ruled out only by size, position or the sets themselves.
    """
    bits = max(0, math.ceil(math.log2(max(1, (nodes.agg(F.sum("n")).first()[0] or 0) / shard_shingles))))
    _shared_shingles(nodes, folder, bits)
    rows = common.cut(spark, _prefix_rows(nodes, folder, bits, threshold), "prefixes")
    open_ = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c")).where("low < high").select("key", F.when(F.col("c") > crowd, F.ceil(F.col("c") / (crowd // 2))).otherwise(1).cast("int").alias("parts"))
    rows = common.cut(spark, rows.join(open_, "key"), "prefixes-open")
    buckets = max(1, rows.count() // bucket_rows)
    # A crowded shingle's sets are cut into blocks; a cell holds one block or two, of which then only pairs across them are compared.
    own = F.pmod(F.xxhash64("file", "off"), F.col("parts")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(k, own) * F.col("parts") + F.greatest(k, own))
    rows = rows.withColumn("block", own).withColumn("cell", F.explode(every))
    rows = rows.withColumn("bucket", F.when(F.col("parts") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        key, pos, n, block = (pdf[c].to_numpy() for c in ("key", "pos", "n", "block"))
        across = (pdf["cell"] // pdf["parts"] != pdf["cell"] % pdf["parts"]).to_numpy()
        ids, node = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        at, sets = pdf[["file", "off", "n"]].to_numpy(), Sets(folder)
        label, unite = common.forest(len(ids))
        held, size = [], 0
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            step = max(1, 1_000_000 // (hi - lo))
            for s in range(lo, hi, step):
                a, b = np.meshgrid(np.arange(s, min(hi, s + step)), np.arange(s + 1, hi), indexing="ij")
                a, b = a.ravel(), b.ravel()
                # Overlap at most: what stands from this shingle on, and before it as many as either has.
                most = np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b])
                keep = (b > a) & (label()[node[a]] != label()[node[b]]) & (most + 1e-6 >= threshold / (1 + threshold) * (n[a] + n[b]))
                keep &= np.minimum(n[a], n[b]) + 1e-6 >= threshold * np.maximum(n[a], n[b])
                keep &= ~across[a] | (block[a] != block[b])
                held.append((a[keep], b[keep]))
                size += int(keep.sum())
                if size > 200_000:
                    _verify(sets, at, *map(np.concatenate, zip(*held)), node, label, unite, threshold)
                    held, size = [], 0
        if held:
            _verify(sets, at, *map(np.concatenate, zip(*held)), node, label, unite, threshold)
        return _star(ids, label())

    return rows.groupBy("bucket", "cell").applyInPandas(search, "a long, b long")


def similar_groups(spark: SparkSession, docs: DataFrame, size: int = 5, threshold: float = 0.8, lanes: int = 16, group_rows: int = 4096, miss: float = 0.002, slack: float = 0.02) -> DataFrame:
    """doc_id, row, component_id, cluster: groups joined by Jaccard similarity >= threshold of their sets of word shingles, exactly.

    row is common.row_key(); cluster tells the groups apart (null for texts without words), and component_id is
    the smallest doc_id of the group, null if no row of it has one. One row per input row.

    Signatures make candidates, each is checked by the shingle sets themselves (64-bit hashes), and an exact
    prefix-filter join of what the signatures left apart finds the rest, so `miss` and `slack` set the work of
    the first step and not the result. The sets stand in files of spark.checkpoint.dir, which all workers must mount.

    A Jaccard similarity of 0.8 moves about 10 of 64 SimHash bits, far more than the radius of near_duplicates(),
    so the upper nodes are groups of signatures (lanes x 64 bits) that share a masked bit pattern, under as many
    masks (tables) as leave at most `miss` of the pairs at the threshold apart; nearer pairs are missed less.
    The pattern's width follows the logarithm of the rows, so groups keep their size and the work grows a little
    faster than the input, not with its square. Within a group a GrayTree of the whole signatures is searched, and
    what it finds is checked by the sets. Only documents whose set sizes allow the threshold meet: a window is a band of sizes in the ratio 1/threshold and the next band. A group of
    over 8 x group_rows is compared block by block, so no task gets more than two blocks. No pairs leave a
    task, only a forest of them. Equal signatures (exact copies) meet once. Null and empty texts form one group.
    Texts of fewer than `size` words are their whole sequence; texts of any length are read whole. Rows with
    equal doc_id are documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    folder = common.local_path(common.scratch(spark, "shingles"))
    wide = common.cut(spark, shingle_sets(docs, folder, size, lanes), "wide")
    groups = wide.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"), F.min(F.struct("n", "wide", "file", "off")).alias("s")).select("key", "rep", "m", "s.*")
    # A node is a number of the written row, so that texts whose rows have no doc_id are nodes of their own.
    groups = common.cut(spark, groups.withColumn("node", F.monotonically_increasing_id()), "wide-groups")
    nodes = groups.where("n > 0").select(F.col("node").alias("rep"), "wide", "n", "file", "off", F.floor(F.log(F.col("n")) / math.log(1 / threshold)).cast("int").alias("band"))
    sizes = {r["band"]: r["c"] for r in nodes.groupBy("band").agg(F.count("*").alias("c")).collect()}  # at most log(longest text) rows
    # A window's own band asks, the next band only answers.
    layout = {b: _tables(c + sizes.get(b + 1, 0), threshold, 64 * lanes, group_rows, miss) for b, c in sizes.items()}
    bound = jaccard_bits(threshold - slack, lanes)

    def keys(batches):
        masks = {b: _table_bits(t, bits, 64 * lanes) for b, (bits, t) in layout.items()}
        for batch in batches:
            band = batch.column(5).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, 8 * lanes)
            owner, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for b in np.unique(band):
                rows = np.flatnonzero(band == b)
                ones = np.unpackbits(sig[rows], axis=1, bitorder="little")
                for w in (b, b - 1):
                    if w in masks:
                        bits, tables = layout[w]
                        value = (ones[:, masks[w]].astype(np.int64) << np.arange(bits)).sum(axis=2) if bits else np.zeros((len(rows), tables), np.int64)
                        packed = (np.int64(w) << 52) + (np.arange(tables, dtype=np.int64) << 40) + value
                        owner.append(np.repeat(rows, tables))
                        found.append((packed * 2 + int(w == b)).ravel())
            owner, found = np.concatenate(owner), np.concatenate(found)
            ends = np.searchsorted(owner[at := np.argsort(owner, kind="stable")], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[at], pa.int64()))], names=["rep", "wide", "n", "file", "off", "at"])

    placed = common.cut(spark, nodes.mapInArrow(keys, "rep long, wide binary, n long, file long, off long, at array<long>"), "wide-keys")
    most = 8 * group_rows
    crowded = placed.select(F.explode("at").alias("at")).groupBy(F.shiftright("at", 1).alias("key")).agg(F.count("*").alias("c")).where(F.col("c") > most).select("key", F.ceil(F.col("c") / (most // 2)).cast("int").alias("parts"))
    crowded = common.cut(spark, crowded, "wide-crowded")
    rows = placed.select("rep", "wide", "n", "file", "off", F.explode("at").alias("at")).select("rep", "wide", "n", "file", "off", F.shiftright("at", 1).alias("key"), F.col("at").bitwiseAND(1).alias("asks")).join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # A cell is a block that asks and a block that answers; a row goes to its blocks' cells in either part (1 asks, 2 answers, 3 both).
    own, every = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    asks = F.transform(every, lambda k: F.struct((own * F.col("parts") + k).alias("cell"), F.when(k == own, 3).otherwise(1).alias("role")))
    answers = F.transform(every, lambda k: F.struct((k * F.col("parts") + own).alias("cell"), F.lit(2).alias("role")))
    cells = F.when(F.col("asks") == 1, F.concat(asks, F.filter(answers, lambda c: c["cell"] != own * F.col("parts") + own))).otherwise(answers)
    rows = rows.select("rep", "wide", "n", "file", "off", "key", F.explode(cells).alias("c")).select("rep", "wide", "n", "file", "off", "key", "c.cell", "c.role")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, role, n = pdf["rep"].to_numpy(), pdf["role"].to_numpy(), pdf["n"].to_numpy()
        if len(pdf) < 2:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        sig = np.frombuffer(b"".join(pdf["wide"]), np.uint64).reshape(len(pdf), lanes)
        order = np.argsort(gray_rank(sig[:, 0]), kind="stable")
        rep, role, n, sig = rep[order], role[order], n[order], sig[order]
        at, node, sets = pdf[["file", "off", "n"]].to_numpy()[order], np.arange(len(rep)), Sets(folder)
        members, asks = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
        label, unite = common.forest(len(rep))
        if len(members) and len(asks):
            tree, step = GrayTree(sig[members]), min(256, max(8, 100_000 // len(members)))
            for s in range(0, len(asks), step):
                q, m = tree.near(sig[asks[s : s + step]], bound)
                for t in range(0, len(q), 200_000):
                    a, b = asks[s + q[t : t + 200_000]], members[m[t : t + 200_000]]
                    keep = (a != b) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])) & (label()[a] != label()[b])
                    _verify(sets, at, a[keep], b[keep], node, label, unite, threshold)
        return _star(rep, label())

    found = common.components(spark, rows.groupBy("key", "cell").applyInPandas(search, "a long, b long"))
    joined = groups.join(found, "node", "left").select("key", "rep", "n", "file", "off", F.coalesce("component", "node").alias("comp"))
    joined = common.cut(spark, joined, "wide-joined")
    rest = common.components(spark, prefix_links(spark, joined.where("n > 0"), folder, threshold))
    linked = joined.join(rest, joined.comp == rest.node, "left").select(F.col("key").alias("k"), "rep", F.coalesce("component", "comp").alias("cluster"))
    linked = linked.join(linked.groupBy("cluster").agg(F.min("rep").alias("component_id")), "cluster").select("k", "cluster", "component_id")
    return wide.join(linked, wide.key == linked.k).select("doc_id", "row", "component_id", "cluster")


def copies(spark: SparkSession, docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """row (common.row_key), distinct: the rows of docs of which a near duplicate stays.

    Of each group the row with the smallest doc_id stays (rows without one come last, then the smaller key
    decides). Rows that are equal in doc_id and text have one key and stay or go together.
    """
    found = common.cut(spark, similar_groups(spark, docs, size, threshold), "similar-groups")
    first = found.groupBy("cluster").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("cluster", F.col("first.row").alias("stays"))
    return found.join(first, "cluster").where("row <> stays").select("row").distinct()
