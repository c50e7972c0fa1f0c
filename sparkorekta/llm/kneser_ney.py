"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

An n-gram is known by a 64-bit hash. Tasks count the n-grams of about a million tokens at a time and send
them on as packed runs (a local vocabulary and columns of small numbers, compressed), dealt by hash into as
many shards as the text needs. A shard's task merges its runs, writes one sorted key array and count arrays
for this level, and sends on what the next lower level needs: continuation and raw counts of the suffixes and, for
the contexts, the total and the numbers of followers seen once, twice and more often. Raw counts of words are
sums of the highest level's counts over the last word, so text is counted once. Shards are dealt by the
hash of the whole n-gram, so a frequent word is spread over all of them. Workers map the arrays and look up
sorted batches; only the pages they touch are read. A shard whose files can't be read is an error, never an
unseen n-gram.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BEGIN, END = np.uint64(0x5BF03635F0B7A54B), np.uint64(0x9F2D1C3B4A596877)
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Tokens that a counting task packs at once, tokens of text a shard stands for, and tokens scored at once.
RUN_TOKENS, SHARD_TOKENS, SCORE_TOKENS = 2_000_000, 2_000_000, 250_000
#: Columns of levels below the highest: continuation count, then of the key as a context: total, followers seen once, twice, oftener; raw count (stored at level 1 only).
LOWER = ("c", "total", "n1", "n2", "n3", "raw")


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from that of all but its last word and its last word."""
    return common.mix64(a * MULT + b)


def gram_hash(words: np.ndarray) -> np.ndarray:
    """Hashes of rows of word hashes."""
    h = words[:, 0]
    for k in range(1, words.shape[1]):
        h = join_hash(h, words[:, k])
    return h


def pack(words: np.ndarray, values: np.ndarray) -> bytes:
    """Rows of word hashes and of counts as a compressed run: sorted vocabulary as byte planes of its differences, then columns."""
    import zstandard

    vocab, index = np.unique(words, return_inverse=True)
    planes = np.diff(vocab, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    columns = [np.ascontiguousarray(index.reshape(words.shape)[:, k], np.uint32).view(np.uint8).reshape(-1, 4).T for k in range(words.shape[1])]
    columns += [np.ascontiguousarray(values[:, k], np.uint64).view(np.uint8).reshape(-1, 8).T for k in range(values.shape[1])]
    head = np.array([len(vocab), *words.shape, values.shape[1]], np.uint32)
    return zstandard.compress(head.tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in [planes, *columns]), 3)


def unpack(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.decompress(run)
    v, rows, n, k = np.frombuffer(raw, np.uint32, 4).tolist()
    at = 16

    def column(size: int, width: int) -> np.ndarray:
        nonlocal at
        flat = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T)
        at += size * width
        return flat.view(f"<u{width}")[:, 0]

    vocab = np.cumsum(column(v, 8), dtype=np.uint64)
    words = np.stack([vocab[column(rows, 4)] for _ in range(n)], axis=1)
    return words, np.stack([column(rows, 8) for _ in range(k)], axis=1)


def merged(words: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows by hash order: hashes, words, summed values."""
    h = gram_hash(words)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], words[order[first]], np.add.reduceat(values[order], first, axis=0) if len(h) else values[:0]


def runs(level: int, h: np.ndarray, words: np.ndarray, values: np.ndarray, shards: int):
    """A packed run for each shard that has rows: level, shard, run."""
    shard = (h % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        rows = order[cuts[s] : cuts[s + 1]]
        yield level, int(s), pack(words[rows], values[rows])


_RUN = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("run", pa.binary())])
_RUN_DDL = "level int, shard int, run binary"


def _emit(rows):
    part: list[tuple] = []
    size = 0
    for row in rows:
        part.append(row)
        size += len(row[2])
        if size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), _RUN.types)], schema=_RUN)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), _RUN.types)], schema=_RUN)


@dataclass(frozen=True)
class Model:
    path: str
    order: int
    shards: tuple[int, ...]  # by level, from 1
    discounts: tuple[tuple[float, float, float], ...]
    followers: tuple[int, int, int, int]  # of level 1: total, words with count 1, 2, 3 and more
    tokens: int
    vocabulary: int
    empty: tuple[frozenset[int], ...] = ()  # by level: shards without n-grams (small corpora only)
    _maps: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_maps": {}}

    def _shard(self, level: int, s: int):
        found = self._maps.get((level, s))
        if found is None:
            if len(self._maps) > 4000:
                self._maps.clear()
            base = f"{self.path}/{level}-{s:06d}"
            if s in self.empty[level - 1]:
                found = ()
            elif not os.path.exists(f"{base}.values.npy"):
                raise FileNotFoundError(f"{base}.values.npy: this shard of the model has n-grams, but its file can't be seen from here")
            else:
                found = tuple(np.load(f"{base}.{name}.npy", mmap_mode="r") for name in ("keys", "values", "over"))
            self._maps[level, s] = found
        return found

    def look_up(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Value rows of keys (any order, repeats allowed); zeros for unseen ones."""
        unique, inverse = np.unique(keys, return_inverse=True)
        width = len(LOWER) if level == 1 else 1 if level == self.order else len(LOWER) - 1
        out = np.zeros((len(unique), width))
        shard = (unique % np.uint64(self.shards[level - 1])).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            rows = order[a:b]
            found = self._shard(level, int(shard[rows[0]]))
            if found:
                at = np.searchsorted(found[0], unique[rows])
                at[at == len(found[0])] = 0
                hit = found[0][at] == unique[rows]
                at = at[hit]
                got = found[1][at].astype(np.float64)
                if len(found[2]):  # counts that don't fit the column stand apart, by row
                    spot = np.minimum(np.searchsorted(found[2][:, 0], at), len(found[2]) - 1)
                    big = found[2][spot, 0] == at
                    got[big, 0] = found[2][spot[big], 1]
                out[rows[hit]] = got
        return out[inverse]

    def score(self, flat: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the positions `real` of padded texts: log10 probabilities, raw counts."""
        grams = [flat]
        for k in range(2, self.order + 1):
            grams.append(np.concatenate([np.zeros(1, np.uint64), join_hash(grams[-1][:-1], flat[1:])]))
        tables = [self.look_up(k, g) for k, g in enumerate(grams[: self.order - 1] if self.order > 1 else grams, 1)]
        tops = self.look_up(self.order, grams[-1][real])[:, 0] if self.order > 1 else None
        total, *n = self.followers
        p = np.full(len(real), 1.0 / (self.vocabulary + 1))
        for k in range(1, self.order + 1):
            d = np.array([0.0, *self.discounts[k - 1]])
            c = tops if k == self.order > 1 else tables[k - 1][real, 0]
            if k == 1:
                tot, mass = np.full(len(real), float(total)), np.full(len(real), float(d[1:] @ n))
            else:
                of = tables[k - 2][real - 1]
                tot, mass = of[:, 1], of[:, 2:5] @ d[1:]
            seen = tot > 0
            own = np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0)
            p = np.where(seen, (own + mass * p) / np.where(seen, tot, 1), p)
        return np.log10(p), tables[0][real, 5]


class Padded:
    """Texts as word hashes, each after order - 1 begins and before one end."""

    def __init__(self, order: int):
        self.order, self.hashes = order, common.WordHashes()
        self.clear()

    def clear(self) -> None:
        self.parts, self.lengths, self.size = [], [], 0

    def add(self, text: bytes) -> None:
        words = text.lower().split()
        self.parts += [np.full(self.order - 1, BEGIN), self.hashes(words), np.array([END])]
        self.lengths.append(len(words) + 1)
        self.size += len(words) + self.order

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes, and the positions of words and ends."""
        n = np.array(self.lengths)
        flat = np.concatenate(self.parts)
        pad = self.order - 1
        starts = np.cumsum(n + pad) - n
        return flat, np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def train(spark: SparkSession, texts: DataFrame, order: int = 2, text_col: str = "text") -> Model:
    """Counts the n-grams of all whole texts (null: empty) and writes the model to the shared folder."""
    where = common.local_path(common.scratch(spark, "kneser-ney"))
    os.makedirs(where, exist_ok=True)
    raw = texts.select(common.text_bytes(text_col).alias("b"))
    size = raw.agg(F.sum(F.octet_length("b") + 6)).first()[0] or 0
    top = max(1, -(-size // (6 * SHARD_TOKENS)))
    shards = tuple(max(1, -(-top * k // order)) for k in range(1, order + 1))

    def count(batches):
        def rows():
            pad = Padded(order)

            def flush():
                flat, real = pad.flat()
                words = np.stack([flat[real - k] for k in range(order - 1, -1, -1)], axis=1)
                one = np.ones((len(words), 1), np.uint64)
                pad.clear()
                if order > 1:
                    yield from runs(order, *merged(words, one), shards[-1])
                else:
                    h, words, n = merged(words, one)
                    low = np.zeros((len(h), len(LOWER)), np.uint64)
                    low[:, 0] = low[:, 5] = n[:, 0]
                    yield from runs(1, h, words, low, shards[0])

            for batch in batches:
                for at in range(0, batch.num_rows, common.SLICE_ROWS):
                    for text in batch.column(0).slice(at, common.SLICE_ROWS).to_pylist():
                        pad.add(text)
                        if pad.size >= RUN_TOKENS:
                            yield from flush()
            if pad.size:
                yield from flush()

        yield from _emit(rows())

    def merge(level: int):
        def finish(shard: int, some: list[bytes]):
            words, values = (np.concatenate(x) for x in zip(*map(unpack, some)))
            h, words, values = merged(words, values)
            c = values[:, 0]
            base = f"{where}/{level}-{shard:06d}"
            over = np.empty((0, 2), np.int64)
            if level == order > 1:  # a byte a count; the few larger ones stand apart
                big = np.flatnonzero(c > 255)
                kept, over = np.minimum(values, 255).astype(np.uint8), np.stack([big, c[big].astype(np.int64)], axis=1)
            else:
                kept = values if level == 1 else values[:, :-1]
                kept = kept.astype(np.min_scalar_type(kept.max(initial=0)))
            for name, x in (("keys", h), ("over", over), ("values", kept)):
                with open(tmp := f"{base}.{name}.{uuid.uuid4().hex}.tmp", "wb") as f:
                    np.save(f, x)
                common.replace_file(tmp, f"{base}.{name}.npy")
            del kept
            stats = {"grams": int((c > 0).sum()), "mass": int(c.sum()), **{f"t{k}": int((c == k).sum()) for k in (1, 2, 3, 4)}}
            if level == 1:
                stats |= {"tokens": int(values[:, 5].sum()), "vocabulary": int((values[:, 5] > 0).sum())}
            yield -level, shard, json.dumps(stats).encode()
            if level > 1:
                keep = c > 0
                words, c, raw = words[keep], c[keep], (c if level == order else values[:, 5])[keep]
                parts = []
                for own, columns, at in ((words[:, 1:], np.stack([np.ones_like(c), raw], axis=1), [0, 5]), (words[:, :-1], np.stack([c, *[np.where(np.minimum(c, 3) == k, 1, 0).astype(np.uint64) for k in (1, 2, 3)]], axis=1), [1, 2, 3, 4])):
                    _, grams, sums = merged(own, columns)
                    wide = np.zeros((len(grams), len(LOWER)), np.uint64)
                    wide[:, at] = sums
                    parts.append((grams, wide))
                yield from runs(level - 1, *merged(*map(np.concatenate, zip(*parts))), shards[level - 2])

        def run(batches):
            def rows():
                at, some = None, []
                for batch in batches:
                    for of, shard, blob in zip(*[c.to_pylist() for c in batch.columns]):
                        if of != level:  # sums of a higher level, or raw counts for a lower one: handed on
                            yield of, shard, blob
                            continue
                        if shard != at and some:
                            yield from finish(at, some)
                            some = []
                        at = shard
                        some.append(blob)
                if some:
                    yield from finish(at, some)

            yield from _emit(rows())

        return run

    # One job: runs go from level to level by shuffle alone, and what is left at its end are the sums of the shards.
    due = raw.mapInArrow(count, _RUN_DDL)
    for level in range(order, 0, -1):
        due = due.repartition(shards[level - 1], "level", "shard").sortWithinPartitions("level", "shard").mapInArrow(merge(level), _RUN_DDL)
    fields = ("grams", "mass", "t1", "t2", "t3", "t4", "tokens", "vocabulary")
    each = due.select("level", (F.col("shard") + 1).cast("long").alias("at"), F.from_json(F.col("run").cast("string"), ", ".join(f"{x} long" for x in fields)).alias("s"))
    # A row for each level and 32,768 shards: sums, and a bitmap of the shards that hold something.
    sums = each.groupBy("level", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("held"), *[F.coalesce(F.sum(f"s.{x}"), F.lit(0)).alias(x) for x in fields])
    got: dict[int, dict] = {}
    empty = [np.ones(n, bool) for n in shards]
    for r in sums.collect():
        level = got.setdefault(-r["level"], dict.fromkeys(fields, 0))
        for x in fields:
            level[x] += r[x]
        bits, first = np.unpackbits(np.frombuffer(r["held"], np.uint8), bitorder="little"), (r["bucket"] - 1) * 32768
        part = empty[-r["level"] - 1][first : first + 32768]
        part &= bits[: len(part)] == 0
    empty = [frozenset(np.flatnonzero(e).tolist()) for e in empty]
    none = dict.fromkeys(fields, 0)
    discounts = [_discounts(*[got.get(k, none)[f"t{c}"] for c in (1, 2, 3, 4)]) for k in range(1, order + 1)]
    sums = got.get(1, none)
    many = sums["grams"] - sums["t1"] - sums["t2"]
    return Model(where, order, shards, tuple(discounts), (sums["mass"], sums["t1"], sums["t2"], many), sums["tokens"], sums["vocabulary"], tuple(empty))


def _discounts(t1: int, t2: int, t3: int, t4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2, 3 and more, from the numbers of n-grams with counts 1 to 4; fixed ones where a number is 0."""
    if not (t1 and t2 and t3 and t4):
        return 0.5, 1.0, 1.5
    y = t1 / (t1 + 2 * t2)
    d = (1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are lower-cased (A-Z) words between ASCII white space and one end. Null and empty texts have one
    token, the end. Texts of any length are scored whole; repeated rows each; other columns are ignored.
    Without any training text the score is 0. base_score is that of add-one unigrams, score is the model's.
    """
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    schema = pa.schema([("doc_id", pa.int64()), *zip(names, types)])
    norm = math.log10(model.tokens + model.vocabulary + 1)

    def run(batches):
        pad, ids = Padded(model.order), []

        def flush():
            flat, real = pad.flat()
            logs, raw = model.score(flat, real)
            n = np.array(pad.lengths)
            cuts = np.cumsum(n) - n
            total = np.add.reduceat(logs, cuts)
            out = [n, np.add.reduceat((raw > 0).astype(np.int64), cuts), np.full(len(n), model.tokens), np.add.reduceat(np.log10(raw + 1) - norm, cuts), total, 10.0 ** np.minimum(-total / n, 300)]
            batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(x, t) for x, t in zip(out, types)]], schema=schema)
            pad.clear()
            ids.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                part = batch.slice(at, common.SLICE_ROWS)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(i)
                    pad.add(text)
                    if pad.size >= SCORE_TOKENS:
                        yield flush()
        if ids:
            yield flush()

    ddl = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_bytes(text_col).alias("b")).mapInArrow(run, ddl)


def in_fold(modulus: int, remainder: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text has this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


Held = Callable[[str], Column]
