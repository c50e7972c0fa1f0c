"""Token counts of a sentencepiece model without ids of documents.

A piece never holds a word mark after another character, so merges stay inside a pre-token: a run of word
marks and what follows up to the next one. The distinct pre-tokens of the whole table are gathered (each task
drops its repeats first, then they are dealt by hash), and the model counts the pieces of each just once. The
counts stand as sorted hash arrays in the shared folder; workers map them and join the pre-token frequencies
of their documents by searching, so no pair of document and pre-token is shuffled and no ids are kept.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
_RUN = re.compile(" +[^ ]*")
#: Bytes of text that a shard of the table stands for, bytes of distinct pre-tokens that a task holds at once, and known pre-tokens that a worker keeps (more only costs looking them up again).
SHARD_BYTES, HELD_BYTES, KEPT = 32_000_000, 24_000_000, 400_000


def pre_tokens(text: str) -> Counter[str]:
    """How often a text holds each pre-token, written without its first mark."""
    if not text:
        return Counter()
    text = text.replace(MARK, " ")
    # The model puts one mark before the text.
    if "  " in text or text[0] == " " or text[-1] == " ":
        return Counter(x[1:] for x in _RUN.findall(" " + text))
    return Counter(text.split(" "))


def _texts(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, common.SLICE_ROWS):
            yield whole.slice(at, common.SLICE_ROWS)


def _hash(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w, 5) for w in words), np.uint64, len(words))


def _pack(words: list[bytes]) -> bytes:
    import zstandard

    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(np.uint32(len(words)).tobytes() + sizes.tobytes() + b"".join(words), 3)


def _unpack(run: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.decompress(run)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64).tolist()
    body = raw[4 + 4 * n :]
    return [body[a:b] for a, b in zip([0, *ends], ends)]


class Pieces:
    """The table of counts of a job: sorted hashes and counts of distinct pre-tokens by shard."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards, self.open, self.known = folder, shards, {}, {}

    def _shard(self, s: int) -> tuple[np.ndarray, np.ndarray, dict]:
        if s not in self.open:
            base = f"{self.folder}/{s:06d}"
            if not os.path.exists(f"{base}.counts.npy"):
                raise FileNotFoundError(f"{base}.counts.npy: this shard of the table can't be seen from here")
            twins = np.load(f"{base}.twins.npy", allow_pickle=True).item()
            self.open[s] = np.load(f"{base}.keys.npy", mmap_mode="r"), np.load(f"{base}.counts.npy", mmap_mode="r"), twins
        return self.open[s]

    def look_up(self, words: list[str]) -> None:
        """Adds the counts of distinct words to the known ones."""
        raw = [w.encode() for w in words]
        keys = _hash(raw)
        shard = (keys % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            rows = order[a:b]
            hashes, counts, twins = self._shard(int(shard[rows[0]]))
            at = np.minimum(np.searchsorted(hashes, keys[rows]), len(hashes) - 1)
            if (hashes[at] != keys[rows]).any():
                raise LookupError(f"{self.folder}: a pre-token of the documents is not in the table; they changed between two reads")
            for r, n in zip(rows.tolist(), counts[at].tolist()):
                self.known[words[r]] = twins[raw[r]] if twins and raw[r] in twins else n

    def total(self, seen: Counter[str]) -> int:
        known = self.known
        if len(known) > KEPT:
            known.clear()
        new = [w for w in seen if w not in known]
        if new:
            self.look_up(new)
        return sum(k * known[w] for w, k in seen.items())


def piece_table(docs: DataFrame, model_path: str, text_col: str = "text") -> tuple[str, int]:
    """Counts the pieces of each distinct pre-token of all texts once; the folder of the table and its number of shards."""
    spark = docs.sparkSession
    folder = common.local_path(common.scratch(spark, "pieces"))
    raw = docs.select(common.text_bytes(text_col).alias("b"))
    shards = max(1, -(-(raw.agg(F.sum(F.octet_length("b"))).first()[0] or 0) // SHARD_BYTES))

    def gather(batches):
        held: set[str] = set()
        size = 0

        def flush():
            words = [w.encode() for w in held]
            shard = (_hash(words) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            full = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_pack([words[k] for k in order[cuts[s] : cuts[s + 1]]]) for s in full], pa.binary())], names=["shard", "run"])

        for batch in _texts(batches):
            for b in batch.column(0).to_pylist():
                new = pre_tokens(b.decode("utf-8", "replace")).keys() - held
                size += sum(map(len, new)) + 50 * len(new)
                held |= new
                if size > HELD_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    def count(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        os.makedirs(folder, exist_ok=True)

        def finish(shard: int, words: set[bytes]):
            own = sorted(words)
            keys = _hash(own)
            counts = np.empty(len(own), np.uint32)
            for s in range(0, len(own), 20_000):
                some = [w.decode() for w in own[s : s + 20_000]]
                # A pre-token that is a lone mark has nothing left to encode; the model gives one piece for it.
                counts[s : s + 20_000] = [len(ids) if w else 1 for w, ids in zip(some, model.encode(some, num_threads=1))]
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            # Different words of one hash are told apart by themselves.
            same = np.flatnonzero(keys[1:] == keys[:-1])
            twins = {own[order[k]]: int(counts[k]) for k in sorted({*same.tolist(), *(same + 1).tolist()})}
            for name, x in (("keys", keys), ("twins", np.array(twins)), ("counts", counts.astype(np.min_scalar_type(counts.max(initial=0))))):
                with open(tmp := f"{folder}/{shard:06d}.{name}.{uuid.uuid4().hex}.tmp", "wb") as f:
                    np.save(f, x, allow_pickle=True)
                common.replace_file(tmp, f"{folder}/{shard:06d}.{name}.npy")
            return pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64())], names=["n"])

        at, words = None, set()
        for batch in batches:
            for shard, run in zip(*[c.to_pylist() for c in batch.columns]):
                if shard != at and words:
                    yield finish(at, words)
                    words = set()
                at = shard
                words.update(_unpack(run))
        if words:
            yield finish(at, words)

    raw.mapInArrow(gather, "shard int, run binary").repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(count, "n long").agg(F.sum("n")).collect()
    return folder, shards


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Strings that look like special tokens are ordinary text,
    as in the library. Repeated rows are counted each; other columns are ignored; a null doc_id stays null; an
    empty table gives no rows. Texts are read twice: for the table of pre-tokens, then to join with it.
    """
    folder, shards = piece_table(docs, model_path, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        pieces = Pieces(folder, shards)
        for batch in _texts(batches):
            raw = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array([pieces.total(pre_tokens(b.decode("utf-8", "replace"))) for b in raw], pa.int64())], schema=schema)

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_bytes(text_col).alias("b")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
