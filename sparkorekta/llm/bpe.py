"""Byte-level BPE encoding by a walk over a trie of distinct words, and decoding.

For a byte-pair encoding each prefix of a word has one last token: the suffix token t such that the last
token of the rest and t may stand side by side (no merge across their border comes before the merges that
make them). A depth-first walk over the sorted distinct words of a batch keeps these last tokens on a stack,
so a prefix that words share is solved once. The ids of a word are read off by following last tokens back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: the published pattern that cuts text before byte-level merges, with words first (its other branches can't begin where they do).
PATTERN = r""" ?{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?{N}+| ?[^{S}{l}{n}]+|[{S}]+(?![^{S}])|[{S}]+"""
#: White space; then letters and numbers of texts below U+0250, which the standard library's engine can split.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN_LETTERS, LATIN_NUMBERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"


def pattern(letters: str, numbers: str) -> str:
    out = PATTERN
    for name, value in (("{L}", f"[{letters}]"), ("{N}", f"[{numbers}]"), ("{S}", SPACE), ("{l}", letters), ("{n}", numbers)):
        out = out.replace(name, value)
    return out


#: Words and token pairs a worker keeps; more only costs solving them again.
KEPT_WORDS, KEPT_BYTES, KEPT_PAIRS = 500_000, 64, 500_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else the next unused code from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class ByteBPE:
    """A tokenizer file of byte-level BPE: vocabulary, ranked merges, added tokens found in text."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only byte-level BPE without prefix space or normaliser")
        of = {c: b for b, c in enumerate(byte_letters())}
        self.bytes_of = {i: bytes(of[c] for c in t) for t, i in model["vocab"].items() if all(c in of for c in t)}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        name = {t: i for t, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank of the merge that makes it
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made = name[a + b]
            self.rank.setdefault((name[a], name[b]), r)
            self.parts.setdefault(made, (name[a], name[b], r))
        self.longest = max(map(len, self.id_of))
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words of the generation before, until they are met again
        self.split_any = regex.compile(pattern(r"\p{L}", r"\p{N}")).findall
        self.split_latin = re.compile(pattern(LATIN_LETTERS, LATIN_NUMBERS)).findall
        self.beyond_latin = re.compile("[^\x00-\u024f]").search
        added = sorted((t for t in spec.get("added_tokens", [])), key=lambda t: -len(t["content"]))
        self.added = {t["content"]: t["id"] for t in added}
        self.find_added = regex.compile("|".join(regex.escape(t["content"]) for t in added)) if added else None
        top = max([*self.bytes_of, *self.added.values()]) + 1
        self.out = [self.bytes_of.get(i, b"") for i in range(top)]
        for text, i in self.added.items():
            self.out[i] = text.encode()
        never = 1 << 60
        self._never = never
        # Tokens that no text of their own encodes to can't begin a word.
        self.whole = {t for t in self.bytes_of if t not in self.parts or self._joined(*self.parts[t])}

    def _joined(self, left: int, right: int, rank: int) -> bool:
        """Whether the merge of left and right is the first across their border."""
        firsts = [m for x, x0, x1 in self._spine(left, 1) for y, y0, y1 in self._spine(right, 0) if (m := self.rank.get((x, y))) is not None and x0 < m and y0 < m and m < x1 and m <= y1]
        return min(firsts, default=None) == rank

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens at a token's edge over the merges (side 0: left edge, 1: right edge): token, rank when made, rank when merged."""
        found = self.spines[side].get(token)
        if found is None:
            found, until, t = [], 1 << 60, token
            while True:
                made = self.parts.get(t)
                found.append((t, made[2] if made else -1, until))
                if not made:
                    break
                t, until = made[side], made[2]
            self.spines[side][token] = found
        return found

    def beside(self, a: int, b: int) -> bool:
        """Whether a then b is how their joined bytes are encoded."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            rank, left = self.rank, self._spine(b, 0)
            known = True
            for x, x0, x1 in self._spine(a, 1):
                for y, y0, y1 in left:
                    m = rank.get((x, y))
                    # At equal ranks the merge further left comes first.
                    if m is not None and x0 < m and y0 < m and m < x1 and m <= y1:
                        known = False
                        break
                if not known:
                    break
            self.pairs[key] = known
        return known

    def solve(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words as little-endian unsigned 32-bit integers."""
        out, last, size, before = {}, [], [], b""
        id_of, beside, whole, longest, pairs = self.id_of, self.beside, self.whole, self.longest, self.pairs
        for raw, word in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(before), len(raw))
            if raw[:most] == before[:most]:
                shared = most
            else:
                while raw[shared] == before[shared]:
                    shared += 1
            del last[shared:]
            for end in range(shared + 1, len(raw) + 1):
                token = None
                # Just one suffix can be the last token; short ones are the likeliest.
                for start in range(end - 1, max(-1, end - longest - 1), -1):
                    t = id_of.get(raw[start:end])
                    if t is not None:
                        if start:
                            known = pairs.get(last[start - 1] << 32 | t)
                            if known is None:
                                known = beside(last[start - 1], t)
                        else:
                            known = t in whole
                        if known:
                            token = t
                            break
                if token is None:
                    raise ValueError(f"no token ends {raw[:end]!r}")
                last.append(token)
            ids, end = [], len(raw)
            while end:
                ids.append(last[end - 1])
                end -= len(self.out[last[end - 1]])
            out[word] = np.array(ids[::-1], "<u4").tobytes()
            before = raw
        return out

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if self.beyond_latin(text) else self.split_latin(text)

    def _pieces(self, text: str):
        """The words of a text and, as integers, its added tokens."""
        if not self.find_added or not any(a in text for a in self.added):
            return self.split(text)
        parts, at = [], 0
        for m in self.find_added.finditer(text):
            parts += self.split(text[at : m.start()])
            parts.append(self.added[m.group()])
            at = m.end()
        return parts + self.split(text[at:])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self._pieces(t) for t in texts]
        known = self.words
        new = {p for parts in cut for p in parts if p not in known}
        if len(known) + len(new) > KEPT_WORDS // 2:  # a new generation begins; of the last one what is met again is kept
            self.older, self.words = known, (known := {})
            new = {p for parts in cut for p in parts}
        if older := self.older:
            again = {p: older[p] for p in new if p in older}
            known.update(again)
            new.difference_update(again)
        fresh = self.solve([p for p in new if isinstance(p, str)])
        fresh.update((p, np.array([p], "<u4").tobytes()) for p in new if isinstance(p, int))
        known.update(fresh)
        ids = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        for p in [p for p in fresh if isinstance(p, str) and len(p) > KEPT_BYTES]:
            del known[p]
        return ids

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(os.fspath(path))
    return _loaded[path]


def _map(docs: DataFrame, schema: pa.Schema, ddl: str, rows, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, common.SLICE_ROWS):
                batch = whole.slice(at, common.SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(0), *rows(batch.column(1).to_pylist())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_bytes(text_col).alias("b")).mapInArrow(run, ddl)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids of each row's text; null and empty texts give an empty array."""

    def rows(raw):
        ids = loaded(path).encode_batch([b.decode("utf-8", "replace") for b in raw])
        ends = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))]

    return _map(docs, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), "doc_id long, ids array<int>", rows, id_col, text_col)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: decoded ids; a null array gives an empty text. Bytes that aren't UTF-8 become U+FFFD."""

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            text = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the text decoded from the ids).

    Null and empty texts have no ids and the digests of no bytes. Repeated rows are encoded each; other
    columns are ignored.
    """
    sha = hashlib.sha256

    def rows(raw):
        bpe = loaded(path)
        ids = bpe.encode_batch([b.decode("utf-8", "replace") for b in raw])
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids]), pa.array([sha(bpe.decode(x).encode()).hexdigest() for x in ids])]

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _map(docs, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows, id_col, text_col)
