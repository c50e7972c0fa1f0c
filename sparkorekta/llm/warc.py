"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page id. Each range is written by one task into files that roll over at a
compressed size; every record is a gzip member of its own, with headers and digests made anew from the
payload. A file is written under a temporary name and renamed when whole; the range's manifest, renamed last,
lists its files with sizes and digests, and the archive's manifest lists the ranges. A repeated task writes
the same bytes again, so a lost executor leaves at most temporary names, which no manifest lists.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROLL_BYTES, RANGE_BYTES = 64_000_000, 128_000_000
#: All records bear one date, so that equal pages give equal archives.
DATE = "2020-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the published name space of URLs


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record as a gzip member: a response with the payload, or a revisit without it."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    name = f"{page_id}:{digest}:{uri}"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, name)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Page-Id: {'' if page_id is None else page_id}", f"WARC-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
        block = http + b"\r\n"
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_range(where: str, number: int, rows: Iterable[tuple]) -> dict:
    """Writes the rows (page_id, url, payload, refers_to) of a range; returns its manifest entry."""
    files, out, size, records, sha = [], None, 0, 0, None

    def close():
        nonlocal out
        if out:
            out.close()
            name = f"part-{number:06d}-{len(files):04d}.warc.gz"
            common.replace_file(out.name, f"{where}/{name}")
            files.append({"name": name, "bytes": size, "records": records, "sha256": sha.hexdigest()})
            out = None

    for page_id, url, payload, refers_to in rows:
        member = record(page_id, url, payload, base32_sha1(payload), refers_to)
        if out and size + len(member) > ROLL_BYTES:
            close()
        if not out:
            out, size, records, sha = open(f"{where}/.{number:06d}-{uuid.uuid4().hex}.tmp", "wb"), 0, 0, hashlib.sha256()  # noqa: SIM115
        out.write(member)
        sha.update(member)
        size, records = size + len(member), records + 1
    close()
    path = f"{where}/manifest-{number:06d}.json"
    with open(tmp := f"{where}/.{number:06d}-{uuid.uuid4().hex}.tmp", "w") as f:
        json.dump({"range": number, "files": files}, f)
    common.replace_file(tmp, path)
    return {"range": number, "files": files}


def members(path: str, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, inflated one by one."""
    with open(path, "rb") as f:
        rest = b""
        while True:
            rest = rest or f.read(step)
            if not rest:
                return
            unpack, parts = zlib.decompressobj(31), []
            while not unpack.eof:
                parts.append(unpack.decompress(rest))
                rest = unpack.unused_data if unpack.eof else f.read(step)
                if not rest and not unpack.eof:
                    raise ValueError(f"{path}: cut off")
            yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; digests and lengths are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: damaged")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and f"sha1:{base32_sha1(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"record {fields['WARC-Record-ID']}: payload and digest differ")
    return fields, payload


def write(spark: SparkSession, pages: DataFrame, path: str, least: int = 0) -> dict:
    """Writes a record for each row of pages (page_id, url, html) under path and returns the manifest.

    Of records with equal payloads of at least `least` bytes the one with the smallest page_id is a response
    and the others are revisits of it (of rows with that same id the first by url); all smaller ones are
    responses. A null page_id never is the first but if no other row has the payload; null html is empty.
    """
    where = common.local_path(path)
    os.makedirs(where, exist_ok=True)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_bytes("html").alias("payload"))
    # Only ids and digests are grouped; payloads are moved once, by the range sort.
    sums = common.cut(spark, own.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size")), "warc-digests")
    size, rows = sums.agg(F.sum("size"), F.count("*")).first()
    first = sums.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = sums.where(F.col("size") >= least).join(first, "digest").select("page_id", "digest", "refers_to").distinct()
    # Keys come before their page in the same range: kind 0 tells of a repeated payload.
    keys = again.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.unhex("digest").alias("digest"), "refers_to")
    records = own.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    parts = max(1, -(-(size or 0) // RANGE_BYTES), min(rows or 0, spark.sparkContext.defaultParallelism))
    ranged = records.unionByName(keys).repartitionByRange(parts, "page_id").sortWithinPartitions("page_id", "kind", "url", "payload")

    def run(batches):
        from pyspark import TaskContext

        def rows():
            at, known, begun = object(), {}, set()
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    for page_id, kind, url, payload, digest, refers_to in zip(*[c.to_pylist() for c in part.columns]):
                        if page_id != at:
                            at, known, begun = page_id, {}, set()
                        if kind == 0:
                            known[digest] = refers_to
                            continue
                        first = None
                        if known:
                            digest = hashlib.sha1(payload).digest()
                            if digest in known:
                                first = known[digest]
                                if first == page_id or first is None:
                                    first = page_id if digest in begun else None
                                    begun.add(digest)
                        yield page_id, url, payload, first

        yield pa.RecordBatch.from_pydict({"entry": [json.dumps(write_range(where, TaskContext.get().partitionId(), rows()))]})

    entries = sorted((json.loads(r["entry"]) for r in ranged.mapInArrow(run, "entry string").collect()), key=lambda e: e["range"])  # a row a range
    manifest = {"format": "WARC/1.1", "ranges": entries, "records": sum(f["records"] for e in entries for f in e["files"])}
    with open(tmp := f"{where}/.manifest.tmp", "w") as f:
        json.dump(manifest, f)
    common.replace_file(tmp, f"{where}/manifest.json")
    return manifest


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload: the records that the manifest lists.

    Each file is read by one task, record by record; sizes and digests are checked. A revisit has no payload.
    """
    where = common.local_path(path)
    with open(f"{where}/manifest.json") as f:
        names = [(x["name"],) for e in json.load(f)["ranges"] for x in e["files"]]
    types = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    schema = pa.schema(types)

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for raw in members(f"{where}/{name}"):
                    head, payload = parse(raw)
                    n = int(head["WARC-Payload-Length"])
                    response = head["WARC-Type"] == "response"
                    if response and n != len(payload):
                        raise ValueError(f"{name}: length of a payload")
                    page, first = head["WARC-Page-Id"], head.get("WARC-Refers-To-Page")
                    rows.append((int(page) if page else None, head["WARC-Target-URI"], n, head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], int(first) if first else None, *([payload if response else None] * payloads)))
                    size += n * payloads + 200
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    files = spark.createDataFrame(names, "name string").repartition(max(1, len(names))) if names else spark.createDataFrame([], "name string")
    return files.mapInArrow(run, ddl)


