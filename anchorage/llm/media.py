"""Operator 4 - media columns in a content-defined chunk store.

A payload is cut where a rolling gear hash of its last 32 bytes has its top bits zero (with a least
and a largest chunk size), so that equal passages give equal chunks wherever they stand.

1. Every chunk's 128-bit digest is counted; those that occur twice or more are the shared ones.
2. A fixed-size bitmap of the shared digests goes to every task. A chunk whose bit is clear occurs
   once in the whole table and stays in its document's own row; any other goes, once a task, to the
   chunk rows, which a digest aggregation makes unique. So only chunks that repeat are exchanged.
3. Media are read back by joining their ordered chunk lists with the chunk table, and verified
   against the digest taken when they were stored. Media of equal content are rebuilt once.

The stored form of a medium is its manifest ('CDC1', number of chunks u4, then for each chunk its
digest and length u4) followed by its chunks in order.

Cases: null and empty texts are a payload of 576 bytes 255; repeated rows are stored once and
returned as often as they stand; null doc_ids are kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, materialize, mix64, prepare, shared_path

UNIT, LEAST, MOST, MEAN_BITS = 576, 256, 8192, 10
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled with 255 to a positive multiple of UNIT, and their number before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def cuts(payload: bytes, least: int = LEAST, most: int = MOST, mean_bits: int = MEAN_BITS) -> list[int]:
    """Chunk ends. The hash of a position sums the gear values of the last 32 bytes, shifted by their age."""
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # each round doubles the window
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    ends, start = [], 0
    for at in (np.flatnonzero(h >> np.uint32(32 - mean_bits) == 0) + 1).tolist():
        while at - start > most:
            start += most
            ends.append(start)
        if at - start >= least:
            ends.append(at)
            start = at
    while len(payload) - start > most:
        start += most
        ends.append(start)
    if start < len(payload):
        ends.append(len(payload))
    return ends


def chunks_of(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk in order."""
    start, out = 0, []
    for end in cuts(payload):
        piece = payload[start:end]
        out.append((hashlib.blake2b(piece, digest_size=16).digest(), piece))
        start = end
    return out


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


_ROWS = "kind string, row_id long, doc_id long, n_bytes long, sha binary, digests array<binary>, lengths array<int>, away array<int>, body binary"


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store each document's payload; returns (media, chunks), both read from the shared folder.

    media: row_id, doc_id, n_bytes, sha, digests, lengths, away (positions held in chunks), body
    (the other chunks in a row). chunks: digest, body.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches):
        for batch in batches:
            seen: dict[bytes, int] = {}
            for text in batch.column(1).to_pylist():
                for digest, _ in chunks_of(payload_of(text)[0]):
                    seen[digest] = seen.get(digest, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["digest", "n"])

    counted = rows.mapInArrow(count, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    shared = counted.filter("n > 1").select("digest")
    words = bitmap_of(_keys(shared), "key")
    schema = pa.schema([("kind", pa.string()), ("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("away", pa.list_(pa.int32())), ("body", pa.binary())])

    def put(batches):
        base, n, sent = TaskContext.get().partitionId() << 33, 0, set()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload, size = payload_of(text)
                parts = chunks_of(payload)
                away = np.flatnonzero(in_bitmap(words, np.array([_key(d) for d, _ in parts], np.int64))).tolist()
                gone = set(away)
                out.append(("media", base + n, doc_id, size, hashlib.sha256(payload).digest(), [d for d, _ in parts], [len(p) for _, p in parts], away, b"".join(p for i, (_, p) in enumerate(parts) if i not in gone)))
                n += 1
                for i in away:
                    digest, piece = parts[i]
                    if digest not in sent:
                        sent.add(digest)
                        out.append(("chunk", None, None, None, digest, None, None, None, piece))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    spark = docs.sparkSession
    path = shared_path(spark, "media")
    rows.mapInArrow(put, _ROWS).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    both = spark.read.schema(_ROWS).parquet(path)
    media = both.filter("kind = 'media'").drop("kind")
    chunks = both.filter("kind = 'chunk'").groupBy(F.col("sha").alias("digest")).agg(F.first("body").alias("body"))
    return media, materialize(chunks, "chunks")


def _keys(digests: DataFrame) -> DataFrame:
    """The first eight bytes of each digest, little-endian, as BIGINT."""
    byte = lambda i: F.conv(F.hex(F.substring("digest", i, 1)), 16, 10).cast("long")
    value = byte(1)
    for i in range(2, 9):
        value = value.bitwiseOR(F.shiftleft(byte(i), 8 * (i - 1)))
    return digests.select(value.alias("key"))


_FEATURES = "row_id long, doc_id long, n_bytes long, sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches):
    """Rebuild each medium from its own and its fetched chunks, verify it and describe it."""
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    for batch in batches:
        cols, out = batch.to_pydict(), []
        fetched = cols.get("fetched") or [None] * batch.num_rows
        for row_id, doc_id, size, sha, digests, lengths, away, body, got in zip(*(cols[c] for c in ("row_id", "doc_id", "n_bytes", "sha", "digests", "lengths", "away", "body")), fetched):
            if away:
                by, gone, parts, at = {g["digest"]: g["body"] for g in got}, set(away), [], 0
                for i, n in enumerate(lengths):
                    if i in gone:
                        parts.append(by[digests[i]])
                    else:
                        parts.append(body[at : at + n])
                        at += n
                payload = b"".join(parts)
            else:
                payload = body
            digest = hashlib.sha256(payload)
            if digest.digest() != sha:
                raise ValueError("a medium differs from what was stored")
            manifest = b"CDC1" + struct.pack("<I", len(digests)) + b"".join(d + struct.pack("<I", n) for d, n in zip(digests, lengths))
            count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            share = count[count > 0] / len(payload)
            entropy = float(-(share * np.log2(share)).sum())
            out.append((row_id, doc_id, size, sha, len(payload), digest.hexdigest(), zlib.crc32(payload[-32:]), len(manifest) + len(payload), hashlib.sha256(manifest + payload).hexdigest(), f"chunks={len(digests)};entropy={entropy:.4f};mean={float(count @ np.arange(256)) / len(payload):.3f}"))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)


def read_features(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each medium rebuilt and verified, with its checksums and feature."""
    whole = media.filter(F.size("away") == 0).mapInArrow(_features, _FEATURES)
    part = media.filter(F.size("away") > 0)
    # equal content is rebuilt once, by the row of its least id
    once = part.groupBy("sha").agg(F.min("row_id").alias("row_id")).select("row_id")
    refs = part.select("row_id", F.explode(F.array_distinct(F.expr("transform(away, i -> digests[i])"))).alias("digest")).join(once, "row_id", "left_semi")
    got = refs.join(chunks, "digest").groupBy("row_id").agg(F.collect_list(F.struct("digest", "body")).alias("fetched"))
    built = part.join(got, "row_id").select("row_id", "doc_id", "n_bytes", "sha", "digests", "lengths", "away", "body", "fetched").mapInArrow(_features, _FEATURES)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    copies = part.select("doc_id", "sha").join(built.select("sha", *names), "sha")
    return whole.select("doc_id", *names).unionByName(copies.select("doc_id", *names))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' payloads stored as chunks, read back, verified and described."""
    return read_features(*store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
