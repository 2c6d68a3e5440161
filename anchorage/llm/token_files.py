"""Operator 1 - token-ID files of patched frame-of-reference blocks.

A segment holds the ids of consecutive documents. Its payload is

    magic 'PFB1' | block size u4 | ids u8 | blocks u4
    block starts u4[blocks + 1]          byte offset of each block, from the end of this index
    per block: minimum u4 | width u1 | exceptions u2 | packed bits | positions u2[] | values u4[]

Each block subtracts its minimum and packs the differences at the width that fits the chosen
percentile of them; the few that need more bits stand whole in the block's exception list. The
block index gives random access: ``decode_range`` touches only the blocks it needs.

Segments are rows of a Parquet table (``payload`` binary), because its writer commits atomically on
any file system, so that a lost executor leaves no half-written file.

Cases: a null or empty text is a document of the end id alone; a null doc_id sorts first; equal
doc_ids stand in the order of their texts; an empty table gives empty files; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism, prepare, shared_path
from .tokens import encoder

MAGIC, BLOCK, PERCENTILE, SEGMENT_IDS = b"PFB1", 128, 90, 1 << 20
_HEAD = struct.Struct("<4sIQI")


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each unsigned 32-bit value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of unsigned values, packed at ``width`` bits: one row of bytes each."""
    if width == 0:
        return np.zeros((len(rows), 0), np.uint8)
    size = 16 if width <= 16 else 32
    raw = rows.astype(f">u{size // 8}").view(np.uint8).reshape(len(rows), -1)
    bits = np.unpackbits(raw, axis=1).reshape(len(rows), -1, size)[:, :, size - width :]
    return np.packbits(bits.reshape(len(rows), -1), axis=1)


def _unpack(packed: np.ndarray, width: int, block: int) -> np.ndarray:
    if width == 0:
        return np.zeros((len(packed), block), np.uint32)
    size = 16 if width <= 16 else 32
    bits = np.zeros((len(packed), block, size), np.uint8)
    bits[:, :, size - width :] = np.unpackbits(packed, axis=1)[:, : block * width].reshape(len(packed), block, width)
    return np.packbits(bits.reshape(len(packed), -1), axis=1).view(f">u{size // 8}").astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """Ids (unsigned 32-bit) as a segment payload."""
    n = len(ids)
    count = -(-n // block)
    padded = np.empty(count * block, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    rows = padded.reshape(count, block)
    low = rows.min(axis=1) if count else np.zeros(0, np.uint32)
    delta = rows - low[:, None]
    need = _bits(delta)
    rank = max(0, -(-block * percentile // 100) - 1)
    width = np.sort(need, axis=1)[:, rank] if count else np.zeros(0, np.uint8)
    over = need > width[:, None]
    misses = over.sum(axis=1)
    length = 7 + (width.astype(np.int64) * block + 7) // 8 + misses * 6
    starts = np.zeros(count + 1, np.int64)
    np.cumsum(length, out=starts[1:])
    body = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        kept = np.where(over[own], np.uint32(0), delta[own])
        packed = _pack(kept, int(w))
        head = np.zeros((len(own), 7), np.uint8)
        head[:, :4] = low[own].astype("<u4").view(np.uint8).reshape(-1, 4)
        head[:, 4] = w
        head[:, 5:] = misses[own].astype("<u2").view(np.uint8).reshape(-1, 2)
        both = np.concatenate([head, packed], axis=1)
        body[starts[own][:, None] + np.arange(both.shape[1])] = both
    at = np.flatnonzero(misses)
    if len(at):
        base = starts[:-1] + 7 + (width.astype(np.int64) * block + 7) // 8
        r, c = np.nonzero(over)
        nth = np.arange(len(r)) - np.repeat(np.cumsum(misses[at]) - misses[at], misses[at])
        place = base[r] + 2 * nth
        body[place[:, None] + np.arange(2)] = c.astype("<u2").view(np.uint8).reshape(-1, 2)
        place = base[r] + 2 * misses[r] + 4 * nth
        body[place[:, None] + np.arange(4)] = delta[r, c].astype("<u4").view(np.uint8).reshape(-1, 4)
    return _HEAD.pack(MAGIC, block, n, count) + starts.astype("<u4").tobytes() + body.tobytes()


def _decode(payload: bytes, first: int, last: int) -> tuple[np.ndarray, int]:
    """The ids of blocks first to last (exclusive), and the segment's number of ids."""
    magic, block, n, count = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    raw = np.frombuffer(payload, np.uint8)
    starts = raw[_HEAD.size : _HEAD.size + 4 * (count + 1)].view("<u4").astype(np.int64)
    body = raw[_HEAD.size + 4 * (count + 1) :]
    starts = starts[first : last + 1]
    if len(starts) < 2:
        return np.zeros(0, np.uint32), n
    head = body[starts[:-1][:, None] + np.arange(7)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, misses = head[:, 4], np.ascontiguousarray(head[:, 5:]).view("<u2")[:, 0].astype(np.int64)
    out = np.empty((len(low), block), np.uint32)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        size = (int(w) * block + 7) // 8
        out[own] = _unpack(body[(starts[:-1][own] + 7)[:, None] + np.arange(size)], int(w), block)
    total = int(misses.sum())
    if total:
        r = np.repeat(np.arange(len(low)), misses)
        nth = np.arange(total) - np.repeat(np.cumsum(misses) - misses, misses)
        base = starts[:-1] + 7 + (width.astype(np.int64) * block + 7) // 8
        c = np.ascontiguousarray(body[(base[r] + 2 * nth)[:, None] + np.arange(2)]).view("<u2")[:, 0]
        v = np.ascontiguousarray(body[(base[r] + 2 * misses[r] + 4 * nth)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        out[r, c] = v
    return (out + low[:, None]).reshape(-1), n


def decode_blocks(payload: bytes) -> np.ndarray:
    """All ids of a segment payload."""
    ids, n = _decode(payload, 0, 1 << 40)
    return ids[:n]


def decode_range(payload: bytes, start: int, length: int) -> np.ndarray:
    """Ids start to start + length of a segment, from the blocks that hold them alone."""
    _, block, n, _ = _HEAD.unpack_from(payload)
    stop = min(n, start + length)
    ids, _ = _decode(payload, start // block, -(-stop // block))
    return ids[start - start // block * block :][: max(0, stop - start)]


_SEGMENTS = "part int, part_start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text, append ``end_id``, and write segments in ascending doc_id order to ``path``.

    One range exchange deals the documents out by doc_id; each task then encodes its run in order
    and holds one segment at a time. A document longer than a segment has one to itself.
    """
    spark = prepare(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("payload", pa.binary())])

    def write(batches):
        part, enc, tail = TaskContext.get().partitionId(), encoder(tokenizer_path, 400_000), int(end_id).to_bytes(4, "little")
        done, held, ids, counts = 0, [], [], []

        def flush():
            nonlocal done
            data = np.frombuffer(b"".join(held), "<u4")
            row = [[part], [done], [len(data)], [list(ids)], [list(counts)], [encode_blocks(data)]]
            done += len(data)
            held.clear(), ids.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = enc.encode(text) + tail
                if held and size + len(data) // 4 > segment_ids:
                    yield flush()
                    size = 0
                held.append(data), ids.append(doc_id), counts.append(len(data) // 4)
                size += len(data) // 4
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parallelism(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(write, _SEGMENTS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' documents: doc_id, start (ids of all documents before it), n_tokens, ids ('<u4' bytes).

    Starts come from the parts' totals: a row for each file written, a number the cluster's owner
    sets (spark.sql.shuffle.partitions), and so small enough to send to every task.
    """
    prepare(spark)
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        for batch in batches:
            cols = batch.to_pydict()
            for part, at, n, ids, counts, payload in zip(*(cols[f] for f in ("part", "part_start", "n_ids", "doc_ids", "doc_tokens", "payload"))):
                data = decode_blocks(payload).astype("<u4")
                if len(data) != n or sum(counts) != n:
                    raise ValueError("a token segment is not whole")
                ends = np.cumsum(counts)
                pieces = [data[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts)]
                for k in range(0, len(ids), 4000):
                    s = slice(k, k + 4000)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids[s]), pa.int32()), pa.array(ids[s], pa.int64()), pa.array(at + ends[s] - counts[s]), pa.array(counts[s], pa.int64()), pa.array(pieces[s], pa.binary())], schema=schema)

    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = segments.mapInArrow(read, "part int, doc_id long, at long, n_tokens long, ids binary")
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = shared_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
