"""Operator 3 - sequence packing by Karmarkar-Karp multiway differencing.

Documents become ids and an end id. What a document has beyond whole windows joins a group; a
group closes when its remainders fill a fixed number of windows but for a small slack (the last
document is cut there, its rest opens the next group). Differencing then deals a group's pieces to
windows: each piece starts as a partial partition, and the two partial partitions with the largest
spreads are merged again and again, the heaviest window of one onto the lightest of the other, until
one near-equal partition is left. If a window of it holds more than its capacity, the number of
windows rises by one and the group is partitioned again.

Everything happens within the input's own partitions: no exchange, memory of one group a task, and
a lost task is simply run again with the same result. A sequence's id is the partition's number
times 2**32 and a count.

Cases: null or empty text is the end id alone; a repeated doc_id is packed as often as it stands;
null doc_ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare
from .tokens import encoder

CAPACITY, GROUP_WINDOWS, SLACK = 4096, 256, 16


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the indices of ``sizes`` dealt to ``windows`` lists of near-equal sums."""
    if not sizes:
        return [[] for _ in range(windows)]
    left, right = [-1] * len(sizes), [-1] * len(sizes)  # node i < len(sizes) is piece i, others join two nodes
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        heads = np.full(windows, -1, np.int64)
        sums[0], heads[0] = size, i
        heap.append((-size if windows > 1 else 0, i, sums, heads))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        total, y = a + b[::-1], y[::-1]
        both = np.flatnonzero((x >= 0) & (y >= 0))
        heads = np.where(x >= 0, x, y)
        heads[both] = np.arange(len(left), len(left) + len(both))
        left += x[both].tolist()
        right += y[both].tolist()
        rank = np.argsort(-total, kind="stable")
        total, heads = total[rank], heads[rank]
        total = total - total[-1]
        order += 1
        heapq.heappush(heap, (-int(total[0]), order, total, heads))
    out = []
    for head in heap[0][3].tolist():
        found, stack = [], [head] if head >= 0 else []
        while stack:
            node = stack.pop()
            if left[node] < 0:
                found.append(node)
            else:
                stack += (right[node], left[node])
        out.append(sorted(found))
    return out


def pack_group(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows for pieces of at most ``capacity``; one more window while any is over it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in dealt) <= capacity:
            return [w for w in dealt if w]
        windows += 1


_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, slack: int = SLACK) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids, with the ids ('<u4' bytes)."""
    prepare(docs.sparkSession)
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])

    def run(batches):
        enc, tail = encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 32
        sequence, pieces, filled = 0, [], 0
        room = group_windows * (capacity - slack)
        rows: list[tuple] = []

        def place(window):
            nonlocal sequence
            offset = 0
            for doc_id, start, total, data in window:
                rows.append((doc_id, start, len(data) // 4, total, base + sequence, offset, data))
                offset += len(data) // 4
            sequence += 1

        def close():
            nonlocal filled
            for window in pack_group([len(p[3]) // 4 for p in pieces], capacity):
                place([pieces[i] for i in window])
            pieces.clear()
            filled = 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = enc.encode(text) + tail
                total, start = len(data) // 4, 0
                while total - start >= capacity:
                    place([(doc_id, start, total, data[4 * start : 4 * (start + capacity)])])
                    start += capacity
                while start < total:
                    length = min(total - start, room - filled)
                    pieces.append((doc_id, start, total, data[4 * start : 4 * (start + length)]))
                    start, filled = start + length, filled + length
                    if filled == room:
                        close()
                if len(rows) >= 2000:
                    yield flush()
        if pieces:
            close()
        if rows:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed: a row for each piece, with the checksum of its ids."""
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
