"""Operator 5 - chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turn by turn in order,

    <s>  then for each turn  <|turn|> role <|text|> text </s>

and encoded once with character offsets. The spans of the turns to learn from and the spans of the
tokens are both sorted, so a binary search finds for each token the turn span it may meet; a token
is under the loss mask if they intersect, and the mask's text is the intersection.

A control string inside a role or text gets a backslash behind its first character, and one that has
backslashes there already gets one more; taking one away restores the text. So no control string of
the output stems from a text.

Turns reach the encoder in one sorted stream for each partition. Once a conversation passes
``segment_chars``, the encoder is fed and its rows written in segments, cut behind ``<|turn`` of the
next turn. There a letter meets a sign, which the tokenizer's own splitting always parts (tested when
it is loaded; a tokenizer that does not is fed whole conversations), so ids and offsets are those of
one encoding of the whole text, and one conversation with any number of turns needs the memory of one
segment. Readers take segments up in the same way: a conversation's digests run over all its turns,
which is one stream by their definition.

Cases: null text and null role are empty; turns sort by turn (nulls first), role, text, so repeated
turns stand side by side; a null conv_id is a conversation of its own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parallelism, prepare, shared_path

# The template's control strings and those of common templates, which texts may hold.
START, TURN, TEXT, END = "<s>", "<|turn|>", "<|text|>", "</s>"
_TAILS = r"s>|/s>|\|[a-z_]+\|>|/?INST\]|</?SYS>>"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?=(?:{_TAILS}))")
_RESTORE = re.compile(rf"([<\[])\\(\\*)(?=(?:{_TAILS}))")
_HEAD = TURN[:-2]  # the part of a turn's first string that ends a segment
_TURNS = re.compile(r"(?:<\|turn|\A)\|>(.*?)<\|text\|>(.*?)</s>", re.DOTALL)
LEARN, SEGMENT_CHARS = "assistant", 1_000_000


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def restore(text: str) -> str:
    return _RESTORE.sub(r"\1\2", text)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens (sorted starts and ends) meet the sorted, disjoint spans (n, 2); the merged intersections."""
    if not len(spans) or not len(starts):
        return np.zeros(len(starts), bool), np.zeros((0, 2), np.int64)
    place = np.minimum(np.searchsorted(spans[:, 1], starts, side="right"), len(spans) - 1)
    low, high = np.maximum(starts, spans[place, 0]), np.minimum(ends, spans[place, 1])
    mask = low < high
    low, high, place = low[mask], high[mask], place[mask]
    if not len(low):
        return mask, np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(high)
    first = np.r_[True, (low[1:] > reach[:-1]) | (place[1:] != place[:-1])]
    at = np.flatnonzero(first)
    return mask, np.c_[low[at], np.maximum.reduceat(high, at)]


def parts_behind_head(tokenizer) -> bool:
    """Whether the tokenizer always splits behind ``<|turn``, so that the rest may be encoded by itself."""
    if tokenizer.normalizer is not None or tokenizer.pre_tokenizer is None:
        return False
    for before in ("", "a", ">", " ", "9", "é", "\n"):
        for role in ("user", "", " ", "<", "9", "'s"):
            whole = tokenizer.pre_tokenizer.pre_tokenize_str(f"{before}{TURN}{role}{TEXT}")
            if len(before) + len(_HEAD) not in {end for _, (_, end) in whole}:
                return False
    return True


_SEGMENTS = "conv_id long, segment int, text string, ids array<int>, mask binary, loss array<long>"


def format_chats(turns: DataFrame, tokenizer_path: str, learn: str = LEARN, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments of all conversations: text, ids, mask (a byte for each id), loss (starts and ends of its text)."""
    spark = prepare(turns.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.binary()), ("loss", pa.list_(pa.int64()))])

    def run(batches):
        from tokenizers import Tokenizer, processors

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        most = segment_chars if parts_behind_head(tokenizer) else float("inf")
        rows, parts, spans, size, current, segment = [], [], [], 0, None, 0

        def close():
            nonlocal size, segment
            text = "".join(parts)
            found = tokenizer.encode(text, add_special_tokens=False)
            offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
            mask, loss = loss_mask(offsets[:, 0], offsets[:, 1], np.array(spans, np.int64).reshape(-1, 2))
            rows.append((current[0], segment, text, found.ids, mask.astype(np.uint8).tobytes(), loss.reshape(-1).tolist()))
            parts.clear(), spans.clear()
            size, segment = 0, segment + 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if current is None or conv != current[0]:
                    if parts:
                        close()
                    current, segment, size = (conv,), 0, len(START)
                    parts.append(START)
                head, body = f"{TURN}{escape(role or '')}{TEXT}", escape(text or "")
                if size >= most:
                    parts.append(_HEAD)
                    close()
                    head = head[len(_HEAD) :]
                if role == learn and body:
                    spans.append((size + len(head), size + len(head) + len(body)))
                parts += (head, body, END)
                size += len(head) + len(body) + len(END)
                if len(rows) >= 200:
                    yield flush()
        if parts:
            close()
        if rows:
            yield flush()

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn"))
    rows = rows.repartition(parallelism(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, _SEGMENTS)


def read_chats(segments: DataFrame) -> DataFrame:
    """What the segments hold, for each conversation: counts and digests of turns and of the loss text."""
    spark = prepare(segments.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("loss_tokens", pa.int64())])

    def run(batches):
        current, state, rows = None, None, []

        def close():
            rows.append((current[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

        for batch in batches:
            for conv, text, mask, loss in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if current is None or conv != current[0]:
                    if current is not None:
                        close()
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, body in _TURNS.findall(text):
                    state[0] += 1
                    state[1].update(f"{restore(role)}\n{restore(body)}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(loss[::2], loss[1::2]):
                    plain = restore(text[a:b])
                    state[2] += len(plain)
                    state[3].update(plain.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += len(mask)
                state[6] += mask.count(1)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
                rows.clear()
        if current is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    rows = segments.select("conv_id", "segment", "text", "mask", "loss").repartition(parallelism(spark), "conv_id").sortWithinPartitions("conv_id", "segment")
    return rows.select("conv_id", "text", "mask", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1 formatted, written, and read back."""
    import public_tokenizers

    prepare(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    path = shared_path(spark, "chats")
    format_chats(turns, public_tokenizers.path("byte_bpe_50k.json")).write.option("compression", "zstd").parquet(path)
    return read_chats(spark.read.schema(_SEGMENTS).parquet(path))
