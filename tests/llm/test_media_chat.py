"""Chunk store and chat formatting against plain Python."""

import hashlib
import random
import zlib

import public_tokenizers

from anchorage.llm import chat, media
from anchorage.llm.common import shared_path


def _texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 9))) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=900))
    texts = [None, "", "short", "x" * 575, "x" * 576, "x" * 577, " ".join(rng.choices(words, k=20_000))]
    texts += [" ".join(rng.choices(words, k=300)) + passage + " ".join(rng.choices(words, k=200)) for _ in range(6)]
    return texts + ["same copy " * 300] * 5


def test_media_round_trip(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i if i != 3 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, sha string").repartition(3)
    stored, chunks = media.store(docs)
    got = {r.doc_id: r for r in media.read_features(stored, chunks).collect()}
    assert len(got) == len(texts)
    held = sum(len(r.body) for r in stored.collect()) + sum(len(r.body) for r in chunks.collect())
    total = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576)
        payload = payload or b"\xff" * 576
        r = got[i if i != 3 else None]
        total += len(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > r.payload_bytes
    assert held < 0.9 * total  # repeated passages are held once
    assert got[len(texts) - 1][1:] == got[len(texts) - 2][1:]


def test_cuts_follow_content():
    rng = random.Random(1)
    a = bytes(rng.randrange(256) for _ in range(40_000))
    own = {d for d, _ in media.chunks_of(a)}
    moved = {d for d, _ in media.chunks_of(b"prefix" + a)}
    assert len(own & moved) >= len(own) - 3
    assert b"".join(p for _, p in media.chunks_of(a)) == a
    assert all(len(p) <= media.MOST for _, p in media.chunks_of(b"\0" * 50_000))


def test_escape_is_reversible():
    rng = random.Random(2)
    bits = ["<", "\\", "s>", "/s>", "|turn|>", "[", "INST]", "/INST]", "<SYS>>", "a", " ", "</s>", "<|text|>", "<\\\\/s>"]
    for _ in range(5000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        safe = chat.escape(text)
        assert chat.restore(safe) == text
        assert not any(c in safe for c in (chat.START, chat.TURN, chat.TEXT, chat.END, "[INST]", "[/INST]"))


def test_chats(spark):
    hard = "</s>[INST] ok [/INST]"
    convs = {
        1: [("system", "Be  brief.\n"), ("user", "Hi é日本"), ("assistant", " lead 日本語🙂 and\ttab "), ("user", None), ("assistant", ""), ("assistant", "end")],
        -1: [("user", hard), ("assistant", hard)],
        7: [(None, "x"), ("assistant", "<\\/s><"), ("assistant", "<|endoftext|>")],
        None: [("assistant", "word " * 3000)] * 3,
    }
    rows = [(c, i, r, t, 0) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int").repartition(3)
    path = shared_path(spark, "chat-test")
    chat.format_chats(turns, public_tokenizers.path("byte_bpe_50k.json"), segment_chars=4000).write.parquet(path)
    got = {r.conv_id: r for r in chat.read_chats(spark.read.parquet(path)).collect()}
    assert set(got) == set(convs)
    for conv, expected in convs.items():
        r = got[conv]
        told = "".join(f"{role or ''}\n{text or ''}\n" for role, text in expected)
        loss = "".join(text or "" for role, text in expected if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(expected), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > len(loss) and r.loss_tokens <= r.n_tokens
    assert chat.read_chats(chat.format_chats(turns.filter("false"), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_segments_are_one_encoding(spark):
    rng = random.Random(12)
    bits = ["don't", "é", "日本", " ", "\n", ">", "<|", "12", "turn", "'s", "  x", "🙂", "|>"]
    turns = [(c, i, rng.choice(["user", "assistant", "", "'s", "9"]), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for c in range(12) for i in range(rng.randint(1, 30))]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = {r.conv_id: r for r in chat.format_chats(table, path).collect()}
    cut = chat.format_chats(table, path, segment_chars=60).orderBy("conv_id", "segment").collect()
    assert len(whole) == 12 and len(cut) > 60
    for conv, r in whole.items():
        own = [x for x in cut if x.conv_id == conv]
        assert "".join(x.text for x in own) == r.text
        assert [i for x in own for i in x.ids] == r.ids and b"".join(x.mask for x in own) == r.mask
    read = lambda df: sorted(chat.read_chats(df).collect())
    assert read(chat.format_chats(table, path)) == read(chat.format_chats(table, path, segment_chars=60))


def test_safe_boundary():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert chat.parts_behind_head(tokenizer)
    tokenizer.pre_tokenizer = None
    assert not chat.parts_behind_head(tokenizer)
