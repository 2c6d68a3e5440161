"""Token files and packing against whole-text encoding."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from anchorage.llm import packing, token_files
from anchorage.llm.common import shared_path
from anchorage.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Plain words, here.\nAnd there!", "İstanbul ǅ ß ẞ don't I'LL x́ Å ſ 12,3 a\x1cb <|endoftext|> z", "word " * 9000, "é" * 700, "日本語 text 12.5%", "same", "same"]
SCHEMA = "doc_id long, text string, extra int"


@pytest.fixture(scope="module")
def enc():
    return WordEncoder(PATH)


def test_encoder_equals_whole_text(enc):
    for text in TEXTS:
        assert enc.encode(text) == (enc.whole(text) if text else b"")


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype(np.uint32)
    ids[::17] = 2**32 - 1
    payload = token_files.encode_blocks(ids)
    assert (token_files.decode_blocks(payload) == ids).all()
    assert (token_files.decode_range(payload, n // 3, 200) == ids[n // 3 : n // 3 + 200]).all()


def test_token_files(spark, enc):
    docs = spark.createDataFrame([(10 * i if i != 4 else None, t, 1) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    path = shared_path(spark, "t")
    token_files.write_token_files(docs, PATH, path, segment_ids=100)
    got = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_files.read_token_files(spark, path).collect())
    start, order = 0, [4, 0, 1, 2, 3, 5, 6, 7, 8]
    for row, i in zip(got, order, strict=True):
        want = enc.encode(TEXTS[i]) + b"\1\0\0\0"
        assert row == (start, None if i == 4 else 10 * i, len(want) // 4, want)
        start += len(want) // 4


def test_token_files_empty(spark):
    path = shared_path(spark, "t")
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), PATH, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_packing(spark, enc):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], SCHEMA).repartition(2)
    pieces, rows = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, PATH, group_windows=2).collect():
        pieces[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        rows[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(TEXTS):
        want = enc.encode(text) + b"\2\0\0\0"
        got = sorted(pieces[i])
        assert b"".join(p[2] for p in got) == want and {p[3] for p in got} == {len(want) // 4}
        assert [p[0] for p in got] == np.cumsum([0] + [p[1] for p in got])[:-1].tolist()
    for parts in rows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 900, 400).tolist()
    dealt = packing.differencing(sizes, 16)
    assert sorted(i for w in dealt for i in w) == list(range(400))
    sums = [sum(sizes[i] for i in w) for w in dealt]
    assert max(sums) - min(sums) < 60
    assert all(sum([3000, 3000, 3000][i] for i in w) <= 4096 for w in packing.pack_group([3000, 3000, 3000]))


def test_query_checksums(spark):
    rows = token_files.op1_token_files(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(0 <= r.ids_crc32 < 2**32 for r in rows)
