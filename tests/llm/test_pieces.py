"""The transducer against the sentencepiece library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from anchorage.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_equal_the_library(library):
    machine, rng = pieces.Transducer(PATH), random.Random(3)
    texts = ["", " ", "  ", " a b  c   d", "Hello  world\n\tx é🙂 <s> ▁ </s>", "漢字かな交じり文 한국어 ﬁ Ａ", "a" * 500, " " * 50 + "x", "...???!!!", "日" * 300, "x\x00y", "don't stop"]
    texts += ["".join(rng.choices(" ab.,'\nTHe▁éßin-()09", k=rng.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        ids = np.frombuffer(machine.encode(text), "<u4").tolist()
        assert ids == library.encode(text), text
        assert machine.decode(machine.encode(text)) == library.decode(ids)


def test_documents(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pieces.op9_pieces(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        ids = np.array(library.encode(r.text), "<u4")
        assert (got[r.doc_id].n_ids, got[r.doc_id].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        assert got[r.doc_id].decoded_chars == len(r.text)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 1), (3, "w" * 20_000, 1), (4, "same", 1), (4, "same", 1)], "doc_id long, text string, ids int")
    got = pieces.encode_decode(docs, PATH).collect()
    assert len(got) == 6 and sorted(r.decoded for r in got)[:2] == ["", ""] and {r.n_ids for r in got if r.doc_id in (1, 2)} == {0}
    assert pieces.encode_decode(docs.filter("false"), PATH).count() == 0


def _lattice(machine, text):
    """The least weight of all paths through (place, last piece), by relaxing every arc from every state."""
    states = [{} for _ in range(len(text) + 1)]
    states[0][""] = (0.0, [])
    for end in range(1, len(text) + 1):
        for at in range(end):
            piece = text[at:end]
            for first, (weight, path) in states[at].items():
                if piece in machine.ids:
                    if first and machine.merge(first + piece) != [first, piece]:
                        continue
                    own = -machine.scores[piece]
                elif len(piece) == 1:
                    own = 0.0  # the only arc that crosses this character
                else:
                    continue
                if weight + own < states[end].get(piece, (np.inf,))[0]:
                    states[end][piece] = (weight + own, [*path, piece])
    return min(states[-1].values())[1]


def test_path_is_the_shortest_of_the_lattice():
    machine, rng = pieces.Transducer(PATH), random.Random(9)
    texts = ["▁unbelievable", "▁tokenization", "▁日本語", "▁straße", "▁x€y"] + ["▁" + "".join(rng.choices("abcdeiostnr", k=rng.randint(1, 14))) for _ in range(200)]
    for text in texts:
        assert machine.path(text) == _lattice(machine, text)


def test_runs_of_blanks(library):
    machine = pieces.Transducer(PATH)
    for n in [*range(0, 70), 200]:
        for tail in ("", "the", "x", "日", "...", "🙂", "\t", "1"):
            for head in ("", "a", "."):
                text = head + " " * n + tail
                assert np.frombuffer(machine.encode(text), "<u4").tolist() == library.encode(text), (n, head, tail)
