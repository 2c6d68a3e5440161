"""Operator 9 - SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the vocabulary file:

- the normaliser, one state behind its start: the dummy prefix (nothing to a mark, at the start), blank
  to mark, every other character to itself;
- the pieces: an arc for each piece, which reads its characters, writes its id and weighs its negative
  score, and an arc for each whole run of marks, which writes the run's pieces;
- byte fallback: the only arc of a character that is no piece, which writes the ids of its bytes.

The vocabulary being one of merges, a fourth machine without output weighs pairs of neighbouring pieces:
zero where merging the two pieces' text alone gives these two pieces, infinity elsewhere; its state is
the last piece. Composed with an input the machines are a lattice whose states are (place, last
piece), and the weights of a path add up. The shortest path in the tropical semiring (minimum over
paths, sum along a path) is found from left to right by relaxing all arcs into a place; as all but one
of the last pieces have no finite path, a place keeps one state, the last piece of its shortest path.

No piece spans two words or a pair of characters that stands in no piece, so an input is cut there
before composition, and a stretch's path is kept for the next time.

Decoding is the inverse machine: piece texts in a row, byte pieces as UTF-8, marks to blanks, the
dummy prefix taken off.

Cases: null and empty texts have no pieces and decode to an empty text; a mark in a text decodes to
a blank, as with the library; repeated rows are encoded alike; null doc_ids are kept; an empty table
gives no rows; other columns are ignored. Very long stretches without a blank take time in proportion
to their length.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

MARK = "▁"
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_STRETCHES = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NORMAL = str.maketrans({" ": MARK})  # the normaliser's arcs that change a character


class Transducer(dict):
    """Maps a stretch of normalised text to its ids as '<u4' bytes; missing ones are composed and searched."""

    def __init__(self, path: str, keep: int = 300_000):
        import ahocorasick
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.decode(model.encode(" a  ﬁ ")) != " a  ﬁ ":
            raise ValueError("the model's normaliser does more than prefix and marks")
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(MARK * 2 in p and p.strip(MARK) for p in self.ids):
            raise ValueError("a piece joins a run of marks and other characters")
        self.keep, self.units = keep, _Units(self)
        # an arc: its length, its weight, its piece, and whether it may stand behind a piece, filled as pairs are met
        self.arcs = {p: (len(p), -score, p, {"": True}) for p, score in self.scores.items()}
        self.reader = ahocorasick.Automaton()  # reads a text and gives the arcs into each of its places
        for p, arc in self.arcs.items():
            self.reader.add_word(p, arc)
        self.reader.make_automaton()
        self.known = frozenset(p for p in self.arcs if len(p) == 1)
        self.runs: dict[int, list[str]] = {}
        self.texts = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}

    # ---- pieces of a stretch

    def merge(self, text: str) -> list[str]:
        """Merge neighbours in the order of the scores, the leftmost of equal ones first."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-self.scores[text[i : i + 2]], i, text[i : i + 2]) for i in range(len(parts) - 1) if text[i : i + 2] in self.scores]
        heapq.heapify(heap)

        def offer(i, j):
            both = parts[i] + parts[j]
            if both in self.scores:
                heapq.heappush(heap, (-self.scores[both], i, both))

        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def follows(self, first: str, second: str) -> bool:
        """Whether the second piece may stand behind the first: the pair weighs zero, not infinity."""
        own = self.arcs[second][3]
        if first not in own:
            own[first] = self.merge(first + second) == [first, second]
        return own[first]

    def run(self, n: int) -> list[str]:
        """The pieces of the arc for a run of n marks."""
        if n not in self.runs:
            self.runs[n] = self.merge(MARK * n)
        return self.runs[n]

    def path(self, text: str) -> list[str]:
        """The shortest path's pieces; a character that is no piece stands for its bytes."""
        if not self.known.issuperset(text):  # no arc but its fallback crosses such a character
            at = next(k for k, c in enumerate(text) if c not in self.known)
            return [*(self.path(text[:at]) if at else ()), text[at], *(self.path(text[at + 1 :]) if at + 1 < len(text) else ())]
        size, marks = len(text), 0
        dist, last, back = [math.inf] * (size + 1), [""] * (size + 1), [0] * (size + 1)
        dist[0] = 0.0
        if text.startswith(MARK * 2):  # a run is read by its own arcs: the whole of it, or all but the mark that the word may take
            marks = size - len(text.lstrip(MARK))
            for n in (marks - 1, marks):
                dist[n], last[n] = sum(self.arcs[p][1] for p in self.run(n)), self.run(n)[-1]
            dist[0] = math.inf
        for place, (n, weight, piece, behind) in self.reader.iter(text):
            place += 1
            total = dist[place - n] + weight
            if total < dist[place] and place > marks:
                first = last[place - n]
                valid = behind.get(first)
                if valid or (valid is None and self.follows(first, piece)):
                    dist[place], last[place], back[place] = total, piece, place - n
        out, end = [], size
        while end:
            if end <= marks:
                return self.run(end) + out[::-1]
            out.append(last[end])
            end = back[end]
        return out[::-1]

    def __missing__(self, stretch: str) -> bytes:
        """Ids of blanks and a word: cut where no piece can span, then the path of each part."""
        text = stretch if stretch.startswith(MARK) else MARK + stretch
        word = text.rstrip(_PUNCTUATION)
        if len(word) > 1 and word[1:].isalpha() and (len(word) == len(text) or text[len(word) - 1 : len(word) + 1] not in self.pairs):
            out = self.units[word] + (self.units[text[len(word) :]] if len(word) < len(text) else b"")
        else:
            cuts = [0, *(k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.pairs), len(text)]
            out = b"".join([self.units[text[a:b]] for a, b in zip(cuts, cuts[1:])])
        if len(self) < self.keep and len(stretch) < 48:
            self[stretch] = out
        return out

    # ---- whole texts

    def encode(self, text: str | None) -> bytes:
        """All ids of a whole text."""
        if not text:
            return b""
        normal = MARK + text.translate(_NORMAL)
        if MARK * 2 not in normal and normal[-1] != MARK:
            return b"".join(map(self.__getitem__, normal[1:].split(MARK)))
        return b"".join(map(self.__getitem__, _STRETCHES.findall(normal)))

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class _Units(dict):
    """Ids of parts that no piece spans."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, unit: str) -> bytes:
        o, out = self.owner, []
        for piece in o.path(unit):
            if piece in o.ids:
                out.append(o.ids[piece])
            else:
                out += [o.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        data = np.array(out, "<u4").tobytes()
        if len(self) < 2 * o.keep and len(unit) < 48:
            self[unit] = data
        return data


_MACHINES: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's machine for a model file, kept between tasks."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


_ROWS = "doc_id long, n_ids long, ids binary, decoded string"


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids ('<u4' bytes) and the text decoded from them, of every whole text."""
    prepare(docs.sparkSession)

    def run(batches):
        machine = transducer(model_path)
        for batch in batches:
            ids = [machine.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([machine.decode(i) for i in ids], pa.string())], names=["doc_id", "n_ids", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ROWS)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids and decoded texts, as checksums."""
    import public_tokenizers

    found = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))
