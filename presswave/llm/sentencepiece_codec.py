"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The automaton reads a text once; at every position its output links give all pieces that end there, and
each relaxes the best score of that position. The score of a segmentation is the sum of its pieces' scores
(the unigram reading of a vocabulary), whatever algorithm trained the vocabulary. A character that no
piece covers costs the least score less ten and is written as byte pieces.

No piece has the word mark after another character, so the best path goes through every word's start and
words are segmented one by one; a word met before is remembered up to a bound. Decoding joins the pieces,
bytes included, and drops the mark that encoding put in front.

Rows: null text counts as empty and has no ids. Rows may repeat. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswave.llm.lookup import Remembered, gathered, slices

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
REMEMBERED = 1 << 20


class Codec:
    """A vocabulary: its automaton, what it remembers of segments, and the bytes of its pieces."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(k) for k in range(size)]
        self.byte_ids, self.byte_of = [0] * 256, {}
        self.automaton = ahocorasick.Automaton()
        self.control = {k for k in range(size) if model.is_control(k) or model.is_unknown(k)}
        least = 0.0
        for k, piece in enumerate(self.pieces):
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)], self.byte_of[k] = k, int(piece[3:5], 16)
            elif k not in self.control and not model.is_unused(k):
                least = min(least, model.get_score(k))
                self.automaton.add_word(piece, (k, len(piece), model.get_score(k)))
        self.automaton.make_automaton()
        self.unknown = least - 10.0
        self.known = Remembered(lambda words: [self.viterbi(MARK + x) for x in words], REMEMBERED)
        written = [bytes([self.byte_of[k]]) if k in self.byte_of else b"" if k in self.control else x.replace(MARK, " ").encode() for k, x in enumerate(self.pieces)]
        self.bytes, self.sizes = np.frombuffer(b"".join(written), np.uint8), np.array([len(x) for x in written])
        self.starts = self.sizes.cumsum() - self.sizes

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best segmentation; of equal scores the longer last piece."""
        n = len(text)
        best, back = [0.0] + [-np.inf] * n, [(-1, 0)] * (n + 1)
        at = 0  # positions before ``at`` are settled
        for end, (k, size, score) in self.automaton.iter(text):
            while at <= end:
                at += 1
                best[at], back[at] = best[at - 1] + self.unknown, (-1, 1)
            if (total := best[end + 1 - size] + score) > best[end + 1] or total == best[end + 1] and size > back[end + 1][1]:
                best[end + 1], back[end + 1] = total, (k, size)
        while at < n:
            at += 1
            best[at], back[at] = best[at - 1] + self.unknown, (-1, 1)
        out: list[int] = []
        while n:
            k, size = back[n]
            out += [k] if k >= 0 else [self.byte_ids[b] for b in reversed(text[n - 1].encode("utf-8", "replace"))]
            n -= size
        return out[::-1]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. A segment is a word after its marks; its first mark is left out of its name."""
        split = lambda x: x.split(" ") if "  " not in x and MARK not in x and x[-1] != " " and x[0] != " " else [w[1:] for w in SEGMENT.findall(MARK + x.replace(" ", MARK))]
        return self.known.ids([split(x) if x else [] for x in texts])

    def decode(self, ids: np.ndarray) -> str:
        return gathered(self.bytes, self.starts[ids], self.sizes[ids]).tobytes().decode("utf-8", "replace").removeprefix(" ")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _kind(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for part in slices(batches, "text"):
            ids = list(one.encode(part.column(1).to_pylist()))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "n_ids", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {_kind(docs)}, n_ids long, ids array<int>")


def texts(one: Codec, ids: pa.ListArray) -> Iterator[str]:
    """The texts of arrays of ids; null ids give the empty text."""
    flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return (one.decode(flat[i:j]) if known else "" for i, j, known in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text for every row of ``encoded`` (doc_id, ids); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(texts(one, batch.column(1))), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_kind(encoded)}, text string")


def roundtrip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids and decoded_sha256 (of what decoding the ids gives) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model)
        for batch in batches:
            told = [hashlib.sha256(x.encode()).hexdigest() for x in texts(one, batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string())], [*batch.schema.names, "decoded_sha256"])

    return encode(docs, model).mapInArrow(run, f"doc_id {_kind(docs)}, n_ids long, ids array<int>, decoded_sha256 string")
