"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model is compiled to three machines: the normaliser, one state whose arcs rewrite characters (spaces become U+2581); the
pieces, a trie whose states list their arcs by character and whose accepting states give a piece and its weight, with
byte fallback for characters that no arc leads over; and the acceptor of pairs of neighbouring pieces. They are composed
with each input as far as the search asks for it, and the path of least weight is taken, weights being added along a path
and the least chosen between paths (the tropical semiring).

For a unigram model a piece weighs its negative score, every pair is accepted, and states are positions, relaxed in order.
For a merge model scores are ranks, not costs: what counts is whether merging the joint text of two neighbours leaves
exactly these two. Accepted pairs then weigh nothing and all others infinitely much; states are (position, last piece),
and the farthest is expanded first. One path has finite weight, the model's own segmentation: no merge of the whole text can
cross a border that the two pieces beside it keep.

No piece crosses certain borders, such as the one before a space; texts are cut there, and each distinct part is
searched once in a worker as long as it is remembered.

Cases: null texts count as empty; an empty text has no pieces; unknown characters become byte pieces (in models without
them a run of unknown characters becomes one unknown piece); decoding gives the text back except that U+2581 becomes a space;
rows that repeat are rows of their own; empty tables give an empty result; other columns are carried along by
``encode_pieces``, but for those called like its results, which are replaced.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import Memo, table

SPACE = "▁"
#: Parts of texts and pairs of pieces in each of the two generations that a worker remembers: some 200 MB in all.
PARTS, PAIRS = 300_000, 150_000
#: Texts that a worker holds at once.
ROWS = 256


class Transducer:
    """A compiled model: encode and decode."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        self.merges = model.trainer_spec.model_type == pb.TrainerSpec.BPE
        if spec.precompiled_charsmap or not (self.merges or model.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge and unigram models without a character map are supported")
        #: The normaliser's arcs.
        self.rewrites = {" ": SPACE}
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        #: What an unknown character weighs: the lowest score and a fixed penalty.
        self.unknown_weight = 10.0 - min(self.score.values(), default=0.0)
        bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.bytes_of = [bytes_of.get(i, p.piece.encode() if p.type == kinds.NORMAL else b"") for i, p in enumerate(model.pieces)]
        self.arcs, self.weights = self._trie()
        self.split = self._borders()
        self.pairs = Memo(lambda pair: self._merged(pair[0] + pair[1]) == list(pair), PAIRS)
        self.parts = Memo(self._part, PARTS)

    def _trie(self) -> tuple[list[dict[str, int]], list[float | None]]:
        """The machine of pieces: each state's arcs, and the weight of the piece that it accepts (None: no piece)."""
        arcs: list[dict[str, int]] = [{}]
        weights: list[float | None] = [None]
        for piece, score in self.score.items():
            state = 0
            for c in piece:
                if c not in arcs[state]:
                    arcs[state][c] = len(arcs)
                    arcs.append({})
                    weights.append(None)
                state = arcs[state][c]
            weights[state] = 0.0 if self.merges else -score
        return arcs, weights

    def _outgoing(self, text: str, at: int) -> list[tuple[int, float]]:
        """The ends and weights of the pieces from a position on; byte fallback where no piece is one character long."""
        arcs, weights, state, out, end = self.arcs, self.weights, 0, [], at
        while end < len(text) and (state := arcs[state].get(text[end], 0)):
            end += 1
            if weights[state] is not None:
                out.append((end, weights[state]))
        if not out or out[0][0] != at + 1:
            out.insert(0, (at + 1, 0.0 if self.merges else self.unknown_weight))
        return out

    def _borders(self):
        """A pattern that cuts a text where no piece has two such characters side by side.

        Texts are cut while their spaces still stand for U+2581: parts of Latin letters take half the memory that way.
        """
        inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        if any(x[1] == SPACE != x[0] for x in inside):
            return re.compile(r"[\s\S]+").findall
        signs = set(string.punctuation)
        while bad := {x[1] for x in inside if x[1] in signs and x[0] not in signs and x[0] != SPACE}:
            signs -= bad
        s = re.escape("".join(sorted(signs)))
        return re.compile(f" *[{s}]+[^ {s}]*| *[^ {s}]+| +" if signs else " *[^ ]+| +").findall

    def _merged(self, text: str) -> list[str]:
        """The short text's segmentation by the merge rule: best score first, leftmost of equals."""
        part, score = list(text), self.score
        while len(part) > 1:
            best, at = None, -1
            for i in range(len(part) - 1):
                x = score.get(part[i] + part[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            part[at : at + 2] = [part[at] + part[at + 1]]
        return part

    def _path(self, text: str) -> list[str]:
        """The pieces (or single unknown characters) on the path of least weight."""
        return self._accepted_path(text) if self.merges else self._cheapest_path(text)

    def _accepted_path(self, text: str) -> list[str]:
        """Best first over states (position, last piece), composed as they are reached."""
        n, pairs, start = len(text), self.pairs, (0, "")
        before: dict[tuple[int, str], tuple[int, str]] = {start: start}
        queue = [(0.0, 0, "")]
        while queue:
            weight, at, last = heappop(queue)
            at = -at
            if at == n:
                break
            for end, more in self._outgoing(text, at):
                piece = text[at:end]
                if (end, piece) not in before and (not at or pairs[last, piece]):
                    before[end, piece] = (at, last)
                    heappush(queue, (weight + more, -end, piece))
        path, state = [], (at, last)
        while state != start:
            path.append(state[1])
            state = before[state]
        return path[::-1]

    def _cheapest_path(self, text: str) -> list[str]:
        """Relaxation of the positions in order; of equal weights the longer last piece stays."""
        n = len(text)
        least, before = [0.0] + [inf] * n, [0] * (n + 1)
        for at in range(n):
            for end, weight in self._outgoing(text, at):
                if least[at] + weight < least[end]:
                    least[end], before[end] = least[at] + weight, at
        path, end = [], n
        while end:
            path.append(text[before[end] : end])
            end = before[end]
        return path[::-1]

    def _part(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self._path("".join([self.rewrites.get(c, c) for c in text])):
            i = self.ids.get(piece)
            if i is not None:
                ids.append(i)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]
            else:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return b""
        text = (" " if self.prefix else "") + text.replace(SPACE, " ")
        coded = b"".join(map(self.parts.__getitem__, self.split(text)))
        if not self.byte_ids:
            ids = np.frombuffer(coded, "<u4")
            coded = ids[np.r_[True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)]].tobytes()
        return coded

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def transducer(path: str) -> Transducer:
    """One compiled transducer a worker."""
    return Transducer(path)


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "piece_ids", spelled_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of the text's pieces as array<int>, and, if named, what they spell as a further column.

    Rows pass in slices of ROWS, so that a worker holds few texts at once, and both directions share one transducer.
    """
    docs = docs.drop(ids_col, *[spelled_col] * bool(spelled_col))
    more = [StructField(ids_col, ArrayType(IntegerType())), *([StructField(spelled_col, StringType())] if spelled_col else [])]
    schema = StructType([*docs.schema.fields, *more])

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        t = transducer(model)
        for whole in parts:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [t.encode(x or "") for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))]
                if spelled_col:
                    made.append(pa.array([t.decode(np.frombuffer(x, "<u4")) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_pieces(coded: DataFrame, model: str, ids_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """``coded`` with ``text_col`` set to the text that the ids spell."""

    @F.pandas_udf("string")
    def spell(ids: pd.Series) -> pd.Series:
        t = transducer(model)
        return ids.map(lambda x: t.decode(np.asarray(x, np.int64)))

    return coded.withColumn(text_col, spell(ids_col))


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and round_trip."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(model)
        for pdf in parts:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                coded = t.encode(text)
                out.append((i, len(coded) // 4, zlib.crc32(coded), t.decode(np.frombuffer(coded, "<u4")) == text.replace(SPACE, " ")))
            yield pd.DataFrame(out, columns=["doc_id", "n_pieces", "ids_crc32", "round_trip"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"), model_path())


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLE: dict = {}
