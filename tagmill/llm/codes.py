"""Token ids in files of directly addressable codes.

A file holds whole documents. Ids are replaced by their frequency rank in the file (the code book lists the ids by rank)
and cut into bytes, low byte first: level 0 has the low byte of every rank, level 1 the next byte of those that have
one, and so on. A bitmap for each level says which ranks continue, and a directory with the count of ones before every
512th bit turns a position of one level into that of the next, so that any single token is read with a few look-ups and
no block is decoded. All numbers are little-endian:

    8 bytes TGMDAC01 | u64 documents | u64 ids | u64 code book size | u64 levels | documents x i64 doc_id
    | documents x u8 doc_id is null | (documents + 1) x u64 start | code book x u32
    | for each level: u64 n, n x u8 chunks, ceil(n / 8) x u8 bitmap (bit 0 first), (n // 512 + 1) x u64 directory

Files are written by Spark tasks to the shared folder under names of their own attempt; the manifest (a row a file) is
checkpointed, so a task that runs again neither harms nor doubles what is listed.

Cases: a null text counts as empty; null doc_ids come first; rows that repeat a doc_id are ordered by a hash of the text
and are documents of their own; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, new_folder, table

MAGIC, BLOCK = b"TGMDAC01", 512
#: A file is closed when it holds so many ids; a task that reads it holds about 16 bytes for each.
FILE_IDS = 2_000_000
#: Words in each of the two generations that a worker remembers: some 250 MB in all.
CACHED_WORDS = 600_000
#: Longer words (bytes) are not remembered.
LONGEST_WORD = 64
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file's bytes."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    book = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.uint32)
    rank = np.zeros(len(counts), np.uint32)
    rank[book] = np.arange(len(book), dtype=np.uint32)
    levels, rest = [], rank[ids] if len(ids) else np.zeros(0, np.uint32)
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        before = np.concatenate([[0], np.cumsum(_ONES[bits], dtype=np.uint64)])[:: BLOCK // 8][: len(rest) // BLOCK + 1].astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + before.tobytes())
        rest = rest[more] >> 8
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.uint64)]).astype("<u8")
    head = MAGIC + struct.pack("<4Q", len(doc_ids), len(ids), len(book), len(levels))
    named = np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array([i is None for i in doc_ids], np.uint8).tobytes()
    return b"".join([head, named, starts.tobytes(), book.astype("<u4").tobytes(), *levels])


class Codes:
    """A file's content: documents, single tokens and runs of tokens."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of token codes")
        n_docs, self.n_ids, n_book, n_levels = struct.unpack_from("<4Q", data, 8)
        self._data, self._at = data, 40
        doc_ids, null = self._take("<i8", n_docs), self._take("u1", n_docs)
        self.doc_ids = [None if no else int(i) for i, no in zip(doc_ids, null, strict=True)]
        self.starts, self.book, self.levels = self._take("<u8", n_docs + 1), self._take("<u4", n_book), []
        for _ in range(n_levels):
            n = int(self._take("<u8", 1)[0])
            self.levels.append((self._take("u1", n), self._take("u1", -(-n // 8)), self._take("<u8", n // BLOCK + 1)))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def token(self, i: int) -> int:
        """The id at position i of the file, by itself."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        rank = 0
        for k, (chunks, bits, before) in enumerate(self.levels):
            rank |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            start = i // BLOCK * (BLOCK // 8)
            i = int(before[i // BLOCK]) + int(_ONES[bits[start : i >> 3]].sum()) + int(_ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)])
        return int(self.book[rank])

    def tokens(self) -> np.ndarray:
        """All ids."""
        rank, at = np.zeros(self.n_ids, np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            part = chunks.astype(np.uint32) << np.uint32(8 * k)
            if at is None:
                rank, at = part, more
            else:
                rank[at] |= part
                at = at[more]
        return self.book[rank] if self.n_ids else np.zeros(0, np.uint32)


class RangedCodes:
    """Single tokens of a file that stays in its store: each takes a few reads of at most BLOCK / 8 bytes a level.

    ``read_at(size, offset)`` reads a range, as that of a file opened by pyarrow does.
    """

    def __init__(self, read_at: Callable[[int, int], bytes]):
        self._read = read_at
        magic, n_docs, self.n_ids, n_book, n_levels = struct.unpack("<8s4Q", read_at(40, 0))
        if magic != MAGIC:
            raise ValueError("not a file of token codes")
        self._starts = 40 + 9 * n_docs
        self._book = self._starts + 8 * (n_docs + 1)
        at, self._levels = self._book + 4 * n_book, []
        for _ in range(n_levels):
            n = self._number("<Q", at)
            bits = at + 8 + n
            self._levels.append((at + 8, bits, bits + -(-n // 8)))
            at = bits + -(-n // 8) + 8 * (n // BLOCK + 1)

    def _number(self, kind: str, at: int) -> int:
        return struct.unpack(kind, self._read(struct.calcsize(kind), at))[0]

    def start(self, document: int) -> int:
        """Where the ids of the document with this number begin."""
        return self._number("<Q", self._starts + 8 * document)

    def token(self, i: int) -> int:
        """The id at position i of the file."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        rank = 0
        for k, (chunks, bits, before) in enumerate(self._levels):
            rank |= self._number("<B", chunks + i) << (8 * k)
            first = i // BLOCK * (BLOCK // 8)
            part = np.frombuffer(self._read(i // 8 - first + 1, bits + first), np.uint8)
            if not part[-1] >> (i & 7) & 1:
                break
            i = self._number("<Q", before + 8 * (i // BLOCK)) + int(_ONES[part[:-1]].sum()) + int(_ONES[part[-1] & ((1 << (i & 7)) - 1)])
        return self._number("<I", self._book + 4 * rank)


def open_codes(file: str) -> RangedCodes:
    """A file of the manifest, for single tokens."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(file)
    return RangedCodes(where.open_input_file(path).read_at)


class WordEncoder:
    """Ids of whole texts. Words between ASCII white space are encoded on their own: no rule of the tokenizer looks across.

    Ids of words are remembered in two generations: when the young one is full it becomes the old one, and words that are
    met again move on. A word that ends in TAILS after a letter or digit is put together from its two parts, which the
    tokenizer's own rules keep apart; texts of Latin letters are lower-cased first, as the tokenizer does itself.
    """

    TAILS = b".,;:!?&$#*%"
    #: Where Python's lower case could differ from the tokenizer's, the text is left as it is.
    _other = re.compile("[^\x00-\u012f\u0131-\u024f]").search

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = (text if self._other(text) else text.lower()).encode("utf-8", "surrogatepass").split()
        found = list(map(self._young.get, words))
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps:
            absent = {words[i] for i in gaps}
            if len(self._young) + len(absent) > CACHED_WORDS:
                self._old, self._young = self._young, {}
            self._learn(absent)
            young = self._young
            for i in gaps:
                found[i] = young[words[i]]
            for w in absent:
                if len(w) > LONGEST_WORD:
                    del young[w]  # memory is bounded in bytes too
        return b"".join(found)

    def _remembered(self, words: set[bytes]) -> set[bytes]:
        """Moves what the old generation knows to the young one, and returns the others."""
        known = self._old.keys() & words  # walks the words, not the dictionary
        self._young.update(zip(known, map(self._old.__getitem__, known), strict=True))
        return words.difference(known)

    def _learn(self, absent: set[bytes]) -> None:
        young, parted, plain = self._young, [], set()
        for w in self._remembered(absent):
            stem = w.rstrip(self.TAILS)
            if stem and len(stem) < len(w) and stem.decode("utf-8", "replace").lower()[-1].isalnum():
                parted.append((w, stem, w[len(stem) :]))
                plain.update(parted[-1][1:])
            else:
                plain.add(w)
        todo = list(self._remembered(plain.difference(young)))
        if todo:
            texts = [w.decode("utf-8", "replace") for w in todo]
            for w, e in zip(todo, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = e.ids
                young[w] = struct.pack(f"<{len(ids)}I", *ids)
        for w, stem, tail in parted:
            young[w] = young[stem] + young[tail]


@cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker: what it has learnt serves its later tasks."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest of the files written: part, file_no, file, n_docs, n_ids. Order: ascending doc_id over (part, file_no)."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, task = word_encoder(tokenizer), TaskContext.get()
        doc_ids, lengths, pieces, n, file_no = [], [], [], 0, 0
        end = struct.pack("<I", end_id)

        def flush() -> pd.DataFrame:
            name = f"{folder}/part-{task.partitionId():06d}-{file_no:05d}-{task.taskAttemptId()}.dac"
            to, at = fs.FileSystem.from_uri(name)
            with to.open_output_stream(at) as out:
                out.write(pack(doc_ids, lengths, np.frombuffer(b"".join(pieces), "<u4")))
            return pd.DataFrame([(task.partitionId(), file_no, name, len(doc_ids), n)], columns=["part", "file_no", "file", "n_docs", "n_ids"])

        for pdf in parts:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                pieces += [encoder.encode(text), end]
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                lengths.append(len(pieces[-2]) // 4 + 1)
                n += lengths[-1]
                if n >= FILE_IDS:
                    yield flush()
                    doc_ids, lengths, pieces, n, file_no = [], [], [], 0, file_no + 1
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(placed.mapInPandas(write, "part int, file_no int, file string, n_docs long, n_ids long"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    before = F.sum("n_ids").over(W.orderBy("part", "file_no").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    n = max(1, min(-(-manifest.count() // 4), 20_000))  # a task reads about four files, one after another

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in parts:
            for name, start in zip(pdf["file"], pdf["before"], strict=True):
                where, path = fs.FileSystem.from_uri(name)
                with where.open_input_file(path) as source:
                    codes = Codes(source.read())
                ids, at = codes.tokens().astype("<u4"), codes.starts.astype(np.int64)
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(codes.doc_ids, "Int64"), "start": at[:-1] + int(start), "n_tokens": np.diff(at), "ids_crc32": np.array(crc, np.int64)})

    return files.repartition(n, "file").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_codes(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), new_folder(spark, "op6"), public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(manifest)


QUERIES = {"op6_token_codes": op6_token_codes}
ORACLE: dict = {}
