"""Alignment of the tokens of two tokenizers over the same bytes.

Documents go into chunks: about an Arrow batch of text each, with both tokenizers' ids. All
token bytes of a chunk are laid end to end, documents behind each other. The ends of the
tokens of both are counted once by byte offset: where a count is two, both end, and a group
is cut; and each interval between neighbouring ends is one pair of tokens that overlap, one
link. Prefix sums over links, read at the documents' ends, give each document's figures.

A link's count is over the corpus. Each chunk gives its distinct id pairs with their counts,
Spark adds them up by pair, and each chunk gets the sums of its own pairs back. So what is
shuffled is a chunk's vocabulary and not its links, and no table of all pairs is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode_text, json_encoding
from .common import materialise, table

#: Code points of text in a chunk (a longer document is a chunk of its own) and of a text that pieces are made of at once; bytes whose ends are counted at once.
CHUNK_CHARS, PIECE_CHARS, SPAN = 8 << 20, 16_384, 8 << 20


@dataclass(frozen=True)
class Pieces:
    """A sentencepiece model, its tokens' bytes, the id of a lone space, and if no piece goes on after a space."""

    model: sentencepiece.SentencePieceProcessor
    back: tuple[bytes, ...]
    space: int
    by_word: bool

    def encode(self, text: str) -> list[int]:
        """The model's ids of a text; a long one is cut before spaces, where no piece reaches across."""
        if len(text) <= PIECE_CHARS or not self.by_word:
            return self.model.encode(text)
        out: list[int] = []
        at = 0
        while at < len(text):
            cut = text.find(" ", at + PIECE_CHARS)
            while cut > 0 and (text[cut - 1] in " ▁" or text[cut + 1 : cut + 2] in ("", " ", "▁")):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                cut = len(text)
            out += self.model.encode(text[at:cut])
            at = cut + 1  # the space that the model puts before a text stands for this one
        return out


@lru_cache(maxsize=2)
def piece_model(path: str) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    one_byte = re.compile(r"<0x([0-9A-F]{2})>")
    back = [bytes([int(m[1], 16)]) if model.is_byte(i) and (m := one_byte.fullmatch(n)) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return Pieces(model, tuple(back), model.piece_to_id("▁"), not any(re.search("[^▁]▁", n) for n in names))


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> tuple[bytes, ...]:
    """The bytes of each id of a byte-level vocabulary file, added tokens included."""
    enc = json_encoding(path)
    return tuple(enc.decode_single_token_bytes(i) for i in range(enc.n_vocab))


def tokens_of(text: str | None, a_path: str, b_path: str) -> tuple[list[int], list[int]]:
    """The ids of both tokenizers for a text; none if their bytes aren't those of a space and the text."""
    if not text:
        return [], []
    spaced = " " + text
    a, b = encode_text(json_encoding(a_path), spaced), piece_model(b_path).encode(text)
    raw = spaced.encode()
    if b"".join(map(byte_tokens(a_path).__getitem__, a)) != raw or b"".join(map(piece_model(b_path).back.__getitem__, b)) != raw:
        return [], []
    return a, b


_CHUNKS = "chunk long, doc_ids array<long>, n_a binary, n_b binary, a binary, b binary"


def _tokenise(a_path: str, b_path: str, chunk_chars: int):
    """Chunks of (doc_id, text): the documents' ids, their numbers of tokens, and all tokens of both tokenizers, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        n_a, n_b, a_parts, b_parts, size = [], [], [], [], 0
        pack = zstandard.ZstdCompressor(level=3).compress

        def chunk() -> pa.RecordBatch:
            tokens = [pack(np.concatenate([np.zeros(0, "<u4"), *parts]).tobytes()) for parts in (a_parts, b_parts)]
            counts = [np.array(n, "<i8").tobytes() for n in (n_a, n_b)]
            columns = [pa.array([task + made]), pa.array([ids], pa.list_(pa.int64())), *(pa.array([c], pa.binary()) for c in (*counts, *tokens))]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "n_a", "n_b", "a", "b"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                a, b = tokens_of(text, a_path, b_path)
                ids.append(doc_id)
                n_a.append(len(a))
                n_b.append(len(b))
                a_parts.append(np.array(a, "<u4"))
                b_parts.append(np.array(b, "<u4"))
                size += len(text or "")
                if size >= chunk_chars:
                    yield chunk()
                    made, ids, n_a, n_b, a_parts, b_parts, size = made + 1, [], [], [], [], [], 0
        if ids:
            yield chunk()

    return run


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens of either end, and where both do; counted over ``span`` bytes at a time."""
    links, cuts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, int(ends_a[-1]) + 1 if len(ends_a) else 0, span):
        inside = [e[np.searchsorted(e, lo) : np.searchsorted(e, lo + span)] - lo for e in (ends_a, ends_b)]
        count = np.bincount(np.concatenate(inside), minlength=1)
        links.append(np.flatnonzero(count) + lo)
        cuts.append(np.flatnonzero(count == 2) + lo)
    return np.concatenate(links), np.concatenate(cuts)


@dataclass(frozen=True)
class Chunk:
    """Tokens of a chunk's documents laid end to end."""

    doc_ids: list
    n_a: np.ndarray
    n_b: np.ndarray
    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    doc_ends: np.ndarray
    links: np.ndarray  # where links end: every end of a token
    cuts: np.ndarray  # where groups end: the ends of both

    @classmethod
    def read(cls, row: dict, a_path: str, b_path: str) -> Chunk:
        unpack = lambda raw: np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4").astype(np.int64)
        n_a, n_b, a, b = np.frombuffer(row["n_a"], "<i8"), np.frombuffer(row["n_b"], "<i8"), unpack(row["a"]), unpack(row["b"])
        return cls.of(row["doc_ids"], n_a, n_b, a, b, _widths(a_path, b_path))

    @classmethod
    def of(cls, doc_ids: list, n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, widths: tuple[np.ndarray, np.ndarray]) -> Chunk:
        ends_a, ends_b = np.cumsum(widths[0][a]), np.cumsum(widths[1][b])
        doc_ends = np.concatenate(([0], ends_a))[np.cumsum(n_a)]
        links, cuts = common_ends(ends_a, ends_b)
        return cls(doc_ids, n_a, n_b, a, b, ends_a, ends_b, doc_ends, links, cuts)

    def pairs(self, width: int) -> np.ndarray:
        """Per link the ids of its two tokens in one number: a * ``width`` + b."""
        return self.a[np.searchsorted(self.ends_a, self.links)] * width + self.b[np.searchsorted(self.ends_b, self.links)]

    def per_document(self, ends: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """Per document how many of the places ``ends`` it holds, or the sum of their ``values``."""
        upto = np.searchsorted(ends, self.doc_ends, "right")
        if values is not None:
            upto = np.concatenate(([0], np.cumsum(values)))[upto]
        return np.diff(upto, prepend=0)

    def shown(self, names: list[bytes], n_a_ids: int) -> Iterator[bytes]:
        """Per document its groups as text. ``names`` has two of each id, of A's before B's: one inside a group, one at its end."""
        group_a, group_b = np.searchsorted(self.cuts, self.ends_a), np.searchsorted(self.cuts, self.ends_b)
        b_before = np.concatenate(([0], np.searchsorted(self.ends_b, self.cuts, "right")))
        a_upto = np.searchsorted(self.ends_a, self.cuts, "right")
        out = np.empty(len(self.a) + len(self.b), np.int64)
        last = lambda ends, group: (self.cuts[group] == ends).astype(np.int64)
        out[np.arange(len(self.a)) + b_before[group_a]] = 2 * self.a + last(self.ends_a, group_a)
        out[np.arange(len(self.b)) + a_upto[group_b]] = 2 * (n_a_ids + self.b) + last(self.ends_b, group_b)
        to = np.cumsum(self.n_a + self.n_b)
        for lo, hi in zip((to - self.n_a - self.n_b).tolist(), to.tolist()):
            yield b"".join(map(names.__getitem__, out[lo:hi].tolist()))[:-1]


@lru_cache(maxsize=2)
def _widths(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(t) for t in back], np.int64) for back in (byte_tokens(a_path), piece_model(b_path).back))


@lru_cache(maxsize=2)
def _names(n_a: int, n_b: int) -> list[bytes]:
    return [*(str(i).encode() + end for i in range(n_a) for end in (b",", b"|")), *(str(i).encode() + end for i in range(n_b) for end in (b",", b";"))]


def _pair_counts(a_path: str, b_path: str):
    """The distinct id pairs of each chunk with the number of their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                pairs, n = np.unique(Chunk.read(one, a_path, b_path).pairs(len(piece_model(b_path).back)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), one["chunk"])), pa.array(pairs), pa.array(n)], ["chunk", "pair", "n"])

    return run


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(a_path: str, b_path: str):
    """The figures of a chunk's documents, from the chunk and its pairs (pair, count, best)."""

    def run(chunks: pa.Table, pairs: pa.Table) -> pa.Table:
        chunk = Chunk.read(chunks.to_pylist()[0], a_path, b_path)
        n_a, n_b = (len(back) for back in (byte_tokens(a_path), piece_model(b_path).back))
        known = pairs.column("pair").to_numpy()
        order = np.argsort(known)
        at = order[np.searchsorted(known, chunk.pairs(n_b), sorter=order)] if len(known) else np.zeros(0, np.int64)
        count, best = pairs.column("count").to_numpy()[at], pairs.column("best").to_numpy(zero_copy_only=False)[at] if len(known) else at
        digests = [hashlib.sha256(s).hexdigest() if s else "" for s in chunk.shown(_names(n_a, n_b), n_a)]
        columns = [chunk.n_a, chunk.n_b, chunk.per_document(chunk.cuts), chunk.per_document(chunk.links), chunk.per_document(chunk.links, best.astype(np.int64)), chunk.per_document(chunk.links, count)]
        names = [f.split()[0] for f in _OUT.split(", ")]
        return pa.Table.from_arrays([pa.array(chunk.doc_ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string())], names)

    return run


def align_documents(docs: DataFrame, a_path: str, b_path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A's tokens are those of a space and the text, B's those of the text, to which B adds the
    space; special tokens' strings are plain text. Null and empty texts, and those whose
    tokens' bytes aren't a space and the text, have no tokens: zeros and an empty digest.
    Null and repeated ids and equal rows give a row each and all count; texts of any length
    are taken whole; a pair's count is over all rows, and of a B id's pairs all that have the
    highest count are best. Further columns are ignored; an empty table gives no rows.
    ``chunk_chars`` divides the work and changes no figure.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = materialise(rows.mapInArrow(_tokenise(a_path, b_path, chunk_chars), _CHUNKS))
    width = len(piece_model(b_path).back)
    found = chunks.select("chunk", F.lit(None).cast("array<long>").alias("doc_ids"), "n_a", "n_b", "a", "b").mapInArrow(_pair_counts(a_path, b_path), "chunk long, pair long, n long")
    total = F.sum("n").over(Window.partitionBy("pair"))
    counted = materialise(found.select("chunk", "pair", total.alias("count")))
    piece = F.pmod("pair", F.lit(width))
    highest = counted.groupBy(piece.alias("_piece")).agg(F.max("count").alias("_highest"))  # at most a row for each id of B
    known = counted.withColumn("_piece", piece).join(F.broadcast(highest), "_piece").select("chunk", "pair", "count", (F.col("count") == F.col("_highest")).alias("best"))
    return chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_finish(a_path, b_path), _OUT)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the byte-level and the piece vocabulary, aligned for all documents; cases as in ``align_documents``."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_documents(table(spark, sf_dir, "documents"), *paths)
