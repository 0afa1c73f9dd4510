"""Byte-level BPE encoding and decoding of long texts by overlapping chunks.

A pre-token that starts at a place depends only on the text from there on. So a chunk that
starts inside a pre-token may begin with wrong cuts, but once one of its cuts meets a cut of
the chunk before, all its later ones are right. Long texts are split into overlapping
chunks, their cuts are found in parallel, each seam is stitched at the first common cut,
and the pieces between seams are encoded. A seam never stands behind white space, whose cut
depends on what follows it. Where an overlap holds no such common cut (one pre-token spans
it), the chunks become one piece and are cut again once it has doubled, so a text that is
one pre-token costs time in proportion to its length. ``chunk`` and ``overlap`` change the
work's division and not the ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SPACE, encode_text, rank_encoding
from .common import table

_SPACES = frozenset(chr(c) for c in range(0x3001) if regex.fullmatch(f"[{SPACE}]", chr(c)))


def cut_points(text: str, pattern: str, last: bool) -> list[int]:
    """Ends of the pre-tokens of ``text``; of a chunk that goes on, only those that its end can't change."""
    ends = [m.end() for m in regex.finditer(pattern, text)]
    if not last:  # the last match may go on, and white space before it may be cut otherwise
        ends = ends[:-2]
    return ends


def chunk_rows(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks of texts: _row, doc_id, chunk number, its start (code points), its text, and if it is the last."""
    n = F.char_length("text")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(chunk - overlap))
    rows = docs.select("_row", "doc_id", "text", n.alias("_n"), F.posexplode(starts).alias("part", "start"))
    return rows.select("_row", "doc_id", "part", "start", F.substring(F.col("text"), F.col("start") + 1, F.lit(chunk)).alias("text"), (F.col("start") + chunk >= F.col("_n")).alias("last"))


def _find_cuts(pattern: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(cuts=[[s + e for e in cut_points(t, pattern, bool(z))] for t, s, z in zip(f["text"], f["start"], f["last"])])

    return run


def stitch(chunks: list[tuple[int, str, bool, list[int]]], pattern: str) -> list[str]:
    """Pieces of a text, each from one seam to the next, from its chunks (start, text, is last, cuts) in order."""
    out: list[str] = []
    start, text, last, cuts = chunks[0]
    parts, end, known, done = [text], start + len(text), set(cuts), len(text)  # the text from the last seam on, its true cuts, and its length when it was cut
    for s, text, last, own in chunks[1:]:
        seam = next((c for c in own if c in known and text[c - s - 1] not in _SPACES), None)
        parts.append(text[end - s :])
        end = s + len(text)
        if seam is not None:
            whole = "".join(parts)
            out.append(whole[: seam - start])
            parts, start, known = [whole[seam - start :]], seam, {c for c in own if c > seam}
            done = end - start
        elif last or end - start >= 2 * done:  # one pre-token spans the overlap
            parts, done = ["".join(parts)], end - start
            known = {start + e for e in cut_points(parts[0], pattern, last)}
        else:
            known = set()
    return [*out, "".join(parts)]


def _stitch_document(pattern: str):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("part")
        chunks = [(int(s), t, bool(z), [int(c) for c in cuts]) for s, t, z, cuts in zip(f["start"], f["text"], f["last"], f["cuts"])]
        out = stitch(chunks, pattern)
        return pd.DataFrame({"_row": f["_row"].iloc[0], "doc_id": f["doc_id"].iloc[0], "part": np.arange(len(out)), "text": out})

    return run


def _encode_pieces(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = rank_encoding(path, pattern)
        for batch in batches:
            ids = [np.asarray(encode_text(enc, t), "<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield batch.drop_columns(["text"]).append_column("ids", pa.array(ids, pa.binary()))

    return run


def _join_pieces(f: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": [f["doc_id"].iloc[0]], "ids": [b"".join(f.sort_values("part")["ids"])]})


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit) of every whole text of (doc_id, text).

    Texts of at most ``chunk`` code points are encoded as they are; longer ones by
    overlapping chunks, dealt over all tasks. Null text is empty and has no ids. Null and
    repeated ids and equal rows give a row each; further columns are ignored; an empty table
    gives no rows. White space of any length has the ids of the library's rule.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > chunk
    whole = rows.where(~long).mapInArrow(_encode_pieces(ranks_path, pattern), "doc_id long, ids binary")
    numbered = rows.where(long).withColumn("_row", F.monotonically_increasing_id())
    parts = chunk_rows(numbered, chunk, overlap).repartition("_row", "part")
    cut = parts.mapInPandas(_find_cuts(pattern), "_row long, doc_id long, part int, start int, text string, last boolean, cuts array<int>")
    pieces = cut.groupBy("_row").applyInPandas(_stitch_document(pattern), "_row long, doc_id long, part int, text string")
    split = pieces.mapInArrow(_encode_pieces(ranks_path, pattern), "_row long, doc_id long, part int, ids binary")
    return whole.unionByName(split.groupBy("_row").applyInPandas(_join_pieces, "doc_id long, ids binary"))


def decode_ids(ids: np.ndarray, back: tuple[bytes, ...]) -> bytes:
    """The raw bytes of ids: their tokens' bytes one after the other."""
    return b"".join(map(back.__getitem__, ids.tolist()))


def digest_ids(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests of (doc_id, ids): the number of ids, of their decimal text, and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, back = rank_encoding(ranks_path, pattern)
        number = [str(i).encode() for i in range(len(back))]
        for batch in batches:
            n, shown, decoded = [], [], []
            for raw in batch.column("ids").to_pylist():
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                shown.append(hashlib.sha256(b" ".join(map(number.__getitem__, ids.tolist()))).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(ids, back)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(shown, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to; cases as in ``encode_documents``."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return digest_ids(encode_documents(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
