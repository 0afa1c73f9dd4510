"""Mixture-controlled packing of token ids into fixed windows by deficit round-robin.

Every source is a queue of packets (at most ``packet`` following ids of one document). In
each round a queue earns a quantum, its target share of one window, and sends packets while
its credit covers them; what is left, the deficit, is carried into the next round. As a
queue that still has packets keeps all it has earned, a packet that ends at the C-th id of
its queue is sent in round ceil(C / quantum). That closed form lets every task place its
own packets: the rounds need running sums over queues and rounds, not a sequential pass.
The stream of packets is cut every ``window`` ids, so windows are full but for the last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode_text, json_encoding
from .common import block_offsets, hash_block, materialise, running_offsets, table

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0) -> DataFrame:
    """Per row: ``_row`` (unique), doc_id, source, n_tokens and the ids as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = json_encoding(tokenizer_path)
        added = tuple(enc.special_tokens_set)
        kind = np.dtype("<u2" if enc.max_token_value < 1 << 16 else "<u4")
        end = [] if end_id is None else [end_id]
        for batch in batches:
            ids = [np.asarray(encode_text(enc, t or "", added) + end, kind).tobytes() for t in batch.column("text").to_pylist()]
            n = pa.array([len(b) // kind.itemsize for b in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), batch.column("source"), n, pa.array(ids, pa.binary())], ["_row", "doc_id", "source", "n_tokens", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long"), F.coalesce(F.col("source"), F.lit("")).alias("source"), "text")
    return rows.mapInArrow(run, "_row long, doc_id long, source string, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, weights: dict[str, float] | None = None, window: int = 1024, packet: int = 256, end_id: int | None = 0) -> DataFrame:
    """Pack all documents (doc_id, source, text) into windows of ``window`` ids.

    ``weights`` gives each source's target share (relative; a source not named gets the
    smallest given weight; all must be positive); without it every window mirrors the corpus, each source having
    its share of all ids. When a queue runs dry the others go on in their proportions.
    Within a queue, documents follow a hash of their row, so repeated ids are spread too.

    Result, one row per piece: doc_id, start (its document's ids before it), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset, source.
    Null text is empty and still has its end id; null and empty sources are one queue; a
    null id is kept; equal rows are packed each; further columns are ignored; an empty
    table gives no rows. Texts of any length are cut into as many pieces as they need.
    """
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be positive: a queue without a quantum is never sent")
    tokens = materialise(tokenize(docs, tokenizer_path, end_id))
    meta = tokens.select("_row", "doc_id", "source", "n_tokens").where("n_tokens > 0")
    sizes = meta.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("_size"))
    if weights:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, _given double")
        sizes = sizes.join(F.broadcast(named), "source", "left").select("source", F.coalesce("_given", F.lit(min(weights.values()))).alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_all"))
    quanta = sizes.join(F.broadcast(total)).select("source", (F.col("_size") / F.col("_all") * window).alias("_quantum"))

    queued = running_offsets(meta, ["source"], hash_block("doc_id", "_row"), ["doc_id", "n_tokens", "_row"], "n_tokens", "_before").join(quanta, "source")
    packets = queued.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(packet).cast("long"))).alias("start")).withColumn("length", F.least(F.lit(packet).cast("long"), F.col("n_tokens") - F.col("start")))
    end = F.col("_before") + F.col("start") + F.col("length")
    packets = packets.select("_row", "source", "start", "length", end.alias("_end"), F.ceil(end / F.col("_quantum")).cast("long").alias("_round"))

    block = F.shiftright("_round", 8)
    packets = packets.withColumn("_block", block)
    base = block_offsets(packets.groupBy("_block").agg(F.sum("length").alias("_total")).withColumn("_all", F.lit(0)), ["_all"], "_block", "_total").select("_block", "_base")
    before = Window.partitionBy("_block").orderBy("_round", "source", "_end").rowsBetween(Window.unboundedPreceding, -1)
    placed = packets.withColumn("_local", F.coalesce(F.sum("length").over(before), F.lit(0))).join(base, "_block")
    cuts = placed.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "length", (F.col("_local") + F.col("_base")).alias("at")))).alias("cuts"))
    wide = tokens.join(cuts.hint("shuffle_hash"), "_row").select("doc_id", "source", "n_tokens", "ids", F.col("cuts.start").alias("start"), F.col("cuts.length").alias("length"), F.col("cuts.at").alias("at"))
    return wide.mapInArrow(_cutter(window), _PIECES)


def _cutter(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, source, n, ids, start, length, at in zip(*(batch.column(i).to_pylist() for i in range(7))):
                wide = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                parts: list[list[int]] = []
                for s, size, place in zip(start, length, at):
                    while size:
                        take = min(size, window - place % window)
                        if parts and parts[-1][2] + parts[-1][1] == place and place % window:
                            parts[-1][1] += take
                        else:
                            parts.append([s, take, place])
                        s, size, place = s + take, size - take, place + take
                for s, size, place in parts:
                    for column, value in zip(out, (doc, s, size, zlib.crc32(wide[s : s + size].tobytes()), n, place // window, place % window, source)):
                        column.append(value)
            kinds = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [x.split()[0] for x in _PIECES.split(", ")])

    return run


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids; cases as in ``pack``."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
