"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered whole as ``<|turn|>role<|text|>text<|end|>`` per turn and encoded
once, the three control strings as tokens of their own. Each token's byte offsets follow
from the widths of its id; the sorted spans of the assistant's texts are intersected with
them by binary search. Control strings stand on both sides of a text, so no token crosses
its edge and the mask covers exactly the assistant's texts.

A text that holds something like a control string is escaped: every ``<`` that backslashes
and then ``|`` follow gets one more backslash. Reading takes one away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_text, rank_encoding
from .common import table

TURN, TEXT, END = CONTROLS = ("<|turn|>", "<|text|>", "<|end|>")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)
FORMATTED = "conv_id long, formatted string, ids array<int>, loss_mask array<boolean>, starts array<int>, ends array<int>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation, and the byte spans in it of the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        at += len(head.encode())
        end = at + len(body.encode())
        if role == "assistant":
            spans.append((at, end))
        parts += [head, body, END]
        at = end + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mask_tokens(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens (given by their ascending byte ends) that share a byte with a sorted span."""
    mask = np.zeros(len(ends), bool)
    if spans:
        edges = np.asarray(spans)
        first = np.searchsorted(ends, edges[:, 0], side="right")
        last = np.searchsorted(ends, edges[:, 1], side="left")
        for a, b, (x, y) in zip(first, last, spans):
            if y > x:
                mask[a : b + 1] = True
    return mask


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conv_id: its turns in order of (turn, role, text); null role or text is empty.

    Rows of equal turn numbers all stay; null turns come first; null ids make one
    conversation, since an id is all that says which rows belong together (it must fit a
    task, like any conversation).
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_conversations(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per conversation: the rendered text, its ids, the loss mask, and each token's byte span.

    Cases as in ``conversations``; an empty text has no token under the mask; texts of any
    length are encoded whole; further columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, back = rank_encoding(ranks_path, pattern, CONTROLS)
        width = np.array(list(map(len, back)), np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for turns in batch.column("turns").to_pylist():
                formatted, spans = render([(t["role"], t["text"]) for t in turns])
                ids = np.asarray(encode_text(enc, formatted, CONTROLS), np.int32)
                ends = np.cumsum(width[ids])
                for column, value in zip(out, (formatted, ids, mask_tokens(ends, spans), (ends - width[ids]).astype(np.int32), ends.astype(np.int32))):
                    column.append(value)
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(out, kinds))], ["conv_id", "formatted", "ids", "loss_mask", "starts", "ends"])

    return conversations(rows).mapInArrow(run, FORMATTED)


def _read_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for conv, formatted, mask, starts, ends in zip(f["conv_id"], f["formatted"], f["loss_mask"], f["starts"], f["ends"]):
            turns, raw = read_turns(formatted), formatted.encode()
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
            held = np.flatnonzero(np.asarray(mask, bool))
            runs = np.split(held, np.flatnonzero(np.diff(held) > 1) + 1) if len(held) else []
            loss = "".join(unescape(raw[starts[r[0]] : ends[r[-1]]].decode()) for r in runs)
            out.append((conv, len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read back from formatted conversations: turns, and text under the loss mask.

    A conversation without assistant's text has no loss characters. An empty table gives no rows.
    """
    return formatted.select("conv_id", "formatted", "loss_mask", "starts", "ends").mapInPandas(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of -7, as read back from their formatted form; cases as in ``format_conversations``."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_formatted(format_conversations(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
